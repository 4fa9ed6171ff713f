from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import support as S


def test_items(spark):
    cases = [
        ("Uses X25519 here", [("identifier", "X25519")]), ("and ML-KEM-768", [("identifier", "ML-KEM-768")]), ("see PEP 703", [("identifier", "PEP 703")]), ("in 2026, the API gave 404", []),
        ("24 Mart 2026 and March 24, 2026 and 2026-03-24", [("date", "2026-03-24")]), ("May 2025 and Ağustos 2024", [("date", "2025-05-"), ("date", "2024-08-")]),
        ("it took 12 ms", [("number", "12ms")]), ("%5–10 faster", [("number", "%5-10")]), ("NATO said OK", [("acronym", "NATO")]),
        ('quoted "4711" `9999` (2026-08, birincil) [x](https://a.example/1234)', []), ("RFC 9309, then 12 ms and again 12 ms, CVE-2024-3094", [("identifier", "RFC 9309"), ("identifier", "CVE-2024-3094"), ("number", "12ms")]), ("", []), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "n int, t string")
    got = [r["i"] for r in df.select("n", S.items(F.col("t")).alias("i")).orderBy("n").collect()]
    assert [None if g is None else [(i["tur"], i["ara"]) for i in g] for g in got] == [w for _, w in cases]
    assert [(i["y"], i["m"], i["d"]) for i in got[5]] == [("2025", 5, None), ("2024", 8, None)] and got[4][0]["d"] == 24 and got[4][0]["etiket"] == "24 Mart 2026"


def test_days_of_the_run_are_skipped(spark):
    df = spark.createDataFrame([("24 Mart 2026",), ("Mart 2026",), ("25 Mart 2026",), ("Mart 2025",), ("12 ms",)], "t string").withColumn("i", F.explode(S.items(F.col("t"))))
    assert [r[0] for r in df.select(S.of_day(F.col("i"), F.lit("2026-03-24").cast("date"))).collect()] == [True, True, False, False, False]


def on(spark, sentence, page):
    df = spark.createDataFrame([(sentence, page)], "s string, p string").withColumn("i", F.explode(S.items(F.col("s")))).withColumn("p", T.norm(F.col("p")))
    return [r[0] for r in df.select(S.present(F.col("i"), F.col("p"))).collect()]


def test_presence(spark):
    assert on(spark, "March 2026", "published in mart 2026") == [True] and on(spark, "March 2026", "2026-03-01") == [True] and on(spark, "March 24, 2026", "March 2026") == [False]
    assert on(spark, "about 2.2 KB", "2,249 bytes") == [True] and on(spark, "about 2.2 KB", "9,249 bytes") == [False]
    assert on(spark, "%1-8 range", "about 1% here and 8% there") == [True] and on(spark, "ML-KEM-768", "ml kem 768 is") == [True] and on(spark, "NATO said", "nato") == [True]


NOTE = """## Q1
### Özet
It took 12 ms in the end. There were 4096 of them. About 7777 more were seen.
### Alıntılı bulgular
- A "it took a while to get there" [x](https://a.example/)
## Q2
### Özet
Nothing to see here at all.
### Alıntılı bulgular
- B "there were many of them" [x](https://b.example/)
"""


def test_tiers(spark):
    from attestra.operators import notes as N

    key = ["run_id", "slug", "dosya"]
    notes = spark.createDataFrame([("r", "s", "d", NOTE)], "run_id string, slug string, dosya string, metin string")
    pages = spark.createDataFrame([("https://a.example/", "12 ms it was"), ("https://b.example/", "4096 of them")], "sayfa_url string, sayfa string")
    got = {r["etiket"]: (r["yer"], r["seviye"]) for r in S.support(N.section_lines(notes, key), N.findings(notes, key), pages, key).collect()}
    assert got == {"12 ms": ("on_page", "info"), "4096": ("other_page", "warning"), "7777": ("nowhere", "warning")}
    got = {r["etiket"]: r["yer"] for r in S.support(N.section_lines(notes, key), N.findings(notes, key), pages.where("sayfa like '12%'"), key).collect()}
    assert got["7777"] == "unreadable_page_present"


REPORT = "# Head\n\nfirst line\nsecond line\n\n- one\n  continued\n- two\n\n> a\n> b\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```\n- not this\n```"


def test_report_items(spark):
    df = spark.createDataFrame([("r", REPORT)], "id string, metin string")
    got = [(r["satir"], r["tur"], r["metin"], r["baslik"]) for r in S.report_items(df, ["id"]).orderBy("satir").collect()]
    assert got == [(3, "paragraph", "first line second line", "Head"), (6, "bullet", "one continued", "Head"), (8, "bullet", "two", "Head"), (10, "quote", "a b", "Head"), (13, "table", "h | i", "Head"), (15, "table", "1 | 2", "Head")]


def test_completed_addresses(spark):
    df = spark.createDataFrame([("see site.io/path now",), ("app.site.io/name=x",), ("https://site.io/a",)], "t string")
    assert [r[0] for r in df.select(S.complete_urls(F.col("t"))).collect()] == ["see https://site.io/path now", "app.site.io/name=x", "https://site.io/a"]


def test_report_check(spark):
    items = spark.createDataFrame([("r", 1, 'A "quotation of some length here" 4711 ms https://a.example/'), ("r", 2, 'B "another quotation not there" https://a.example/'), ("r", 3, "C 5555 ms"), ("r", 4, "See RFC 9110 https://a.example/")], "id string, satir int, metin string")
    pages = spark.createDataFrame([("https://a.example/", "quotation of some length here")], "sayfa_url string, sayfa string")
    got = sorted((r["satir"], r["tur"], r["sorun"], r["seviye"]) for r in S.check_report(items, pages, ["id"]).collect())
    assert got == [(1, "number", "missing", "warning"), (2, "quote", "missing", "error"), (3, "number", "no_url", "info")]


def test_report_check_on_the_pool_and_subjects(spark):
    a, b = "https://alpha.example/", "https://b.example/"
    items = [
        (1, f"Cites {a}"), (2, f"Cites {b}"), (3, 'Says "words that no page has here"'), (4, 'Says "words that one page has"'), (5, "It took 5555 ms"), (6, "It took 4711 ms"), (7, "By alpha it took 4711 ms"), (8, "RFC 9110 is known"),
        (9, f"Zebrafish took 4711 ms {a}"), (10, f"Zebrafish took 8888 ms {a}"), (11, f"drag-and-drop took 4711 ms {a}"), (12, f"hand-in-glove took 4711 ms {a}"), (13, f"drag-and-drop took 3333 ms {b}"), (14, "By alpha zebrafish took 4711 ms"),
    ]
    rows = [("r", i, m) for i, m in items] + [("other", 1, "It took 4711 ms"), ("other", 2, "Cites https://gone.example/")]
    df = spark.createDataFrame(rows, "id string, satir int, metin string")
    page = "x " * 300 + "4711 ms and words that one page has " + "x " * 1000 + "zebrafish 8888 ms"
    pages = spark.createDataFrame([(a, page), (b, "x " * 300 + "draganddrop and 3333 ms")], "sayfa_url string, sayfa string")
    got = {(r["id"], r["satir"]): (r["tur"], r["sorun"], r["seviye"]) for r in S.check_report(df, pages, ["id"], pool=True).collect()}
    assert got == {
        ("r", 3): ("quote", "missing", "warning"), ("r", 5): ("number", "missing", "warning"), ("r", 6): ("number", "uncited", "info"), ("r", 9): ("number", "far", "warning"),
        ("r", 11): ("number", "other_subject", "warning"), ("r", 14): ("number", "far", "warning"), ("other", 1): ("number", "no_url", "info"),
    }


def test_collapsed_messages(spark):
    df = spark.createDataFrame([(1, "m", "w", "t", "x", "5"), (2, "m", "w", "t", "x", "6"), (3, "m", "w", "t", "x", "5")], "o int, madde string, seviye string, tur string, mesaj string, sayi string")
    assert S.collapse_messages(df, "o").first()["sayilar"] == ["5", "6"]
