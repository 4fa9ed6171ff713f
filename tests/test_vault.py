import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import vault as V

RECORD = "kayit_no long, istenen_url string, ok boolean, markdown string, fetched_at double"


def test_upsert_counts(spark):
    rows = [(1, "https://a.example/x", True, "t", 5.0), (2, "http://www.a.example/x/", True, "t", 5.0), (3, "https://a.example/x?utm_source=q", True, "t", 9.0), (4, "https://a.example/x", True, "t", 7.0), (5, "https://b.example/", True, "t", None), (6, "https://c.example/", False, "t", 1.0), (7, "https://d.example/", True, " ", 1.0), (8, None, True, "t", 1.0)]
    df = spark.createDataFrame(rows, RECORD)
    assert {r["islem"]: r["n"] for r in V.upsert_counts(df).collect()} == {"added": 2, "skipped": 2, "updated": 1}
    got = {r["url"]: r["kayit_no"] for r in V.upsert(df).collect()}
    assert got == {"https://a.example/x": 3, "https://b.example/": 5}
    assert V.upsert(df, V.upsert(df)).count() == 2


def test_passages(spark):
    text = "a" * 600 + "\n\n" + "b" * 600 + "\n \n" + "c" * 50 + "\n\n" + "d" * 1700
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(V.passages(F.col("t")).alias("p")).collect()
    assert got[0]["p"] == ["a" * 600, "b" * 600 + "\n" + "c" * 50, "d" * 800, "d" * 800, "d" * 100] and got[1]["p"] == [] and got[2]["p"] is None


def test_copy_pairs_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    pages = {}
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.choice((3, 20, 120)))]
        pages[f"p{i}a"] = " ".join(t)
        if i % 2:
            t[rng.randrange(len(t))] = "edited"
            pages[f"p{i}b"] = " ".join(t)
        if i % 5 == 0:
            pages[f"p{i}c"] = pages[f"p{i}a"].upper() + "!"
    pages["empty"] = ""

    def runs(t):
        w = "".join(c if c.isalnum() or c == "_" else " " for c in t.lower())[:6000].split()
        return set() if not w else {tuple(w)} if len(w) < 8 else {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    sets = {u: runs(t) for u, t in pages.items()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85}
    got = [(r["a"], r["b"]) for r in V.copy_pairs(spark.createDataFrame(list(pages.items()), "url string, metin string")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_groups_and_independence(spark):
    pages = spark.createDataFrame([("https://a.example/1", 3.0), ("https://b.example/1", 1.0), ("https://c.example/1", 2.0)], "url string, alindi double")
    pairs = spark.createDataFrame([("https://a.example/1", "https://b.example/1")], "a string, b string")
    grouped = V.copy_groups(pages, pairs)
    g = {r["url"]: r["grup"] for r in grouped.collect()}
    import hashlib

    assert g["https://a.example/1"] == g["https://b.example/1"] == hashlib.sha1(b"https://b.example/1").hexdigest()[:12] and g["https://c.example/1"] != g["https://a.example/1"]
    hosts = grouped.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    cited = spark.createDataFrame([("n", u) for u in ("https://a.example/1", "https://b.example/1", "https://x.example/1")] + [("m", "https://a.example/1"), ("m", "https://c.example/1")], "not string, url string")
    got = {r["not"]: (r["adres"], r["okunan"], r["bagimsiz"]) for r in V.independent_sources(cited, hosts, ["not"]).collect()}
    assert got == {"n": (3, 2, 1), "m": (2, 2, 2)}


def test_chain(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    random.Random(1).shuffle(chain)
    assert {r["kok"] for r in V.roots(spark.createDataFrame(chain, "a string, b string")).collect()} == {"c000"}


def test_search(spark):
    rows = [(1, "u1", "alpha beta beta"), (2, "u2", "alpha gamma"), (3, "u3", "alpha beta"), (4, "u4", "delta")]
    pages = [(f"u{i}", "h", "t", 0.0 if i == 1 else 1e6, "g" if i in (1, 3) else None) for i in range(1, 5)]
    r, p = spark.createDataFrame(rows, "pasaj_no long, url string, metin string"), spark.createDataFrame(pages, "url string, host string, baslik string, alindi double, kopya_grubu string")
    got = V.search(r, p, 'Alpha "BETA"*', 10, 40 * 86400.0).collect()
    assert [x["url"] for x in got] == ["u1"] and got[0]["eski"]  # all words; one of the copy group; old
    assert [x["url"] for x in V.search(r, p, "gamma delta").collect()] == ["u4", "u2"]  # any word
    assert V.search(r, p, "- *").count() == 0
    with pytest.raises(ValueError):
        V.search(r, p, "  ")


def test_budget(spark):
    df = spark.createDataFrame([([(2, 100), (0, 500), (1, 30)],), ([(7, 9000)],), ([],)], "r array<struct<i:int,tokens:int>>")
    assert [r[0] for r in df.select(V.budget_choice(F.col("r"), 150)).collect()] == [[1, 2], [7], []]
    assert df.select(V.budget_choice(F.col("r"), 0)).first()[0] == [2]


def test_slots(spark):
    df = spark.createDataFrame([("h", 1, 0.0), ("h", 2, 0.1), ("h", 3, 0.2), ("h", 4, 9.0)], "host string, kayit_no long, t double")
    assert [round(r["slot"], 3) for r in V.host_slots(df).orderBy("kayit_no").collect()] == [0.0, 0.5, 1.0, 9.0]
