from pyspark.sql import functions as F

from attestra.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def matches(spark, quote, page):
    df = spark.createDataFrame([(quote, page)], "q string, p string").select(T.page_variants(F.col("p")).alias("p"), "q")
    return df.select(T.has_quote(F.col("p"), F.col("q"))).first()[0]


def test_quotes_match_across_notation(spark):
    for quote, page, want in [
        ("tool™ helps people daily", "this tool&trade; helps people daily now", True),
        ("gain of + 3.3 points", "a gain of +3.3 points", True),
        ("faster by 1.83 × on average", "faster by 1.83× on average", True),
        ("group ABC123 is preferred", "group <u>ABC123</u> is preferred", True),
        ("quick start is here", "[quick start](https://x.example) is here", True),
        ("漏洞 CVE 分数 (wild use) 很高", "漏洞CVE分数（wild use）很高", True),
        ("target system found", "tar-\nget system found", True),
        ("limit is 1.5 million calls", "limit is 1,5 million calls", False),
        ("gain of +3.3 points", "gain of +4.3 points", False),
        ("the values[0] entry is used", "the values0 entry is used", False),
        ("the agency signed an order... for the northern pilot scheme", "The agency signed an order (ABC) for the northern pilot scheme.", True),
        ("range exceeds 3km [1.86 miles] against small targets", "range exceeds 3km (1.86 miles) against small targets", True),
    ]:
        assert matches(spark, quote, page) is want, (quote, page)


def test_dotted_capital_is_equal(spark):
    assert one(spark, T.norm(F.col("a")), a="İSTANBUL") == "istanbul"


def test_evidence(spark):
    ev = one(spark, T.evidence(F.col("a")), a='pkg: "pkg does not accept the --all flag" and `PKG_FAST_MODE`, 8-10x, 0.12.23 — [D](https://x.example/z)')
    assert (ev["quotes"], ev["codes"], ev["numbers"]) == (["pkg does not accept the --all flag"], ["PKG_FAST_MODE"], ["8-10x", "0.12.23"])
    ev = one(spark, T.evidence(F.col("a")), a='X — "a sufficiently long exact quote" — [U](https://x.example) (2026-08, birincil)')
    assert (len(ev["quotes"]), ev["codes"], ev["numbers"]) == (1, [], [])
    assert len(one(spark, T.quotes(F.col("a")), a='"Each “part list” is a plain list with links"')) == 1
    assert one(spark, T.quotes(F.col("a")), a='short "Optional" then — "the tooling is no longer part of the plan"') == ["the tooling is no longer part of the plan"]


def test_caps(spark):
    text = " ".join(f'"quotation number {i} is long"' for i in range(4)) + " " + " ".join(f"`code{i}`" for i in range(5)) + " " + " ".join(f"{i}1234 ms" for i in range(1, 7))
    s = one(spark, T.evidence(F.col("a")), a=text)["skipped"]
    assert (s["quotes"], s["codes"], s["numbers"]) == (1, 1, 1)


def test_numbers(spark):
    def on(n, page):
        return one(spark, T.has_number(F.col("p"), F.col("n")), p=page, n=n)

    assert on("%26,2", "26.2% of it") and not on("%26,2", "62.2% of it")
    assert on("1,37", "$1.37 billion") and on("100.000", "about 100,000 x") and on("100000", "about 100000 x")
    assert on("1.2.3", "build v1.2.3 out") and not on("1.2", "takes 11.20 s") and not on("1.2", "v1.2.3")
    assert one(spark, T.number_variants(F.col("a")), a="100.000") == ["100.000", "100000", "100,000"]


def test_offsets_are_code_points(spark):
    assert one(spark, T.starts_of(F.col("p"), T.number_pattern(F.lit("12"))), p="a 12 bb 12.5 c 12") == [2, 15]
    assert one(spark, T.starts_of(F.col("p"), T.number_pattern(F.lit("12"))), p="🀄 12") == [2]


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "a string")
    assert df.select(T.norm(F.col("a")).alias("n"), T.copy_norm(F.col("a")).alias("c"), T.citation_tag(F.col("a")).alias("t")).first()[:] == (None, None, None)


def test_copies_of_hard_letters_and_spaces(spark, tmp_path):
    from attestra.plans.queries import QUERIES

    cases = {
        "İSTANBUL Iğdır": "i stanbul iğdır", "see https://a.example/X\u2003next www.b.example\u00a0too": "see next too", "a\u200bb\u2060c\u200fd": "a b c d", "x\u2009\u2028y": "x y",
        "ΟΔΟΣ x_1\u3000٣": "οδος x_1 ٣", "http://a.example/\u200bstill": "", None: None,
    }
    rows = [(i, t) for i, t in enumerate(cases)]
    spark.createDataFrame([*rows, rows[0]], "pasaj_no long, metin string").write.parquet(f"{tmp_path}/pasaj.parquet")
    got = sorted(tuple(r) for r in QUERIES["t_copy_norm"](spark, str(tmp_path)).collect())
    assert got == list(enumerate(cases.values()))


def test_citation_tag(spark):
    tag = one(spark, T.citation_tag(F.col("a")), a="x (v2; 2024-09/2026-08, birincil)")
    assert (tag["year"], tag["month"], tag["kind"]) == (2026, 8, "primary")


def test_masks(spark):
    assert one(spark, T.mask_secrets(F.col("a")), a="price per token for users") == "price per token for users"
    secret = "s" * 24
    for text in (f"api_key={secret}", "Bearer " + secret, "sk" + "-" + secret):
        assert secret not in one(spark, T.mask_secrets(F.col("a")), a=text)


def test_error_summary_and_snippet(spark):
    assert one(spark, T.error_summary(F.col("a")), a="one\n--\ntwo2\nthree\nfour") == "two2 | three | four"
    assert "needle" in one(spark, T.snippet(F.col("a"), F.lit("needle")), a="x" * 500 + " needle " + "y" * 500)
