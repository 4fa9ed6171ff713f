"""Queries over planted rows, one for each rule that the test tables do not reach, against the results that the rules say.

Each query runs the same operator as its namesake over the tables; the SQL is the list
of expected rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import claims as C
from ..operators import logs as L
from ..operators import notes as N
from ..operators import pages as P
from ..operators import reports as R
from ..operators import support as S
from ..operators import vault as V
from ..operators import verdict as J
from ..runtime import cut, ensure_checkpoint_dir, ship
from ..sources import readers

KEY = ["run_id", "slug", "dosya"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _sql(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"cast({v!r} as double)"
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]" if v else "cast([] as varchar[])"
    return "'" + str(v).replace("'", "''") + "'"


def expect(columns: str, rows: list[tuple]):
    """The expected rows of a query; the columns are named in order."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = "select * from (values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") t({columns})"
        return f

    return add


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    ship(s)
    ensure_checkpoint_dir(s)
    return s.createDataFrame(rows, schema)


def _texts(s: SparkSession, texts: list, use) -> DataFrame:
    """(``no``, ``v``): ``use`` of each text."""
    return _rows(s, list(enumerate(texts)), "no int, t string").select("no", use(F.col("t")).alias("v"))


# Text.

_NORMS = ["tool™ helps people daily", "this tool&trade; helps", "gain of + 3.3 points", "faster by 1.83 × on average", "group <u>ABC123</u> is preferred", "[quick start](https://x.example) is here", "İSTANBUL", "1,5 million  calls", "中文（wild use） 检索", "values[0] entry", "“curly” and 'straight'", None, ""]


@expect("no, v", list(enumerate(["tool™ helps people daily", "this tool™ helps", "gain of +3.3 points", "faster by 1.83x on average", "group abc123 is preferred", "quick start is here", "istanbul", "1,5 million calls", "中文(wild use)检索", "values[0] entry", "curly and straight", None, ""])))
def t_norm_vectors(s, d):
    return _texts(s, _NORMS, lambda t: T.norm(t))


@expect("no, v", [(0, "the tar- get system found\nthe target system found\nthe tar-get system found"), (1, "no break here"), (2, None)])
def t_page_variant_vectors(s, d):
    return _texts(s, ["the tar-\nget system found", "no break here", None], T.page_variants)


_FINDINGS = [
    'pkg: "pkg does not accept the --all flag" and `PKG_FAST_MODE`, 8-10x, 0.12.23 — [D](https://x.example/z)', 'X — "a sufficiently long exact quote" — [U](https://x.example) (2026-08, birincil)', 'short "Optional" then — "the tooling is no longer part of the plan"', "no evidence at all",
    '"Each “part list” is a plain list with links"', "“a curly quotation that counts” and 4711", "it took 12 ms, $12 and 75% in 2026 of 2019-2021",
]


@expect(
    "no, alinti, kod, sayi",
    [
        (0, ["pkg does not accept the --all flag"], ["PKG_FAST_MODE"], ["8-10x", "0.12.23"]), (1, ["a sufficiently long exact quote"], [], []), (2, ["the tooling is no longer part of the plan"], [], []), (3, [], [], []),
        (4, ["Each “part list” is a plain list with links"], [], []), (5, ["a curly quotation that counts"], [], ["4711"]), (6, [], [], ["12ms", "$12", "75%"]),
    ],
)
def t_evidence_vectors(s, d):
    return _texts(s, _FINDINGS, T.evidence).select("no", F.col("v.quotes").alias("alinti"), F.col("v.codes").alias("kod"), F.col("v.numbers").alias("sayi"))


@expect("no, alinti, kod, sayi", [(0, 1, 1, 1)])
def t_evidence_cap_vectors(s, d):
    text = " ".join(f'"quotation number {w} of four"' for w in ("one", "two", "three", "last")) + " `aaa` `bbb` `ccc` `ddd` `eee` 1001 1002 1003 1004 1005 1006"
    return _texts(s, [text], T.evidence).select("no", F.col("v.skipped.quotes").alias("alinti"), F.col("v.skipped.codes").alias("kod"), F.col("v.skipped.numbers").alias("sayi"))


@expect("sayi, bicimler", [("100.000", ["100.000", "100000", "100,000"]), ("1,5", ["1,5", "1.5"]), ("%26,2", ["%26,2", "26,2", "26,2%", "26,2 %", "26,2 percent", "26,2 per cent", "26.2", "26.2%", "26.2 %", "26.2 percent", "26.2 per cent"]), ("42", ["42"])])
def t_number_variant_vectors(s, d):
    return _rows(s, [("100.000",), ("1,5",), ("%26,2",), ("42",)], "sayi string").select("sayi", T.number_variants(F.col("sayi")).alias("bicimler"))


_PLACES = [("%26,2", "about 26.2% of it", True), ("%26,2", "about 62.2% of it", False), ("1.2.3", "build v1.2.3 shipped", True), ("1.2", "build v1.2.3 shipped", False), ("1.2", "in 11.20 seconds", False), ("100.000", "100,000 calls", True), ("100.000", "100000 calls", True), ("1,37", "$1.37 billion", True)]


@expect("sayi, sayfa, var", _PLACES)
def t_number_place_vectors(s, d):
    return _rows(s, [x[:2] for x in _PLACES], "sayi string, sayfa string").select("sayi", "sayfa", T.has_number(F.col("sayfa"), F.col("sayi")).alias("var"))


@expect("no, var", [(0, True), (1, True), (2, True), (3, False), (4, False), (5, True)])
def t_quote_place_vectors(s, d):
    rows = [
        (0, "the agency signed an order... for the northern pilot scheme", "The agency signed an order (ABC) for the northern pilot scheme."), (1, "range exceeds 3km [1.86 miles] against small targets", "range exceeds 3km (1.86 miles) against small targets"), (2, "target system found here", "the tar-\nget system found here"),
        (3, "limit is 1.5 million calls", "limit is 1,5 million calls"), (4, "the values[0] entry is used", "the values0 entry is used"), (5, "the well-known method of the group", "the wellknown method of the group"),
    ]
    return _rows(s, rows, "no int, q string, p string").select("no", T.has_quote(T.page_variants(F.col("p"), False), F.col("q")).alias("var"))


@expect("no, v", [(0, ["42", "%5"]), (1, []), (2, ["90%"]), (3, [])])
def t_rare_number_vectors(s, d):
    return _texts(s, ["42 of them, %5 more", "PEP 703 and CVE-2024-3094 in 2024", "90% of 9", "2024-05-01"], T.rare_numbers)


@expect("no, tur, ara", [(0, "date", "2026-03-24"), (0, "number", "12ms"), (1, "identifier", "RFC 9309"), (1, "acronym", "NATO"), (2, "identifier", "ML-KEM-768"), (3, "date", "2025-05-"), (3, "number", "%5-10")])
def t_item_vectors(s, d):
    texts = ["On 24 Mart 2026 it took 12 ms, and 12 ms again, with 404", "RFC 9309 says NATO is not API", 'ML-KEM-768 "4711" `9999` [x](https://a.example/1234) (2026-08, birincil)', "May 2025 was %5–10 faster", "", None]
    return _texts(s, texts, S.items).select("no", F.explode("v").alias("i")).select("no", "i.tur", "i.ara")


@expect("no, var", [(0, True), (1, True), (2, False), (3, True), (4, False), (5, True), (6, True)])
def t_item_place_vectors(s, d):
    rows = [(0, "March 2026", "published in mart 2026"), (1, "March 2026", "2026-03-01"), (2, "March 24, 2026", "March 2026"), (3, "about 2.2 KB", "2,249 bytes"), (4, "about 2.2 KB", "9,249 bytes"), (5, "%1-8 range", "about 1% here and 8% there"), (6, "ML-KEM-768", "ml kem 768 is")]
    return _rows(s, rows, "no int, t string, p string").withColumn("i", F.get(S.items(F.col("t")), 0)).select("no", S.present(F.col("i"), T.norm(F.col("p"), False)).alias("var"))


@expect("no, v", [(0, "Bearer ***"), (1, "key *** end"), (2, "API_KEY=***"), (3, "nothing here"), (4, "password: ***")])
def t_mask_vectors(s, d):
    texts = ["Bearer " + "abcdefghij" * 3, "key " + "sk-" + "a1b2c3d4" * 3 + " end", "API_KEY=" + "s3cr3tvalue", "nothing here", "password: hunter22"]
    return _texts(s, texts, T.mask_secrets)


@expect("no, v", [(0, "third | fourth | fifth"), (1, "only one"), (2, "")])
def t_error_summary_vectors(s, d):
    return _texts(s, ["first\nsecond\n--\nthird\nfourth\r\nfifth\n", "only one", "..\n--"], T.error_summary)


# Addresses.


@expect(
    "url, kanon",
    [
        ("HTTPS://WWW.Site.ORG/Path/", "https://site.org/Path"), ("http://site.org", "https://site.org/"), ("https://site.org:443/p", "https://site.org/p"), ("http://site.org:443/p", "https://site.org:443/p"), ("https://site.org:8443/p#frag", "https://site.org:8443/p"),
        ("https://site.org/p?utm_source=n&z=2&y=1", "https://site.org/p?y=1&z=2"), ("https://site.org/p?fbclid=1&REF=t&aff_id=9&q=1", "https://site.org/p?q=1"), ("https://site.org/p?a=%41", "https://site.org/p?a=A"), ("https://site.org/p?b=1+2&a=%c3%a7", "https://site.org/p?a=%C3%A7&b=1+2"), ("mailto:x@y.example", ""), ("", ""),
    ],
)
def u_canonical_vectors(s, d):
    urls = ["HTTPS://WWW.Site.ORG/Path/", "http://site.org", "https://site.org:443/p", "http://site.org:443/p", "https://site.org:8443/p#frag", "https://site.org/p?utm_source=n&z=2&y=1", "https://site.org/p?fbclid=1&REF=t&aff_id=9&q=1", "https://site.org/p?a=%41", "https://site.org/p?b=1+2&a=%c3%a7", "mailto:x@y.example", ""]
    return _rows(s, [(u,) for u in urls], "url string").select("url", U.canonical(F.col("url")).alias("kanon"))


@expect(
    "url, sinif, puan",
    [
        ("https://data.gov.uk/x", "official", 90), ("https://a.edu/~u", "official", 60), ("https://a.edu/u", "official", 90), ("https://arxiv.org/abs/1", "preprint", 70), ("https://cve.org/x", "security-standard", 88), ("https://github.com/a/b", "repository", 65), ("https://gist.github.com/x", "community", 45),
        ("https://x.github.io/", "community", 50), ("https://en.wikipedia.org/wiki/X", "encyclopedia", 60), ("https://docs.unknown.example/", "docs-like", 55), ("https://unknown.example/best-tools", "unknown", 42), ("http://unknown.example/a?utm_source=x", "unknown", 37), ("https://unknown.xyz/", "unknown", 40), ("http://192.0.2.7/", "unknown", 25),
        ("https://owasp.org.evil.example/", "unknown", 50), ("https://medium.com/x", "community", 40), ("https://stackoverflow.com/q", "community", 55), ("ftp://unknown.example/", "unknown", 0),
    ],
)
def u_trust_vectors(s, d):
    urls = [
        "https://data.gov.uk/x", "https://a.edu/~u", "https://a.edu/u", "https://arxiv.org/abs/1", "https://cve.org/x", "https://github.com/a/b", "https://gist.github.com/x", "https://x.github.io/", "https://en.wikipedia.org/wiki/X", "https://docs.unknown.example/", "https://unknown.example/best-tools",
        "http://unknown.example/a?utm_source=x", "https://unknown.xyz/", "http://192.0.2.7/", "https://owasp.org.evil.example/", "https://medium.com/x", "https://stackoverflow.com/q", "ftp://unknown.example/",
    ]
    return _rows(s, [(u,) for u in urls], "url string").select("url", U.trust_class(U.host(F.col("url")))["class"].alias("sinif"), U.trust_score(F.col("url")).alias("puan"))


@expect("alan, url, sinif, puan, ortalama", [("github.com", "https://github.com/a", "repository", 65, 57.5), ("unknown.example", "https://unknown.example/a", "unknown", 50, 57.5)])
def a_host_trust_vectors(s, d):
    rows = [(1, "http://github.com/z"), (2, "https://github.com/a"), (3, "https://github.com/b"), (4, "https://unknown.example/best-x"), (5, "https://unknown.example/a")]
    return R.best_of_hosts(_rows(s, rows, "sira int, url string"), ["sira"])


@expect("no, izin, gecikme", [(0, False, 2.0), (1, True, 2.0), (2, True, None), (3, True, 1.0), (4, True, None), (5, False, None), (6, True, None), (7, False, 3.0), (8, True, None)])
def u_robots_vectors(s, d):
    own = "User-agent: attestra\nUser-agent: other\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /"
    rows = [
        (0, own, "/a/x", "attestra"), (1, own, "/a/b/c", "attestra"), (2, "User-agent: *\nDisallow: /a%2Fb", "/a/b", "x"), (3, "User-agent: *\nDisallow: /\nCrawl-delay: 1", "/robots.txt", "x"), (4, "User-agent: test\nDisallow: /", "/", "my-testbot"), (5, "User-agent: test\nDisallow: /", "/", "test-bot"),
        (6, "User-agent: *\nDisallow: /x\nAllow: /x", "/x", "x"), (7, "User-agent: *\nCrawl-delay: 3\nDisallow: /*.pdf$", "/q.pdf", "x"), (8, None, "/", "x"),
    ]
    return _rows(s, rows, "no int, t string, p string, a string").select("no", U.robots_decision(F.col("t"), F.col("p"), F.col("a")).alias("r")).select("no", "r.izin", "r.gecikme")


@expect("durum, kural, sinif", [(200, "rules", "ok"), (404, "allow", "dead"), (403, "allow", "unverifiable"), (500, "deny", "error"), (None, "deny", "unreachable"), (999, "deny", "unverifiable")])
def u_status_vectors(s, d):
    return _rows(s, [(200,), (404,), (403,), (500,), (None,), (999,)], "durum int").select("durum", U.robots_policy(F.col("durum")).alias("kural"), U.link_class(F.col("durum")).alias("sinif"))


@expect("url, depo, durum", [("https://github.com/a/b.git", "a/b", "stale"), ("https://github.com/topics/x", None, "missing"), ("https://www.github.com/A-c/d/blob/x", "A-c/d", "archived"), ("https://a.example/b/c", None, "error")])
def u_repository_vectors(s, d):
    rows = [("https://github.com/a/b.git", 200, False, "2024-01-01"), ("https://github.com/topics/x", 404, None, None), ("https://www.github.com/A-c/d/blob/x", 200, True, "2025-12-01"), ("https://a.example/b/c", 500, None, None)]
    r = _rows(s, rows, "url string, kod int, arsiv boolean, itme string")
    return r.select("url", readers.repository(F.col("url")).alias("depo"), readers.repository_status(F.col("kod"), F.col("arsiv"), F.col("itme").cast("date"), F.lit("2026-01-01").cast("date")).alias("durum"))


@expect("no, gecici", [(0, True), (1, True), (2, False), (3, False), (4, False), (5, True)])
def u_transient_vectors(s, d):
    return _texts(s, ["HTTP 503 from host", "read timed out", "robots izin vermiyor (HTTP 503)", "HTTP 404", None, "Connection reset by peer"], R.transient).withColumnRenamed("v", "gecici")


# Verdicts.

_PAGE = "The limit is 11.20 seconds. Build v1.2.3 shipped. It costs $12 and saves 75% of time. A small red kite rose above the hill. Basic Standard (ABC) 203, meant as the main rule for general use."
_FAR = "the quick red kite rose above the hill " + "filler " * 100 + " 4711 ms"
_SUBJECT = "zz " * 150 + "the measured rate reached 42 units in the trial " + "filler " * 400 + " Velociraptor"


def _planted(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    p, q, dead = "https://p.example/a", "https://q.example/far", "https://dead.example/x"
    cases = [
        (1, 'Kite: "a small red kite rose above" 11.20', [p]), (2, "Costs `$12` and v1.2.3 and 9999", [p]), (3, "Nothing to look up", [p]), (4, 'Gone: "a small red kite rose above"', [dead]), (5, 'Wrong: "a large blue swan sank below the lake" $12', [p]), (6, "Only 11.20", [p]),
        (7, 'Far: "the quick red kite rose above" 4711 ms', [q]), (8, 'Mark: "Standard (ABC) 203 meant as the main rule"', [p]), (9, 'Both: "a small red kite rose above"', [dead, p]), (10, "No address 4711", []), (11, 'Thin: "a quotation that is nowhere at all"', ["https://thin.example/"]),
        (12, 'Velociraptor: "the measured rate reached 42 units in the trial"', ["https://subject.example/"]),
    ]
    found = _rows(s, cases, "sira int, iddia string, urls array<string>")
    pages = [(1, p, True, _PAGE, 1000, 1.0), (2, q, True, _FAR, 1000, 1.0), (3, dead, False, None, 0, 1.0), (4, "https://thin.example/", True, "short", 90_000, 1.0), (5, p + "?utm_source=x", True, "older", 10, 0.5), (6, "https://subject.example/", True, _SUBJECT, 10, 1.0)]
    return found, J.best_pages(_rows(s, pages, "kayit_no long, istenen_url string, ok boolean, markdown string, ham_bayt long, fetched_at double"))


_VERDICTS = [
    (1, "VERIFIED", 2, 2, []), (2, "PARTIAL", 2, 3, ["9999"]), (3, "NO_EVIDENCE", 0, 0, []), (4, "UNREACHABLE", 0, 0, None), (5, "NOT_FOUND", 1, 2, ["a large blue swan sank below the lake"]), (6, "PARTIAL", 1, 1, []), (7, "PARTIAL", 2, 2, []), (8, "PARTIAL", 0, 1, ["Standard (ABC) 203 meant as the main rule"]), (9, "VERIFIED", 1, 1, []), (10, "UNREACHABLE", 0, 0, []), (11, "UNREACHABLE", 0, 0, ["a quotation that is nowhere at all"]), (12, "PARTIAL", 1, 1, []),
]


@expect("sira, karar, bulunan, toplam, eksik", _VERDICTS)
def v_verdict_vectors(s, d):
    found, pages = _planted(s)
    return J.verify(found, cut(pages), ["sira"]).select("sira", "karar", "bulunan", "toplam", "eksik")


@expect("karar, n", [("VERIFIED", 2), ("PARTIAL", 5), ("NOT_FOUND", 1), ("UNREACHABLE", 3), ("NO_EVIDENCE", 1)])
def v_verdict_count_vectors(s, d):
    return v_verdict_vectors(s, d).groupBy("karar").agg(F.count("*").alias("n"))


@expect("sira, neden", [(7, True), (8, True), (12, True)])
def v_reason_vectors(s, d):
    found, pages = _planted(s)
    return J.verify(found, cut(pages), ["sira"]).where("neden is not null").select("sira", ((F.col("sira") == 7) & F.col("neden").startswith("number") | (F.col("sira") == 8) & F.col("neden").startswith("punctuation") | (F.col("sira") == 12) & F.col("neden").startswith("subject")).alias("neden"))


@expect("toplam, adresli, denenen, kanitsiz, adressiz, sinir_ustu", [(12, 11, 10, 1, 1, 0)])
def v_coverage_vectors(s, d):
    return J.coverage(_planted(s)[0])


# Notes.

NOTE = """# Topic
## Q1
### Özet
It took 12 ms in the end. There were 4096 of them. About 7777 more were seen.
### Alıntılı bulgular
- A "it took a while to get there" 12 ms — [x](https://a.example/)
- B says the same, aynı kaynak
- C has "4096 of them in the end" here — [y](https://b.example/)
### Çıkarımlar
- none
### Boşluklar
- gap one
## Q2
### Özet
Nothing to see here at all.
### Alıntılı bulgular
- D stands alone
### Çıkarımlar
- x
### Boşluklar
- y"""
EXTRA = NOTE + "\n## Q3\n### Özet\nsurplus"
_NOTES = "run_id string, slug string, dosya string, metin string"


def _note(s: SparkSession, *texts: str) -> DataFrame:
    return _rows(s, [("r", "s", f"{i}.md", t) for i, t in enumerate(texts)], _NOTES)


@expect("sira, soru_no, urls, devralan", [(0, 0, ["https://a.example/"], False), (1, 0, ["https://a.example/"], True), (2, 0, ["https://b.example/"], False), (3, 1, [], False)])
def p_finding_vectors(s, d):
    return N.findings(_note(s, NOTE), KEY).select("sira", "soru_no", "urls", "devralan")


@expect("etiket, yer, seviye", [("12 ms", "on_page", "info"), ("4096", "other_page", "warning"), ("7777", "nowhere", "warning")])
def v_support_vectors(s, d):
    note = NOTE.replace(" 12 ms — [x]", " — [x]").replace('"4096 of them in the end"', '"many of them in the end"').replace("- C has", "- C had").replace("- C had", "## Q9\n### Alıntılı bulgular\n- C had")
    n = _note(s, note)
    pages = _rows(s, [("https://a.example/", "12 ms it was"), ("https://b.example/", "4096 of them")], "sayfa_url string, sayfa string")
    return S.support(N.section_lines(n, KEY), N.findings(n, KEY), pages, KEY).select("etiket", "yer", "seviye")


@expect("dosya, atilan, uzunluk", [("0.md", 0, len(NOTE)), ("1.md", 1, len(NOTE) + 1), ("2.md", 0, len(EXTRA.replace("### Boşluklar\n- y", "")))])
def v_trim_vectors(s, d):
    plan = _rows(s, [("s", ["a", "b"])], "slug string, sorular array<string>")
    return R.trim_sections(_note(s, NOTE, EXTRA, EXTRA.replace("### Boşluklar\n- y", "")), plan, KEY).select("dosya", "atilan", F.length("metin").alias("uzunluk"))


@expect("dosya, isaretlenen, satir", [("0.md", 1, '- ⚠ [Anlam zayıf: ent=0.04 çelişki=0.70] A "it took a while to get there" 12 ms — [x](https://a.example/)')])
def v_mark_vectors(s, d):
    scores = _rows(s, [("r", "s", "0.md", 'A  "it took a while to get there" 12 ms — [x](https://a.example/)', 0.04, 0.7), ("r", "s", "0.md", "D stands alone", 0.5, 0.1)], "run_id string, slug string, dosya string, iddia string, ent double, con double")
    once = R.mark_weak_claims(_note(s, NOTE), scores, KEY)
    again = R.mark_weak_claims(once.select(*KEY, "metin"), scores, KEY).select(*KEY, F.col("isaretlenen").alias("twice"))
    return once.join(again, KEY).where("twice = 0").select("dosya", "isaretlenen", F.get(F.filter(F.split("metin", "\n"), lambda l: F.contains(l, F.lit("Anlam"))), 0).alias("satir"))


@expect("dosya, isaretlenen, satir", [("0.md", 1, "⚠ [kaynakta bulunamadı: 4096; 7777] It took 12 ms in the end. There were 4096 of them. About 7777 more were seen.")])
def v_unsupported_mark_vectors(s, d):
    issues = _rows(s, [("r", "s", "0.md", "There were 4096 of them.", "4096", "nowhere"), ("r", "s", "0.md", "About 7777 more were seen.", "7777", "nowhere"), ("r", "s", "0.md", "It took 12 ms in the end.", "12 ms", "on_page")], "run_id string, slug string, dosya string, cumle string, etiket string, yer string")
    return R.mark_unsupported(_note(s, NOTE), issues, KEY).select("dosya", "isaretlenen", F.get(F.filter(F.split("metin", "\n"), lambda l: F.contains(l, F.lit("kaynakta"))), 0).alias("satir"))


@expect("slug, devam", [("a", True), ("b", False), ("c", False), ("d", False)])
def v_resume_vectors(s, d):
    plan = _rows(s, [("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", "h4")], "slug string, ozet string")
    earlier = _rows(s, [("a", True, "h1"), ("b", True, "other"), ("c", False, "h3"), ("d", True, "h4")], "slug string, ok boolean, ozet string")
    return R.reusable(plan, earlier, _rows(s, [("a", None), ("b", None), ("c", None), ("d", "too short")], "slug string, neden string"))


@expect("slug, kaynak, en_yeni, alanlar", [("s", 3, 86400.0, ["a.example", "b.example"])])
def j_update_plan_vectors(s, d):
    notes = _rows(s, [("s", "[1](http://www.a.example/x) [2](https://b.example/) [3](https://a.example/x) [4](https://gone.example/)"), ("t", "no address")], "slug string, metin string")
    pages = _rows(s, [("https://a.example/x", 86400.0), ("https://b.example/", None), ("https://gone.example/", 5.0)], "url string, alindi double")
    return R.update_plan(notes, pages, _rows(s, [("https://a.example/x",), ("https://b.example/",)], "url string")).select("slug", "kaynak", "en_yeni", "alanlar")


@expect("cumle, oge, satir_sayisi", [("It took 12 ms in the end.", "12 ms", 1), ("There were 4096 of them.", "4096", 1)])
def v_referee_vectors(s, d):
    return R.referee_candidates(_note(s, NOTE), KEY).select("cumle", "oge", "satir_sayisi")


@expect("dosya, cikan, uzunluk", [("0.md", 1, len(NOTE) - len("- D stands alone\n"))])
def j_clean_vectors(s, d):
    v = _rows(s, [("r", "s", "0.md", "D stands alone", "NOT_FOUND", None), ("r", "s", "0.md", "B says the same, aynı kaynak", "VERIFIED", None)], "run_id string, slug string, dosya string, iddia string, karar string, neden string")
    return N.clean_lines(_note(s, NOTE), v, KEY).select("dosya", "cikan", F.length("metin").alias("uzunluk"))


@expect("satir, sayilar", [(3, ["4096"])])
def j_leftover_vectors(s, d):
    gone = _rows(s, [("r", "s", "0.md", "C has 4096 of them")], "run_id string, slug string, dosya string, iddia string")
    return N.leftover_mentions(gone, N.section_lines(_note(s, NOTE), KEY), KEY).select("satir", "sayilar")


@expect("k, a, b", [("x", 1, 11), ("x", 2, 12), ("x", 3, None), ("y", 4, 13)])
def j_order_vectors(s, d):
    left = _rows(s, [("x", 1), ("x", 2), ("x", 3), ("y", 4)], "k string, a int")
    right = _rows(s, [("x", 11), ("x", 12), ("y", 13), ("y", 14)], "k string, b int")
    return C.match_in_order(left, right, ["k"], ["a"], ["b"]).select("k", "a", "b")


@expect("satir, tur, metin", [(3, "paragraph", "first line second line"), (6, "bullet", "one continued"), (8, "bullet", "two"), (10, "quote", "a b"), (13, "table", "h | i"), (15, "table", "1 | 2")])
def p_report_item_vectors(s, d):
    text = "# Head\n\nfirst line\nsecond line\n\n- one\n  continued\n- two\n\n> a\n> b\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```\n- not this\n```"
    return S.report_items(_rows(s, [("r", text)], "id string, metin string"), ["id"]).select("satir", "tur", "metin")


@expect("no, v", [(0, "see https://kubernetes.io/docs now"), (1, "mail a@b.com/x"), (2, "https://a.example/b")])
def p_complete_url_vectors(s, d):
    return _texts(s, ["see kubernetes.io/docs now", "mail a@b.com/x", "https://a.example/b"], S.complete_urls)


@expect("oge, sorun, seviye", [("4711", "missing", "warning"), ("a quotation that stands nowhere", "missing", "error"), ("8888", "missing", "warning"), ("1234", "uncited", "info"), ("another quotation that is nowhere", "missing", "warning")])
def v_report_vectors(s, d):
    text = 'It was 4711 and "a quotation that stands nowhere" [x](https://a.example/)\n\nUnsourced 8888 and 1234, "another quotation that is nowhere", RFC 9309'
    items = S.report_items(_rows(s, [("r", text)], "id string, metin string"), ["id"])
    pages = _rows(s, [("https://a.example/", "the 1234 rows of the page")], "sayfa_url string, sayfa string")
    return S.check_report(items, pages, ["id"], pool=True).select("oge", "sorun", "seviye")


# Pages.


@expect("no, ok, uzunluk, basliklar", [(0, True, True, 1), (1, False, False, 0), (2, None, None, None)])
def p_html_vectors(s, d):
    long = "This is a real sentence of the article that has something to say about its subject. " * 6
    page = f"<title>T</title><nav>Menu</nav><main><h2>Part</h2><p>{long}</p></main><footer>Foot</footer>"
    return _texts(s, [page, "<p>short</p>", None], P.page_markdown).select("no", "v.ok", (F.length("v.markdown") > 400).alias("uzunluk"), F.size(P.outline(F.col("v.markdown"))).alias("basliklar")).withColumn("basliklar", F.when(F.col("ok").isNotNull(), F.col("basliklar")))


@expect("pasaj, baslik, sozcuk", [(0, "H", 60), (1, "H", 60), (2, "I", 110), (3, "I", 110), (4, "I", 110), (5, "I", 20)])
def p_reader_passage_vectors(s, d):
    md = "# H\n\n" + "word " * 60 + "\n\n" + "more " * 60 + "\n\n## I\n\n" + "x " * 350
    return P.with_passages(_rows(s, [(1, md)], "k int, markdown string")).select("pasaj", "baslik", F.size(F.split(F.trim("metin"), r"\s+")).alias("sozcuk"))


@expect("sira, uzunluk", [(0, 600), (1, 651), (2, 800), (3, 100)])
def p_vault_passage_vectors(s, d):
    text = "a" * 600 + "\n\n" + "b" * 600 + "\n \n" + "c" * 50 + "\n\n" + "d" * 900
    return _texts(s, [text], V.passages).select(F.posexplode("v").alias("sira", "m")).select("sira", F.length("m").alias("uzunluk"))


@expect("k, ifade, bulundu", [(1, "Red KITE", True), (1, "blue swan", False), (2, "Red KITE", False), (2, "blue swan", False)])
def r_phrase_vectors(s, d):
    return R.find_phrases(_rows(s, [(1, "A small **red**  kite"), (2, None)], "k int, markdown string"), ["Red KITE", "blue swan"], "k").select("k", "ifade", "bulundu")


@expect("k, secilen, pasaj, icerik", [(1, 1, 3, "### Two\n\nkite kite kite"), (2, 2, 2, "### A\n\nfirst text\n\n### B\n\nsecond text")])
def r_reader_vectors(s, d):
    pages = _rows(s, [(1, "# One\n\nnothing here\n\n# Two\n\nkite kite kite\n\n# Three\n\nmore text"), (2, "# A\n\nfirst text\n\n# B\n\nsecond text")], "k int, markdown string")
    return R.read_pages(pages, "k", 100, "kite").select("k", "secilen", "pasaj", "icerik")


@expect("pasajlar, no", [([1, 2], 0), ([7], 1)])
def r_budget_vectors(s, d):
    rows = _rows(s, [(0, [(2, 100), (0, 500), (1, 30)]), (1, [(7, 9000)])], "no int, r array<struct<i:int,tokens:int>>")
    return rows.select("no", V.budget_choice(F.col("r"), 150).alias("pasajlar"))


# Claims.

_CLAIMS = "slug string, run_id string, dosya string, sira int, iddia string, urls array<string>"


def _claims(s: SparkSession) -> DataFrame:
    a, b = ["https://www.a.example/x/"], ["https://b.example/"]
    rows = [
        ("t", "r1", "n", 0, "the archive keeps every signed ledger entry", a), ("t", "r2", "n", 0, "archive keeps every signed ledger entry there", b), ("t", "r1", "n", 1, "the archive keeps every signed ledger entry today", a), ("t", "r2", "n", 1, "speed reached 4711 units in trials", a), ("t", "r3", "n", 0, "speed reached 9999 units in trials", a),
        ("u", "r1", "n", 0, "the archive keeps every signed ledger entry", a),
    ]
    return cut(C.claim_features(_rows(s, rows, _CLAIMS), ["slug", "run_id", "dosya", "sira"]))


@expect("a, b", [("r1:0", "r2:0"), ("r1:1", "r2:0")])
def c_same_claim_vectors(s, d):
    p = C.same_claim_pairs(_claims(s), ["slug", "run_id", "dosya", "sira"])
    x, y = F.concat_ws(":", "a_run_id", "a_sira"), F.concat_ws(":", "b_run_id", "b_sira")
    return p.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


@expect("slug, destek, kume", [("t", 1, 3), ("t", 2, 1), ("u", 1, 1)])
def c_cluster_vectors(s, d):
    return C.cluster_statistics(C.clusters(_claims(s)))


@expect("slug, n", [("t", 1)])
def c_conflict_vectors(s, d):
    f = _claims(s)
    return C.conflicts(cut(C.clusters(f)), f).groupBy("slug").agg(F.count("*").alias("n"))


@expect("slug, n, uzun", [("t", 4, 1), ("u", 1, 0)])
def c_representative_vectors(s, d):
    f = _claims(s)
    r = C.representatives(cut(C.clusters(f)), f)
    return r.groupBy("slug").agg(F.count("*").alias("n"), F.count_if(F.col("iddia").endswith("today")).alias("uzun"))


def _facts(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    plan = _rows(s, [("t", [("Kite", r"red\s+kite"), ("Swan", "swan"), ("Rate", r"rate of \d+"), ("Lost", "unheard"), ("Gone", "unseen"), ("Late", "unknown")])], "slug string, olgular array<struct<ad:string,ara:string>>")
    claims = _rows(s, [("t", "r1", "A RED kite rose"), ("t", "r2", "the [swan](https://swan.example/red-kite) sank"), ("t", "r2", "a rate of 42 (2026-01, birincil)"), ("t", "r3", "see https://a.example/unheard")], "slug string, run_id string, iddia string")
    return C.facts(plan), claims


@expect("slug, no, run_id", [("t", 0, "r1"), ("t", 1, "r2"), ("t", 2, "r2")])
def j_fact_vectors(s, d):
    return C.fact_hits(*_facts(s))


@expect("slug, toplam, kapsanan, yuzde, eksik, calistirma", [("t", 6, 3, 50, ["Lost", "Gone", "Late"], ["r1:1", "r2:2", "r3:0"])])
def a_topic_coverage_vectors(s, d):
    known, claims = _facts(s)
    out = R.topic_coverage(known, C.fact_hits(known, claims), claims)
    return out.withColumn("calistirma", F.transform("calistirma", lambda x: F.concat_ws(":", x["run_id"], x["n"].cast("string"))))


@expect("slug, soru, olgular", [("t", 1, "Lost"), ("t", 2, "Gone"), ("t", 3, "Late")])
def a_follow_up_vectors(s, d):
    known, claims = _facts(s)
    return C.follow_up(known, C.fact_hits(known, claims))


@expect("sira", [(1,), (9,)])
def j_verified_vectors(s, d):
    found, pages = _planted(s)
    return R.verified(found, J.verify(found, cut(pages), ["sira"]), ["sira"]).select("sira")


@expect("sira, oncul, varsayim", [(1, True, "Kite: 11.20"), (2, False, "")])
def c_nli_vectors(s, d):
    found, pages = _planted(s)
    rows = J.verify(found, cut(pages), ["sira"]).join(found.select("sira", "iddia"), "sira").withColumn("run_id", F.lit("r")).withColumn("dosya", F.lit("n"))
    made = C.nli_pairs(rows, pages, 300, 8).where("sira = 1").select("sira", F.contains("premise", F.lit("a small red kite rose above")).alias("oncul"), F.col("hypothesis").alias("varsayim"))
    return made.unionByName(_rows(s, [(2, False, "")], "sira int, oncul boolean, varsayim string"))


@expect("run_id, tur, karar", [("a", 1, "continue"), ("a", 2, "stagnation"), ("b", 1, "continue"), ("b", 2, "done"), ("c", 1, "continue"), ("c", 2, "continue"), ("c", 3, "cap")])
def v_round_vectors(s, d):
    rows = [("a", 1, ["x"]), ("a", 2, ["x", "y"]), ("b", 1, ["x"]), ("b", 2, []), ("c", 1, ["x", "y", "z"]), ("c", 2, ["x", "y"]), ("c", 3, ["x"])]
    return R.round_decisions(_rows(s, rows, "run_id string, tur int, eksik array<string>"), ["run_id"])


@expect("not_, alan_adi, okunan_alan_adi, okunamayan, bagimsiz, kopya_grubu", [(3, 7, 6, 1, 4, 1)])
def a_independence_total_vectors(s, d):
    pages = [("https://a.example/1", "a.example", "g"), ("https://b.example/1", "b.example", "g"), ("https://c.example/1", "c.example", "h")]
    cited = [("n", "https://a.example/1"), ("n", "https://b.example/1"), ("n", "https://x.example/1"), ("m", "https://a.example/1"), ("m", "https://b.example/1"), ("k", "https://a.example/1"), ("k", "https://c.example/1")]
    return V.independence_totals(_rows(s, cited, "dosya string, url string"), _rows(s, pages, "url string, host string, grup string"), ["dosya"])


@expect("run_id, baslik, istenen, bosluk, kesik, siniflar, satir", [("r", 1, 2, 2, False, ["repository:1", "unknown:2"], 2)])
def a_report_profile_vectors(s, d):
    text = "# 1. Summary\n\nNorway: bulunamadı\nNorway is cold\nveri sınırlı https://a.example/x, https://github.com/a/b https://c.example."
    r = R.report_profile(_rows(s, [("r", text)], "run_id string, metin string"), ["run_id"], ["summary", "risks"], ["Norway"])
    return r.select("run_id", "baslik", "istenen", "bosluk", "kesik", F.transform("siniflar", lambda x: F.concat_ws(":", x["sinif"], x["n"].cast("string"))).alias("siniflar"), F.get("ulkeler", 0)["satir"].alias("satir"))


@expect("olcut, a, b", [("n", 1.0, 3.0), ("m", 2.0, None)])
def a_report_pivot_vectors(s, d):
    return R.by_report(_rows(s, [("a", 1, 2), ("b", 3, None)], "rapor string, n int, m int"), "rapor", ["n", "m"], ["a", "b"])


@expect("soru, arama, cagri, okuma", [(None, 3, 5, 2), (1, 3, 5, 2), (2, 4, 8, 4), (5, 7, 17, 6)])
def a_budget_vectors(s, d):
    return _rows(s, [(None,), (1,), (2,), (5,)], "soru int").select("soru", R.budgets(F.col("soru")).alias("b")).select("soru", "b.*")


# Logs.


@expect("k, metin, tamam, adim, arac, taze, cikti", [("a", "answer", True, 2, 1, 7, 4)])
def l_step_vectors(s, d):
    ev = ['{"type":"step_start"}', '{"type":"text","part":{"text":"thinking"}}', '{"type":"tool_use","part":{"tool":"read"}}', '{"type":"step_finish","part":{"reason":"tool-calls","tokens":{"input":5,"output":1}}}', "{broken", '{"type":"step_start"}', '{"type":"text","part":{"text":"answer"}}', '{"type":"step_finish","part":{"reason":"stop","tokens":{"input":2,"output":3}}}']
    return L.fold_steps(_rows(s, [("a", i, e) for i, e in enumerate(ev)], "k string, no int, satir string"), ["k"]).select("k", "metin", "tamam", "adim", "arac", "taze", "cikti")


@expect("k, metin, tamam, taze", [("a", "new", True, 3)])
def l_result_vectors(s, d):
    ev = ['{"type":"result","subtype":"error","result":"old"}', '{"type":"result","subtype":"success","result":"new","usage":{"input_tokens":3,"output_tokens":4}}']
    return L.fold_results(_rows(s, [("a", i, e) for i, e in enumerate(ev)], "k string, no int, satir string"), ["k"]).select("k", "metin", "tamam", "taze")


@expect("slug, deneme, taze, maliyet", [("s", 2, 4, 0.5), ("t", 1, 1, None)])
def l_attempt_vectors(s, d):
    rows = _rows(s, [("s", 1, 2, None), ("s", 3, 4, 0.5), ("t", 1, 1, None)], "slug string, taze long, cikti long, maliyet double")
    return L.attempts(rows, ["slug"]).select("slug", "deneme", "taze", "maliyet")
