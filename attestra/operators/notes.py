"""Research notes as rows: sections, findings, problems, clean copies, audits.

A note is split into lines once; headings are turned into running counters over the
lines of one note, so the only shuffle is by note. Null notes have no lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..runtime import bounded

# The sections of a note, in its language.
SECTIONS = ("Özet", "Alıntılı bulgular", "Çıkarımlar", "Boşluklar")
SUMMARY, QUOTED, INFERENCES, GAPS = SECTIONS
URL = r"\]\((https?://(?:[^()\s]|\([^()\s]*\))+)\)|(?<![(\[])\bhttps?://[^\s)<>\]]+"
BULLET = r"^(?:[-*]|\d+[.)])\s+"
SAME_SOURCE = r"(?iu)\b(a[yı]n[ıi]\s+kaynak|ayn[ıi]\s+sayfa|ayn[ıi]\s+belge|ibid)\b"
NO_SEARCH = r"(?iu)ECONNREFUSED|web[_ ]?search[^.\n]{0,60}(kapal|devre dışı|çalışm|erişilem|failed|unavailable)|web aramas[ıi][^.\n]{0,40}(kapal|devre dışı|yapılamad|çalışm)"
COMMUNITY = ("reddit.com", "quora.com", "medium.com", "blogspot.", "wordpress.com", "pinterest.", "facebook.com", "x.com", "twitter.com")
STRONG_NUMERIC = r"(%|\$|€|£|₺|\bTL\b|\bUSD\b|\bEUR\b|\bv?\d+\.\d+(\.\d+)?\b|\b(19|20)\d\d\b|\b\d{2,}\b)"
SHORT_NOTE, HEAD = 300, 1500


def bullet_urls(col: Column) -> Column:
    """Targets of links and bare addresses, in order."""
    found = F.regexp_extract_all(col, F.lit(URL), 0)
    bare = F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, r"^\]\((.*)\)$", "$1"), r"[.,;:`'\"*>]+$", ""))
    return bare


def section_lines(notes: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """One row for each line below a question's section (P01): ``soru_no`` and ``satir`` from 0, ``soru``, ``bolum``, ``metin``."""
    lines = notes.select(*key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("satir", "metin"))
    h2, h3 = F.col("metin").startswith("## "), F.col("metin").startswith("### ")
    w = Window.partitionBy(*key).orderBy("satir")
    lines = lines.withColumn("soru_no", F.sum(h2.cast("int")).over(w) - 1)
    wq = Window.partitionBy(*key, "soru_no").orderBy("satir")
    lines = lines.withColumn("soru", F.first(F.when(h2, F.trim(F.substring("metin", 4, 10000))), ignorenulls=True).over(wq))
    lines = lines.withColumn("bolum", F.last(F.when(h3, F.trim(F.substring("metin", 5, 10000))), ignorenulls=True).over(wq))
    return lines.where((F.col("soru_no") >= 0) & F.col("bolum").isNotNull() & ~h2 & ~h3).select(*key, "soru_no", "satir", "soru", "bolum", "metin")


def findings(notes: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Quoted findings (P02 to P04): ``soru_no``, ``sira`` from 0 in the note, ``iddia``, ``urls``, ``devralan``.

    A finding without an address that names the same source takes those of the finding
    before it in the same question, if that one has any; such chains are followed by
    counting the findings that do not inherit.
    """
    lines = section_lines(notes, key, text).where(F.col("bolum") == QUOTED).withColumn("t", F.trim("metin"))
    bullets = lines.where(F.col("t").rlike(BULLET) & ~F.col("t").rlike(r"^(?:```|\||>)"))
    body = F.trim(F.regexp_replace(F.regexp_replace("t", BULLET, ""), T.PREFIX, ""))
    rows = bullets.withColumn("iddia", body).where(~F.col("iddia").isin("", "—", "-")).withColumn("own", bullet_urls(F.col("iddia")))
    inherits = (F.size("own") == 0) & F.col("iddia").rlike(SAME_SOURCE)
    wq = Window.partitionBy(*key, "soru_no").orderBy("satir")
    rows = rows.withColumn("grup", F.sum((~inherits).cast("int")).over(wq))
    wg = Window.partitionBy(*key, "soru_no", "grup").orderBy("satir")
    head = F.first("own").over(wg)
    rows = rows.withColumn("urls", F.when(inherits, head).otherwise(F.col("own"))).withColumn("devralan", inherits & (F.size(head) > 0) & (F.col("grup") > 0))
    return rows.withColumn("sira", F.row_number().over(Window.partitionBy(*key).orderBy("satir")) - 1).select(*key, "soru_no", "soru", "sira", "iddia", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"), "devralan")


def note_problems(notes: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Structure of each note (P05): questions, missing sections, lines that are no bullets, emptiness, absent search."""
    lines = section_lines(notes, key, text)
    per = lines.groupBy(*key, "soru_no").agg(F.collect_set("bolum").alias("var"))
    missing = per.groupBy(*key).agg(F.count("*").alias("sorular"), F.sum(F.size(F.array_except(F.lit(list(SECTIONS)), F.col("var")))).alias("eksik_bolum"))
    t = F.trim("metin")
    odd = lines.where((F.col("bolum") == QUOTED) & (t != "") & ~t.isin("-", "- —", "* —", "—") & ~t.rlike(r"^(?:```|\||>)") & ~t.rlike(BULLET)).groupBy(*key).agg(F.count("*").alias("maddesiz"))
    base = notes.select(*key, (F.length(F.trim(F.coalesce(text, F.lit("")))) < SHORT_NOTE).alias("bos"), F.coalesce(F.substring(text, 1, HEAD).rlike(NO_SEARCH), F.lit(False)).alias("aramasiz"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(missing, key, "left").join(odd, key, "left").select(*key, zero("sorular"), zero("eksik_bolum"), zero("maddesiz"), "bos", "aramasiz")


def gap_lines(notes: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Bullets of the gaps section."""
    lines = section_lines(notes, key, text).where((F.col("bolum") == GAPS) & F.trim("metin").rlike(BULLET))
    return lines.select(*key, "soru_no", "satir", F.trim(F.regexp_replace(F.trim("metin"), BULLET, "")).alias("bosluk")).where(~F.col("bosluk").isin("", "—"))


def audit(found: DataFrame, key: list[str]) -> DataFrame:
    """Counts of a note's findings and sources (A05); one host for three findings or more is flagged."""
    by = found.select(*key, "sira", F.explode_outer("urls").alias("url"))
    h = F.when(F.col("url").isNotNull(), U.host(F.col("url")))
    counts = by.groupBy(*key).agg(
        F.count_distinct("sira").alias("bulgu"), F.count_distinct(F.when(F.col("url").isNull(), F.col("sira"))).alias("kaynaksiz"),
        F.count_distinct("url").alias("adres"), F.count_distinct(h).alias("alan_adi"), F.count_distinct(F.regexp_replace("url", "#.*$", "")).alias("belge"),
    )
    return counts.withColumn("tek_kaynak", (F.col("bulgu") >= 3) & (F.col("alan_adi") == 1))


def candidate_score(claim: Column, urls: Column, dead: Column | None = None) -> Column:
    """How much a finding is worth verifying (A06); null if it has no number or no source."""
    best = F.array_max(F.transform(urls, lambda u: U.trust_score(u)))
    community = F.exists(urls, lambda u: reduce(lambda a, b: a | b, (F.contains(U.host(u), F.lit(c)) for c in COMMUNITY)))
    points = [(claim.rlike(STRONG_NUMERIC), 3), (F.size(urls) == 1, 2), (community, 2), (best < 55, 2), (F.lower(claim).contains("ikincil"), 1)]
    if dead is not None:
        points.append((dead, -5))
    return F.when((F.size(urls) > 0) & claim.rlike(r"\d"), reduce(lambda a, b: a + b, (F.when(c, p).otherwise(0) for c, p in points)))


def contract(notes: DataFrame, plan: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The first reason why a note does not keep its contract, or null (V14): size, planning talk, questions, sections, sources."""
    need = plan.select("slug", F.size("sorular").alias("plan_soru"), F.coalesce(F.greatest(F.lit(3), F.least("min_url_required", F.lit(30))), F.lit(3)).alias("en_az"))
    urls = found.select(*key, F.explode("urls").alias("url")).groupBy(*key).agg(F.count_distinct("url").alias("adres"))
    shape = note_problems(notes, key)
    rows = notes.join(need, "slug", "left").join(urls, key, "left").join(shape, key, "left")
    head = F.substring("metin", 1, 1200)
    reason = F.coalesce(
        F.when(F.coalesce(F.octet_length("metin"), F.lit(0)) < 300, "too short"),
        F.when(F.regexp_replace(head, r"(?m)^#.*$", "").rlike(r"(?iu)\b(onayınız|onaylıyor musun|planım|I will now|shall I proceed|awaiting approval)\b"), "planning talk"),
        F.when(F.col("sorular") == 0, "no question"), F.when(F.col("plan_soru").isNotNull() & (F.col("sorular") < F.col("plan_soru")), "questions missing"),
        F.when(F.col("eksik_bolum") > 0, "sections missing"), F.when(F.coalesce("adres", F.lit(0)) < F.coalesce("en_az", F.lit(3)), "too few sources"),
    )
    return rows.select(*key, reason.alias("neden"))


def weak_notes(found: DataFrame, plan: DataFrame, key: list[str]) -> DataFrame:
    """Notes with fewer distinct sources than their plan asks for."""
    urls = found.select(*key, F.explode("urls").alias("url")).groupBy(*key).agg(F.count_distinct("url").alias("adres"))
    least = plan.select("slug", F.coalesce("min_url", "min_url_required", F.lit(8)).alias("en_az"))
    all_ = found.select(*key).distinct().join(urls, key, "left").join(bounded(least), "slug", "left")
    return all_.select(*key, F.coalesce("adres", F.lit(0)).alias("adres"), F.coalesce("en_az", F.lit(8)).alias("en_az")).where("adres < en_az")


def clean_lines(notes: DataFrame, verdicts: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Each note without the findings that were not found (J05, S16): the note's text rebuilt, and how many lines went.

    ``verdicts`` has ``iddia`` with white space collapsed, and ``karar``.
    """
    lines = notes.select(*key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("satir", "metin"))
    body = F.regexp_replace(F.regexp_replace(F.trim("metin"), BULLET, ""), T.PREFIX, "")
    lines = lines.withColumn("iddia", F.when(F.trim("metin").rlike(BULLET), F.trim(F.regexp_replace(body, T.S + "+", " "))))
    drop = verdicts.where("karar = 'NOT_FOUND'").select(*key, "iddia").distinct().withColumn("at", F.lit(True))
    partial = verdicts.where("karar = 'PARTIAL'").groupBy(*key, "iddia").agg(F.first(F.coalesce("neden", F.lit("partial evidence"))).alias("neden"))
    rows = lines.join(drop, [*key, "iddia"], "left").join(partial, [*key, "iddia"], "left")
    marked = F.when(F.col("neden").isNotNull() & ~F.regexp_replace(F.trim("metin"), BULLET, "").rlike(T.PREFIX), F.regexp_replace("metin", r"^(\s*(?:[-*]|\d+[.)])\s+)", F.concat(F.lit("$1⚠ [Kısmen: "), F.regexp_replace("neden", r"[\\$]", ""), F.lit("] ")))).otherwise(F.col("metin"))
    kept = F.array_sort(F.collect_list(F.when(F.col("at").isNull(), F.struct("satir", marked.alias("metin")))))
    out = rows.groupBy(*key).agg(kept.alias("k"), F.count("at").alias("cikan"))
    return out.select(*key, F.array_join(F.col("k.metin"), "\n").alias("metin"), F.col("cikan").cast("int").alias("cikan"))


def leftover_mentions(removed: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """Lines that still hold a rare number of a removed finding (J06): ``iddia`` and ``satir`` with the shared numbers."""
    a = removed.select(*key, "iddia", F.explode(T.rare_numbers(F.col("iddia"))).alias("sayi"))
    t = F.trim("metin")
    b = kept.where((t != "") & ~t.startswith("#") & ~t.rlike('["“]')).select(*key, "satir", F.explode(T.rare_numbers(t)).alias("sayi"))
    return a.join(b, [*key, "sayi"]).groupBy(*key, "iddia", "satir").agg(F.array_sort(F.collect_set("sayi")).alias("sayilar"))
