"""Rules around notes and reports: trimming, marking, reuse, updates, the reader, candidates of a referee, totals.

Everything is a DataFrame over keyed rows; null texts give null or no rows, repeated
rows count once where a result is a count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import notes as N
from . import pages as P
from . import support as S
from . import vault as V

# Bounds of a note, of hosts that are named, of lines that are quoted, and of what a reader shows.
NAMED_HOSTS, LINE_CHARS, HEADING_CHARS, HEADINGS, OUTLINE = 8, 420, 120, 25, 60
BROAD_ENTITIES = 6
# Errors that may pass, prohibitions that do not, phrases for gaps and for cut-off replies.
TRANSIENT = r"(?iu)toplam süre aşıldı|zaman aşımı|timed out|HTTP 5\d\d|HTTP 429|okunamadı \(ağ hatası\)|connection (?:reset|refused)"
FORBIDDEN = "izin vermiyor"
GAP = r"(?iu)bulunamadı|bulamadım|veri sınırlı|doğrulanamadı|teyit edilemedi|notlarda yok|bulgu yok"
TRUNCATED = r"Reply truncated at the model|output token limit|ÇIKTI MODEL ÇIKTI-TOKEN SINIRINDA KESİLDİ"
_LINES = r"\r\n|[\n\r]"
_FIRST_MARK = r"^(\s*(?:[-*+]|\d+[.)])\s+)"


def transient(error: Column) -> Column:
    """Whether reading a page may be tried once more (V08): time-outs, server errors and the like, never a prohibition."""
    return F.coalesce(error.rlike(TRANSIENT) & ~F.contains(error, F.lit(FORBIDDEN)), F.lit(False))


def budgets(questions: Column) -> Column:
    """(``arama``, ``cagri``, ``okuma``) of a light worker by its number of questions."""
    n = F.greatest(F.lit(1), F.coalesce(questions, F.lit(0)))
    return F.struct((n + 2).alias("arama"), (3 * n + 2).alias("cagri"), F.least(F.lit(6), F.greatest(F.lit(2), 2 * n)).alias("okuma"))


def broad_topics(plan: DataFrame) -> DataFrame:
    """Topics that list many entities (V17): ``slug``, ``varlik``."""
    parts = F.filter(F.split(F.coalesce("konu", F.lit("")), r"(?U),|;|\bve\b|/"), lambda x: F.trim(x) != "")
    return plan.select("slug", F.size(parts).alias("varlik")).where(F.col("varlik") >= BROAD_ENTITIES)


def trim_sections(notes: DataFrame, plan: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Each note without surplus questions at its end (V15): ``metin``, ``atilan``.

    Only where the planned questions come first with all four sections, and no fenced
    code holds a line that looks like a question; otherwise the note stays as it is.
    """
    want = plan.select("slug", F.size("sorular").alias("__want")).dropDuplicates(["slug"])
    w = Window.partitionBy(*key).orderBy("i")
    lines = notes.select(*key, F.posexplode(F.split(text, _LINES)).alias("i", "l"))
    fence = F.ltrim("l").rlike("^(?:```|~~~)")
    lines = lines.withColumn("fenced", (F.sum(fence.cast("int")).over(w) % 2 == 1) | fence).withColumn("head", F.col("l").startswith("## "))
    lines = lines.withColumn("no", F.sum(F.col("head").cast("int")).over(w))
    shape = lines.groupBy(*key).agg(F.max("no").alias("found"), F.bool_or(F.col("head") & F.col("fenced")).alias("odd"))
    full = N.section_lines(notes, key, text).groupBy(*key, "soru_no").agg(F.size(F.array_intersect(F.collect_set("bolum"), F.lit(list(N.SECTIONS)))).alias("n"))
    rows = shape.join(notes.select(*key, text), key).join(want, "slug", "left").where((F.col("__want") > 0) & (F.col("found") > F.col("__want")) & ~F.col("odd"))
    whole = rows.join(full, key).where("soru_no < __want and n = 4").groupBy(*key).agg(F.count("*").alias("whole"), F.first("__want").alias("__keep"), F.first("found").alias("__found")).where("whole = __keep")
    kept = lines.join(whole, key).where("no <= __keep").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]), "\n").alias("__t"), F.first(F.col("__found") - F.col("__keep")).alias("__gone"))
    out = notes.join(kept, key, "left")
    return out.select(*key, F.when(F.col("__t").isNotNull(), F.concat(F.regexp_replace("__t", r"\n+$", ""), F.lit("\n"))).otherwise(F.col(text)).alias(text), F.coalesce("__gone", F.lit(0)).cast("int").alias("atilan"))


def _rewritten(lines: DataFrame, key: list[str], changed: Column) -> DataFrame:
    marked = lines.withColumn("l2", F.coalesce(changed, F.col("l")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l2"))), lambda x: x["l2"]), "\n")
    return marked.groupBy(*key).agg(joined.alias("metin"), F.count_if(F.col("l") != F.col("l2")).cast("int").alias("isaretlenen"))


def mark_weak_claims(notes: DataFrame, scores: DataFrame, key: list[str], text: str = "metin", weak: float = 0.10, strong: float = 0.5) -> DataFrame:
    """Notes whose weakly supported findings carry a mark with their scores (J15), and how many lines were marked; marked lines stay as they are.

    ``scores``: key, ``iddia``, ``ent``, ``con``. A line is a claim's if its text without
    bullet and marks is the claim's, white space collapsed.
    """
    low = scores.where(F.col("ent") < weak).select(*key, F.trim(F.regexp_replace("iddia", T.S + "+", " ")).alias("iddia"), "ent", "con").groupBy(*key, "iddia").agg(F.min_by(F.struct("ent", "con"), "ent").alias("s"))
    lines = notes.select(*key, F.posexplode(F.split(text, _LINES)).alias("i", "l"))
    body = F.regexp_replace(F.regexp_replace(F.trim("l"), N.BULLET, ""), T.PREFIX, "")
    lines = lines.withColumn("iddia", F.when(F.trim("l").rlike(N.BULLET), F.trim(F.regexp_replace(body, T.S + "+", " ")))).join(low, [*key, "iddia"], "left")
    against = F.when(F.col("s.con") >= strong, F.concat(F.lit(" çelişki="), F.format_string("%.2f", "s.con"))).otherwise("")
    mark = F.concat(F.lit("⚠ [Anlam zayıf: ent="), F.format_string("%.2f", "s.ent"), against, F.lit("] "))
    front = r"^(\s*(?:[-*]|\d+[.)])\s+(?:⚠ \[Kısmen:[^\]]*\]\s*)?)"
    new = F.when(F.col("s").isNotNull() & ~F.contains("l", F.lit("Anlam zayıf:")), F.regexp_replace("l", front, F.concat(F.lit("$1"), mark)))
    return _rewritten(lines, key, new)


def mark_unsupported(notes: DataFrame, issues: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Notes whose lines carry the items that stand nowhere in the sources (J15), and how many lines were marked.

    ``issues`` is :func:`attestra.operators.support.support`; the lines are those of the
    checked sections that hold the sentence.
    """
    gone = issues.where("yer = 'nowhere'").select(*key, "cumle", "etiket").distinct()
    lines = notes.select(*key, F.posexplode(F.split(text, _LINES)).alias("i", "l"))
    checked = N.section_lines(notes, key, text).where(F.col("bolum").isin("Özet", "Çıkarımlar")).select(*key, F.col("satir").alias("i"), F.col("metin").alias("t"))
    hit = checked.join(gone, key).where(F.contains("t", F.col("cumle"))).groupBy(*key, "i").agg(F.array_join(F.array_sort(F.collect_set("etiket")), "; ").alias("o"))
    mark = F.concat(F.lit("⚠ [kaynakta bulunamadı: "), F.regexp_replace("o", r"[\\$]", ""), F.lit("] "))
    fresh = F.col("o").isNotNull() & ~F.contains("l", F.lit("⚠ [kaynakta bulunamadı:"))
    new = F.when(fresh, F.when(F.col("l").rlike(_FIRST_MARK), F.regexp_replace("l", _FIRST_MARK, F.concat(F.lit("$1"), mark))).otherwise(F.concat(mark, F.col("l"))))
    return _rewritten(lines.join(hit, [*key, "i"], "left"), key, new)


def reusable(plan: DataFrame, earlier: DataFrame, contracts: DataFrame) -> DataFrame:
    """Topics whose earlier note can be taken again (J16): ``slug``, ``devam``.

    ``plan``: ``slug``, ``ozet`` (a digest of what is asked); ``earlier``: ``slug``, ``ok``,
    ``ozet`` of the last run; ``contracts``: ``slug``, ``neden`` of the notes that exist.
    """
    last = earlier.select("slug", F.col("ok").alias("__ok"), F.col("ozet").alias("__ozet"))
    kept = contracts.where("neden is null").select("slug", F.lit(True).alias("__kept")).distinct()
    again = F.col("__ok") & (F.col("ozet") == F.col("__ozet")) & F.col("__kept")
    return plan.join(last, "slug", "left").join(kept, "slug", "left").groupBy("slug").agg(F.bool_or(F.coalesce(again, F.lit(False))).alias("devam"))


def update_plan(notes: DataFrame, pages: DataFrame, cached: DataFrame, stale_days: int = V.STALE_DAYS) -> DataFrame:
    """For each topic what its earlier note read (J11): ``slug``, ``kaynak`` (occurrences), ``en_yeni`` (epoch seconds), ``alanlar`` (the first hosts in order), ``cumle``.

    An address counts if the vault (``pages``: ``url``, ``alindi``) and the earlier cache
    (``cached``: ``url``) have it; topics without any are left out.
    """
    known = pages.select(U.canonical(F.col("url")).alias("u"), F.coalesce("alindi", F.lit(0.0)).alias("t")).where("u <> ''").groupBy("u").agg(F.max("t").alias("t")).join(cached.select(U.canonical(F.col("url")).alias("u")).distinct(), "u", "left_semi")
    cited = notes.select("slug", F.posexplode(N.bullet_urls(F.col("metin"))).alias("i", "url")).withColumn("u", U.canonical(F.col("url"))).join(known, "u")
    h = cited.withColumn("h", U.host(F.col("u"))).groupBy("slug", "h").agg(F.min("i").alias("i"), F.count("*").alias("n"), F.max("t").alias("t"))
    out = h.groupBy("slug").agg(F.sum("n").alias("kaynak"), F.max("t").alias("en_yeni"), F.array_sort(F.collect_list(F.struct("i", "h"))).alias("s"))
    out = out.select("slug", "kaynak", "en_yeni", F.slice(F.transform("s", lambda x: x["h"]), 1, NAMED_HOSTS).alias("alanlar"))
    day = F.date_format(F.timestamp_seconds("en_yeni"), "yyyy-MM-dd")
    said = F.format_string(
        f"GÜNCELLEME KİPİ: bu konuda daha önce %d kaynak okundu (en yeni %s); yeni gelişmelere ve {stale_days} günden eski kaynakların değişip değişmediğine odaklan, aynı kaynakları baştan tarama. Önceki kaynaklar: %s",
        "kaynak", day, F.array_join("alanlar", ", "),
    )
    return out.withColumn("cumle", said)


# The reader.


def find_phrases(pages: DataFrame, phrases: list[str], key: str, text: str = "markdown") -> DataFrame:
    """Whether each phrase stands on each page, with what stands around it (X7): key, ``ifade``, ``bulundu``, ``baglam``."""
    asked = F.explode(F.array(*(F.lit(p) for p in phrases))).alias("ifade") if phrases else F.explode(F.array().cast("array<string>")).alias("ifade")
    rows = pages.select(key, T.phrase_norm(F.col(text)).alias("t"), asked)
    at = F.instr("t", T.phrase_norm(F.col("ifade")))
    return rows.withColumn("at", F.when(T.phrase_norm(F.col("ifade")) != "", at).otherwise(0)).select(key, "ifade", F.coalesce(F.col("at") > 0, F.lit(False)).alias("bulundu"), F.when(F.col("at") > 0, F.substring("t", F.greatest(F.lit(1), F.col("at") - 80), F.length("ifade") + 160)).alias("baglam"))


def read_pages(pages: DataFrame, key: str, tokens: int = 1200, question: str | None = None, outline: bool = False, whole: bool = False, text: str = "markdown") -> DataFrame:
    """What a reader gets of each page (X7): key, ``tam_jeton``, ``iz`` (signs of injection), ``anahat``, ``icerik``, ``secilen``, ``pasaj``.

    Outline before whole page before passages. A whole page is cut at its budget;
    passages are chosen by rank for ``question``, or in order where there is none or
    nothing matches, within the budget, and shown in the order of the page.
    """
    md = F.col(text)
    base = pages.select(key, text).dropDuplicates([key])
    head = base.select(key, T.token_estimate(md).alias("tam_jeton"), T.injection_count(md).alias("iz"), P.outline(md, OUTLINE).alias("anahat"), md.alias("__t"))
    none = F.lit(None).cast("int")
    if outline:
        return head.select(key, "tam_jeton", "iz", "anahat", F.lit(None).cast("string").alias("icerik"), none.alias("secilen"), none.alias("pasaj"))
    if whole:
        cut_off = F.concat(F.substring("__t", 1, tokens * 4), F.lit("\n\n[…]"))
        return head.select(key, "tam_jeton", "iz", "anahat", F.when(F.length("__t") > tokens * 4, cut_off).otherwise(F.col("__t")).alias("icerik"), none.alias("secilen"), none.alias("pasaj"))
    items = P.with_passages(base.withColumnRenamed(text, "markdown").select(key, "markdown")).withColumn("__id", F.concat_ws(":", F.col(key).cast("string"), "pasaj"))
    terms = question_terms(question)
    scored = V.bm25(items, terms, "__id", P.search_text(F.col("baslik"), F.col("metin")), within=[key]).select("__id", "skor") if terms else items.select("__id", F.lit(0.0).alias("skor")).limit(0)
    rows = items.join(scored, "__id", "left").withColumn("tokens", T.token_estimate(F.col("metin")))
    ranked = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(x["i"].alias("i"), x["tokens"].alias("tokens")))
    hits = ranked(F.when(F.col("skor").isNotNull(), F.struct((-F.col("skor")).alias("s"), F.col("pasaj").alias("i"), "tokens")))
    every = ranked(F.struct(F.col("pasaj").alias("i"), "tokens"))
    texts = F.array_sort(F.collect_list(F.struct(F.col("pasaj").alias("i"), "baslik", "metin")))
    by = rows.groupBy(key).agg(hits.alias("__h"), every.alias("__e"), texts.alias("__t"), F.count("*").cast("int").alias("pasaj"))
    by = by.withColumn("__c", V.budget_choice(F.when(F.size("__h") > 0, F.col("__h")).otherwise(F.col("__e")), tokens))
    by = by.withColumn("__k", F.filter("__t", lambda x: F.array_contains("__c", x["i"])))
    shown = F.transform("__k", lambda x, i: F.concat_ws("\n\n", F.when((x["baslik"] != "") & ((i == 0) | (F.get("__k", i - 1)["baslik"] != x["baslik"])), F.concat(F.lit("### "), x["baslik"])), x["metin"]))
    body, cap = F.array_join(shown, "\n\n"), int(tokens * 1.3) * 4
    by = by.select(key, F.when(F.length(body) > cap, F.concat(F.substring(body, 1, cap), F.lit("\n[…]"))).otherwise(body).alias("icerik"), F.size("__c").alias("secilen"), "pasaj")
    short = F.slice(F.filter("anahat", lambda h: F.length(h) < HEADING_CHARS), 1, HEADINGS)
    return head.join(by, key, "left").select(key, "tam_jeton", "iz", short.alias("anahat"), "icerik", "secilen", "pasaj")


def question_terms(question: str | None) -> list[str]:
    """The search tokens of a question, as :func:`attestra.functions.text.search_tokens` finds them."""
    import re

    return sorted({t for t in re.findall(r"\w[\w.\-+%/]*", (question or "").lower()) if len(t) > 1 and t not in T.STOP_WORDS})


# Candidates and scores.


def referee_candidates(notes: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Sentences whose number or identifier stands in a finding of the same question (X6): key, ``soru_no``, ``cumle``, ``oge``, ``satir`` (the first such finding, cut), ``satir_sayisi``."""
    lines = N.section_lines(notes, key, text)
    own = lines.where(F.col("bolum").isin("Özet", "Çıkarımlar")).select(*key, "soru_no", F.explode(S.sentences(F.col("metin"))).alias("cumle")).distinct()
    wanted = own.withColumn("i", F.explode(S.items(F.col("cumle")))).where(F.col("i.tur").isin("number", "identifier"))
    found = N.findings(notes, key, text).select(*key, "soru_no", "sira", "iddia", T.norm(F.col("iddia"), False).alias("n"))
    met = wanted.join(found, [*key, "soru_no"]).where(S.present(F.col("i"), F.col("n")))
    bare = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("r.iddia", T.CITATION, " "), T.LINK, "$1"), r"\s+", " ")), 1, LINE_CHARS)
    by = met.groupBy(*key, "soru_no", "cumle", F.col("i.etiket").alias("oge")).agg(F.min_by(F.struct("iddia"), "sira").alias("r"), F.count_distinct("sira").alias("satir_sayisi"))
    return by.select(*key, "soru_no", "cumle", "oge", bare.alias("satir"), "satir_sayisi")


def scored_pairs(pairs: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Pairs with their scores (J14); a pair without one is an error when the rows are read."""
    joined = pairs.join(scores.withColumn("__s", F.lit(True)), key, "left")
    checked = F.when(F.col("__s").isNull(), F.raise_error(F.concat(F.lit("no score for "), F.to_json(F.struct(*key))))).otherwise(F.col("ent"))
    return joined.withColumn("ent", checked.cast("double")).drop("__s")


def verified(found: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """The findings that are verified (J03), each at most once."""
    return found.join(verdicts.where("karar = 'VERIFIED'").select(*key).distinct(), key, "left_semi")


def fact_rows(known: DataFrame, hits: DataFrame) -> DataFrame:
    """Each expected fact with the runs that cover it (A10): ``slug``, ``no``, ``ad``, ``kapsayan``."""
    runs = hits.groupBy("slug", "no").agg(F.array_sort(F.collect_set("run_id")).alias("kapsayan"))
    return known.join(runs, ["slug", "no"], "left").select("slug", "no", "ad", F.coalesce("kapsayan", F.array().cast("array<string>")).alias("kapsayan"))


def topic_coverage(known: DataFrame, hits: DataFrame, runs: DataFrame) -> DataFrame:
    """Coverage of each topic in full (A10): ``toplam``, ``kapsanan``, ``yuzde``, ``calistirma`` (covered facts of each run, runs without any too), ``eksik`` (names in order)."""
    rows = fact_rows(known, hits)
    by = rows.groupBy("slug").agg(
        F.count("*").alias("toplam"), F.count_if(F.size("kapsayan") > 0).alias("kapsanan"),
        F.transform(F.array_sort(F.collect_list(F.when(F.size("kapsayan") == 0, F.struct("no", "ad")))), lambda x: x["ad"]).alias("eksik"),
    )
    each = runs.select("slug", "run_id").distinct().join(hits.groupBy("slug", "run_id").agg(F.count_distinct("no").alias("n")), ["slug", "run_id"], "left")
    per = each.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("run_id", F.coalesce("n", F.lit(0)).alias("n")))).alias("calistirma"))
    return by.join(per, "slug", "left").withColumn("yuzde", F.floor(100 * F.col("kapsanan") / F.col("toplam")).cast("int"))


def best_of_hosts(cited: DataFrame, order: list[str]) -> DataFrame:
    """The best-scored address of each host (A04), of equal ones the first in ``order``: ``alan``, ``url``, ``sinif``, ``puan``, ``ortalama`` over hosts. ``cited``: ``url``, order, optionally ``planli``."""
    planned = F.col("planli") if "planli" in cited.columns else None
    rows = cited.withColumn("alan", U.host(F.col("url"))).withColumn("puan", U.trust_score(F.col("url"), planned)).where("alan <> ''")
    best = rows.groupBy("alan").agg(F.min(F.struct((-F.col("puan")).alias("p"), *order, "url")).alias("r")).select("alan", F.col("r.url").alias("url"), U.trust_class(F.col("alan"))["class"].alias("sinif"), (-F.col("r.p")).alias("puan"))
    return best.crossJoin(best.agg(F.round(F.avg("puan"), 6).alias("ortalama")))  # one row


def stale_dates(found: DataFrame, year: int, month: int, claim: str = "iddia", months: int = 18) -> DataFrame:
    """One row about findings whose stated date is old (A04): ``n``, ``ilk``, ``son``."""
    tag = T.citation_tag(F.col(claim))
    day = F.format_string("%04d-%02d", tag["year"], tag["month"])
    return found.where(T.age_months(tag, year, month) >= months).agg(F.count("*").alias("n"), F.min(day).alias("ilk"), F.max(day).alias("son"))


def report_profile(reports: DataFrame, key: list[str], headings: list[str], countries: list[str], text: str = "metin") -> DataFrame:
    """More about each report (A19): headings asked for and found, sources by class, phrases for gaps, whether it is cut off, lines on each country and those with gaps."""
    lines = F.split(text, "\n")
    quoted = lambda h: r"(?imu)^#{1,4}\s*(?:\d+\.\s*)?\Q" + h.replace("\\E", "") + r"\E"
    found = reduce(lambda a, b: a + b, (F.col(text).rlike(quoted(h)).cast("int") for h in headings), F.lit(0))
    urls = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s)<>\]]+"), 0), lambda u: F.regexp_replace(u, "[.,;]+$", "")))
    kinds = F.transform(urls, lambda u: U.trust_class(U.host(u))["class"])
    histogram = F.array_sort(F.transform(F.array_distinct(kinds), lambda c: F.struct(c.alias("sinif"), F.size(F.filter(kinds, lambda k: k == c)).alias("n"))))
    on = lambda c: F.filter(lines, lambda l: F.contains(l, F.lit(c)))
    land = F.array(*(F.struct(F.lit(c).alias("ulke"), F.size(on(c)).alias("satir"), F.size(F.filter(on(c), lambda l: l.rlike(GAP))).alias("bosluk")) for c in countries)) if countries else F.array().cast("array<struct<ulke:string,satir:int,bosluk:int>>")
    return reports.select(*key, found.alias("baslik"), F.lit(len(headings)).alias("istenen"), histogram.alias("siniflar"), F.regexp_count(text, F.lit(GAP)).alias("bosluk"), F.col(text).rlike(TRUNCATED).alias("kesik"), land.alias("ulkeler"))


def by_report(metrics: DataFrame, name: str, measures: list[str], reports: list[str]) -> DataFrame:
    """Measures as rows, reports as columns (A19), for a named list of reports."""
    long = metrics.where(F.col(name).isin(*reports)).select(F.col(name).alias("__r"), F.explode(F.array(*(F.struct(F.lit(m).alias("olcut"), F.col(m).cast("double").alias("v")) for m in measures))).alias("x")).select("__r", "x.*")
    return long.groupBy("olcut").pivot("__r", reports).agg(F.first("v"))


def round_decisions(rounds: DataFrame, key: list[str], cap: int = 3) -> DataFrame:
    """Whether each gap round is followed by another (V18, ST7): key, ``tur`` from 1, ``karar``. ``rounds``: key, ``tur``, ``eksik`` (what is missing after it)."""
    before = F.lag("eksik").over(Window.partitionBy(*key).orderBy("tur"))
    word = F.when(F.size("eksik") == 0, "done").when(before.isNotNull() & (F.size(F.array_except(before, "eksik")) == 0), "stagnation").when(F.col("tur") >= cap, "cap").otherwise("continue")
    return rounds.select(*key, "tur", word.alias("karar"))


def injection_flags(rows: DataFrame, text: str = "markdown") -> DataFrame:
    """``rows`` with ``enjeksiyon``: whether a page's text speaks to a model."""
    return rows.withColumn("enjeksiyon", F.coalesce(T.injection_count(F.col(text)) > 0, F.lit(False)))
