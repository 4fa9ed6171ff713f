"""Whether the concrete items of a note's own sentences stand on its pages, and reports likewise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..runtime import let
from . import verdict as J

# Month names (Turkish, English), documents' series, common abbreviations.
MONTHS_TR = "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
MONTHS_EN = "january february march april may june july august september october november december".split()
SERIES = "RFC FIPS PEP JEP KEP CVE CWE CAPEC BCP ISO(?:/IEC)? IEC SP STD".split()
COMMON_ACRONYMS = "ABD AB TL USD EUR API URL HTTP HTTPS JSON HTML CSS PDF SSL AND THE TBD OK ILE ICIN".split()
HTTP_STATUS = "400 401 403 404 410 429 500 502 503 504".split()
GENERIC = "2024 2025 2026 2027 2028".split()

_MONTH = "|".join(sorted(MONTHS_TR + MONTHS_EN, key=len, reverse=True))
_YEAR, _VALUE = r"(?:19|20)\d\d", r"\d+(?:[.,]\d+)?"
# What is set aside, and the forms of dates, documents, identifiers, abbreviations and amounts.
_AWAY = rf'(?iU){T.LINK}|https?://\S+|\([^()]*\b(?:birincil|ikincil)\b[^()]*\)|"[^"]*"|[“«][^”»]*[”»]|`[^`]*`'
_DATE = (
    rf"(?iu)\d{{1,2}}\s+(?:{_MONTH}){T.W}*\s+{_YEAR}|(?:{_MONTH}){T.W}*\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+{_YEAR}|(?:{_MONTH}){T.W}*\s+{_YEAR}"
    rf"|{_YEAR}-(?:0[1-9]|1[0-2])(?:-\d\d)?(?!\d)"
)
_DOCUMENT = rf"(?i)(?<![\p{{L}}\p{{N}}_-])(?:{'|'.join(SERIES)})[\s-]*\d+(?:[.-]\d+)*"
_IDENTIFIER = r"(?<![\p{L}\p{N}_.-])(?=[\p{L}\p{N}_-]*\d)(?=[\p{L}\p{N}_-]*[A-Za-z])[A-Za-z0-9][\p{L}\p{N}_-]*(?![\p{L}\p{N}_])"
_ACRONYM = r"(?<![\p{L}\p{N}_-])[A-Z][A-Z0-9]{2,}(?:-[A-Z0-9]+)*(?![\p{L}\p{N}_-])"
_AMOUNT = (
    rf"(?i:{_VALUE}\s?(?:KB|MB|GB)(?!{T.W}))|%\s?{_VALUE}(?:\s?[-–]\s?{_VALUE})?|{_VALUE}\s?[-–]\s?{_VALUE}\s?%?|\d+(?:[.,]\d+)+|\d{{3,}}"
    rf"|\d+\s?(?:x|×|%|kat|ms|sn|saniye|TL|USD|EUR)(?!{T.W})"
)


def items(sentence: Column) -> Column:
    """Dates, document numbers, identifiers, abbreviations and amounts of a sentence (T14), as structs (tur, etiket, ara, y, m, d).

    What one kind takes is blanked for the kinds after it; of items with the same key the first counts.
    """
    kinds, rest = [], F.regexp_replace(sentence, _AWAY, " ")

    def take(pattern: str, name: str, key, keep=None) -> None:
        nonlocal rest
        found = F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), key)
        made = F.transform(found, lambda x: F.struct(F.lit(name).alias("tur"), x["etiket"].alias("etiket"), x["ara"].alias("ara"), x["y"].alias("y"), x["m"].alias("m"), x["d"].alias("d")))
        kinds.append(F.filter(made, keep) if keep else made)
        if name in ("date", "identifier"):
            rest = F.regexp_replace(rest, pattern, " ")

    def item(label: Column, key: Column, y=None, m=None, d=None) -> Column:
        none = F.lit(None)
        return F.struct(label.alias("etiket"), key.alias("ara"), (none.cast("string") if y is None else y).alias("y"), (none.cast("int") if m is None else m).alias("m"), (none.cast("int") if d is None else d).alias("d"))

    def date(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, rf"(?iu)({_MONTH})", 1))
        place = lambda names: F.array_position(F.lit(names), name)
        iso = F.regexp_extract(t, r"^\d{4}-(\d\d)", 1)
        m = F.when(iso != "", iso.cast("int")).otherwise(F.greatest(place(MONTHS_TR), place(MONTHS_EN)).cast("int"))
        y = F.when(iso != "", F.substring(t, 1, 4)).otherwise(F.regexp_extract(t, rf"({_YEAR})$", 1))
        day = F.when(iso != "", F.regexp_extract(t, r"^\d{4}-\d\d-(\d\d)$", 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d{1,2})\s", 1), F.lit("")), F.regexp_extract(t, r"\s(\d{1,2})(?:st|nd|rd|th)?,?\s", 1)))
        return item(F.trim(t), F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), day), y, m, F.nullif(day, F.lit("")).cast("int"))

    def named(t: Column) -> Column:
        label = F.regexp_replace(t, r"\s+", " ")
        return item(label, label)

    take(_DATE, "date", date)
    take(_DOCUMENT, "identifier", named)
    take(_IDENTIFIER, "identifier", named)
    take(_ACRONYM, "acronym", lambda t: item(t, t), lambda x: ~x["ara"].isin(*COMMON_ACRONYMS))
    take(_AMOUNT, "number", lambda t: item(F.trim(t), F.regexp_replace(F.translate(F.lower(t), "–×", "-x"), r"\s+", "")), lambda x: ~x["ara"].isin(*GENERIC, *HTTP_STATUS))
    return let(F.concat(*kinds), lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~F.exists(F.slice(all_, 1, i), lambda y: (y["tur"] == x["tur"]) & (y["ara"] == x["ara"]))))


def of_day(item: Column, day: Column) -> Column:
    """Whether a date is the day of a run or a note, or its month where it names no day (T15); such items are not checked."""
    same = (item["y"] == F.year(day).cast("string")) & (item["m"] == F.month(day))
    return F.coalesce((item["tur"] == "date") & same & (item["d"].isNull() | (item["d"] == F.dayofmonth(day))), F.lit(False))


def sentences(col: Column) -> Column:
    """Sentences of prose lines (P08): after closing marks before a capital, a quotation or a bracket; 12 characters at least."""
    body = F.regexp_replace(F.trim(col), r"^(?:[-*]|\d+[.)])\s+", "")
    return F.filter(F.split(body, r"(?<=[.!?])\s+(?=[\p{Lu}\"“(])"), lambda s: (F.length(s) >= 12) & ~body.rlike(r"^[|#>]"))


def _any(col: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp(col, pattern), F.lit(False))


def present(item: Column, page: Column) -> Column:
    """Whether an item stands on a normalised page."""
    months = [MONTHS_TR[i] + "|" + MONTHS_EN[i] + "|" + MONTHS_EN[i][:3] for i in range(12)]
    names = F.element_at(F.array(*(F.lit(m) for m in months)), F.coalesce(item["m"], F.lit(1)))
    two = F.lpad(item["m"].cast("string"), 2, "0")
    month = _any(page, F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), names, F.lit(")(?![a-z])"))) | F.contains(page, F.concat(item["y"], F.lit("-"), two)) | F.contains(page, F.concat(two, F.lit("/"), item["y"]))
    day = item["d"].isNull() | _any(page, F.concat(F.lit(r"(?<!\d)"), item["d"].cast("string"), F.lit(r"(?!\d)")))
    date = F.contains(page, item["y"]) & month & day
    loose = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(item["ara"]), r"([.\\+*?\[\]^$(){}|])", r"\\$1"), "-", r"[-\\s]?"), " ", r"[-\\s]*")
    # Plain searches for what every match holds come before patterns.
    head = F.contains(page, F.regexp_extract(F.lower(item["ara"]), r"^[^\s-]*", 0))
    identifier = head & _any(page, F.concat(F.lit(r"(?<![\p{L}\p{N}_-])"), loose, F.lit(r"(?![\p{L}\p{N}_])")))
    ends = F.regexp_extract_all(item["ara"], F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    percent = F.when(F.contains(item["ara"], F.lit("%")), "%").otherwise("")
    both = item["ara"].rlike(r"^%?\d+(?:[.,]\d+)?-\d+(?:[.,]\d+)?%?$") & F.forall(ends, lambda e: _any(page, T.number_pattern(F.concat(percent, e))))
    unit = F.regexp_extract(item["ara"], r"^\d+(?:[.,]\d+)?(kb|mb|gb)$", 1)
    value = F.regexp_replace(F.regexp_extract(item["ara"], r"^(\d+(?:[.,]\d+)?)", 1), ",", ".")
    power = F.when(unit == "kb", 1).when(unit == "mb", 2).otherwise(3)
    near = F.lit(0.5) / F.pow(F.lit(10), F.length(F.regexp_extract(value, r"\.(\d+)$", 1)))
    bytes_ = F.transform(F.regexp_extract_all(page, F.lit(r"(?<![\p{L}\p{N}_.,])\d{1,3}(?:,\d{3})+(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_.,])\d{3,}(?![\p{L}\p{N}_.,])"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "").try_cast("double"))
    derived = (unit != "") & F.exists(bytes_, lambda n: (F.abs(n / F.pow(F.lit(1000.0), power) - value.try_cast("double")) <= near) | (F.abs(n / F.pow(F.lit(1024.0), power) - value.try_cast("double")) <= near))
    number = (F.contains(page, T.first_digits(item["ara"])) & (_any(page, T.number_pattern(item["ara"])) | both)) | F.coalesce(derived, F.lit(False))
    return F.when(item["tur"] == "date", date).when(item["tur"].isin("identifier", "acronym"), identifier).otherwise(number)


def support(lines: DataFrame, found: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Items of summaries and inferences that the note's quotations do not hold, by where they stand instead.

    ``on_page``: on a page of the same question; ``other_page``: of another question;
    ``nowhere``; ``unreadable_page_present`` if some page could not be read.
    """
    own = lines.where(F.col("bolum").isin("Özet", "Çıkarımlar")).select(*key, "soru_no", F.explode(sentences(F.col("metin"))).alias("cumle")).distinct()
    wanted = own.withColumn("i", F.explode(items(F.col("cumle"))))
    if "gun" in lines.columns:  # the day of a note is no claim (T15)
        wanted = wanted.join(lines.select(*key, "gun").distinct(), key).where(~of_day(F.col("i"), F.col("gun"))).drop("gun")
    quoted = found.groupBy(*key, "soru_no").agg(T.norm(F.array_join(F.collect_list("iddia"), " "), False).alias("alinti"))
    cited = found.select(*key, "soru_no", F.explode("urls").alias("url")).distinct().withColumn("sayfa_url", U.canonical(F.col("url"))).join(pages.select("sayfa_url", "sayfa"), "sayfa_url", "left")
    here = wanted.join(quoted, [*key, "soru_no"], "left").where(~present(F.col("i"), F.coalesce("alinti", F.lit(""))))
    # Each item meets each page of its note once, however many sentences and questions name either; presence is reduced to a flag there.
    pairs = here.select(*key, "i").distinct().join(cited.select(*key, "sayfa_url", "sayfa").distinct(), key)
    on = pairs.select(*key, "i", "sayfa_url", F.coalesce(present(F.col("i"), F.col("sayfa")), F.lit(False)).alias("__on"))
    spots = cited.select(*key, F.col("soru_no").alias("sayfa_soru"), "sayfa_url", F.col("sayfa").isNotNull().alias("__read"))
    met = here.join(spots, key, "left").join(on, [*key, "i", "sayfa_url"], "left")
    ok = F.coalesce("__on", F.lit(False))
    same = F.col("sayfa_soru") == F.col("soru_no")
    flags = met.groupBy(*key, "soru_no", "cumle", "i").agg(F.bool_or(ok & same).alias("burada"), F.bool_or(ok & ~same).alias("baska"), F.bool_or(same & F.coalesce("__read", F.lit(False))).alias("okundu"), F.bool_or(~F.coalesce("__read", F.lit(False))).alias("okunmadi"))
    tier = F.when(F.col("burada"), "on_page").when(~F.coalesce("okundu", F.lit(False)), None).when(F.col("baska"), "other_page").when(F.col("okunmadi"), "unreadable_page_present").otherwise("nowhere")
    rows = flags.withColumn("yer", tier).where("yer is not null").where((F.col("i.tur") != "acronym") | F.col("yer").isin("nowhere", "unreadable_page_present"))
    level = F.when(F.col("yer").isin("on_page", "unreadable_page_present"), "info").otherwise("warning")
    return rows.select(*key, "soru_no", "cumle", F.col("i.tur").alias("tur"), F.col("i.etiket").alias("etiket"), "yer", level.alias("seviye"))


def severity(issues: DataFrame) -> DataFrame:
    """Issues by level."""
    return issues.groupBy("seviye").agg(F.count("*").alias("n"))


def collapse_messages(issues: DataFrame, order: str) -> DataFrame:
    """Issues that differ only in their number, as one with all numbers in order."""
    return issues.groupBy("madde", "seviye", "tur", "mesaj").agg(F.min(order).alias("ilk"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, "sayi"))), lambda x: x["sayi"])).alias("sayilar"))


def report_items(reports: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """A report's paragraphs, bullets with what continues them, quotations and table rows (P06): ``satir`` from 1, ``tur``, ``metin``, ``baslik``.

    Fences are known by their parity; an item starts where its kind changes, and its
    lines are those up to the next start.
    """
    lines = reports.select(*key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("i", "l"))
    t = F.trim("l")
    w = Window.partitionBy(*key).orderBy("i")
    mark = t.startswith("```")
    lines = lines.withColumn("cit", (F.sum(mark.cast("int")).over(w) % 2 == 1) | mark)
    kind = F.when(F.col("cit") | (t == ""), "none").when(t.startswith("#"), "head").when(t.rlike(r"^\|[\s:|-]*-[\s:|-]*$"), "none").when(t.startswith("|"), "table").when(t.startswith(">"), "quote").when(F.col("l").rlike(r"^\s*(?:[-*]|\d+[.)])\s+"), "bullet").otherwise("text")
    lines = lines.withColumn("k", kind)
    lines = lines.withColumn("baslik", F.last(F.when(F.col("k") == "head", F.trim(F.regexp_replace(t, "^#+", ""))), ignorenulls=True).over(w))
    before = F.lag("k").over(w)
    start = F.col("k").isin("table", "bullet") | ((F.col("k") == "quote") & F.coalesce(before != "quote", F.lit(True))) | ((F.col("k") == "text") & F.coalesce(before.isin("none", "head", "table"), F.lit(True)))
    lines = lines.withColumn("g", F.sum(start.cast("int")).over(w)).where(~F.col("k").isin("none", "head"))
    bare = F.when(F.col("k") == "table", F.trim(F.regexp_replace(t, r"^\|+|\|+$", ""))).when(F.col("k") == "quote", F.trim(F.regexp_replace(t, "^>", ""))).when(F.col("k") == "bullet", F.regexp_replace("l", r"^\s*(?:[-*]|\d+[.)])\s+", "")).otherwise(t)
    parts = F.array_sort(F.collect_list(F.struct("i", "k", bare.alias("m"), "baslik")))
    rows = lines.groupBy(*key, "g").agg(parts.alias("p"))
    first = F.get("p", 0)
    name = F.when(first["k"] == "text", "paragraph").otherwise(first["k"])
    return rows.select(*key, (first["i"] + 1).alias("satir"), name.alias("tur"), F.trim(F.regexp_replace(F.array_join("p.m", " "), r"\s+", " ")).alias("metin"), F.coalesce(first["baslik"], F.lit("")).alias("baslik"))


def complete_urls(col: Column) -> Column:
    """``https://`` before addresses without a scheme (P07), but not before selectors."""
    tlds = "com|org|net|io|dev|gov|edu|ai|co|tr|uk|de|fr|eu|info|app"
    c = F.regexp_replace(col, rf"(?<![\p{{L}}\p{{N}}_@./:-])((?:[a-z0-9-]+\.)+(?:{tlds})/(?![^\s?]*=)[^\s)\]>,;]+)", "https://$1")
    return c


def _subject_words(text: Column, quotes: Column) -> Column:
    """Words of an item's own sentence as structs (t, caps, tech): without general ones and those of its quotations."""
    quoted = F.array_join(F.transform(quotes, lambda q: T.norm(q, False)), " ")
    words = F.transform(F.regexp_extract_all(T.claim_prose(text), F.lit(J._ANCHOR), 0), lambda t: F.struct(F.lower(t).alias("t"), t.rlike("^[A-Z][A-Z0-9-]{2,}$").alias("caps"), (F.contains(t, F.lit("-")) | t.rlike(r"\d")).alias("tech")))
    return F.array_distinct(F.filter(words, lambda w: ~w["t"].isin(*J.ANCHOR_STOP) & ~F.contains(quoted, w["t"])))


def _nearest_subject(words: Column, base: Column, url: Column, at: Column, length: Column) -> Column:
    """How far the nearest rare word of an item (T12) stands from the places ``at`` of a number; null if the page has none."""
    labels = F.split(U.host(url), r"[^a-z0-9]+")
    rare = F.filter(words, lambda w: ((F.length(w["t"]) >= 5) | w["caps"]) & ~F.array_contains(labels, w["t"]))
    places = F.transform(rare, lambda w: T.starts_of(base, F.concat(F.lit(r"(?<![\p{L}\p{N}_-])\Q"), w["t"], F.lit(r"\E(?![\p{L}\p{N}_-])"))))
    hits = F.flatten(F.filter(places, lambda p: F.size(p).between(1, J.ANCHOR_MOST)))
    return F.array_min(F.flatten(F.transform(hits, lambda h: F.transform(at, lambda p: F.when(h < J.TITLE_ZONE, 0).otherwise(F.greatest(F.lit(0), p - h, h - p - length))))))


def check_report(items_: DataFrame, pages: DataFrame, key: list[str], pool: bool = False) -> DataFrame:
    """Quotations and numbers of a report's items against pages.

    An item with addresses is held against its own pages: quotations that stand on none
    are errors, numbers warnings. With ``pool``, an item without is held against all readable
    pages of its report: what is ``missing`` there is a warning, a number that is there
    ``uncited``, unless the item names the page's host. A number is ``far`` from its subject if
    no rare word of the item stands near it on any page, and ``other_subject`` if the
    item's technical terms (T13) stand on other pages of the report only. Without ``pool``,
    and where no page of the report is readable, an item without an address is ``no_url``.
    """
    item = [*key, "satir"]
    rows = items_.withColumn("urls", F.array_distinct(F.transform(F.regexp_extract_all("metin", F.lit(r"https?://[^\s)<>\]]+"), 0), lambda u: F.regexp_replace(u, r"[.,;:`'\"*>]+$", ""))))
    rows = rows.select(*item, "metin", "urls").withColumn("q", T.quotes(F.col("metin"))).withColumn("n", T.numbers(F.col("metin"))).withColumn("w", _subject_words(F.col("metin"), F.col("q")))
    cited = rows.select(*key, F.explode("urls").alias("url")).withColumn("sayfa_url", U.canonical(F.col("url")))
    # Pages are met by their ids; their texts are joined last, so that no row that is shuffled afterwards carries one.
    texts = pages.select("sayfa_url", "sayfa")
    readable = cited.groupBy(*key, "sayfa_url").agg(F.min("url").alias("url")).join(pages.select("sayfa_url"), "sayfa_url", "left_semi")
    # The pages on which each technical term of a report stands, with or without hyphens.
    tech = rows.select(*item, F.explode(F.filter("w", lambda w: w["tech"] & (F.length(w["t"]) >= 6))["t"]).alias("t")).distinct()
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    on = tech.select(*key, "t").distinct().join(readable.select(*key, "sayfa_url"), key).join(texts, "sayfa_url").where(F.contains("sayfa", F.col("t")) | F.contains(bare(F.col("sayfa")), bare(F.col("t")))).groupBy(*key, "t").agg(F.collect_set("sayfa_url").alias("yer"))
    terms = tech.join(on, [*key, "t"], "left").groupBy(*item).agg(F.collect_list(F.coalesce("yer", F.array().cast("array<string>"))).alias("yerler"))
    rows = rows.join(terms, item, "left")

    own = rows.where(F.size("urls") > 0).withColumn("url", F.explode("urls")).drop("urls").withColumn("sayfa_url", U.canonical(F.col("url"))).withColumn("adresli", F.lit(True))
    none = rows.where(F.size("urls") == 0).drop("urls")
    none = none.join(readable, key, "left") if pool else none.withColumns({c: F.lit(None).cast("string") for c in ("url", "sayfa_url")})
    met = own.unionByName(none.withColumn("adresli", F.lit(False))).where(F.size("q") + F.size("n") > 0).join(texts, "sayfa_url", "left")
    wanted = F.concat(F.transform("q", lambda q: F.struct(F.lit("quote").alias("tur"), q.alias("oge"))), F.transform("n", lambda n: F.struct(F.lit("number").alias("tur"), n.alias("oge"))))
    each = met.withColumn("o", F.explode(wanted)).withColumn("var", F.coalesce(F.when(F.col("o.tur") == "quote", T.has_quote(F.col("sayfa"), F.col("o.oge"))).otherwise(T.has_number(F.col("sayfa"), F.col("o.oge"))), F.lit(False)))
    # Only numbers that stand on a page that is the item's own or that it names are held against their subject there.
    named = F.col("adresli") | F.coalesce(F.contains(F.lower("metin"), U.host_label(U.host(F.col("url")))), F.lit(False))
    each = each.withColumn("yargi", F.col("var") & (F.col("o.tur") == "number") & named)
    base = F.substring_index("sayfa", "\n", 1)  # the page without the variants of divided words
    at = T.starts_of(base, T.number_pattern(T.norm(F.col("o.oge"), False)))
    each = each.withColumn("uzak", F.when(F.col("yargi"), _nearest_subject(F.col("w"), base, F.col("url"), at, F.length("o.oge"))))
    absent = F.coalesce(F.forall("yerler", lambda y: ~F.array_contains(y, F.col("sayfa_url"))) & F.exists("yerler", lambda y: F.size(y) > 0), F.lit(False))
    far, other = F.col("yargi") & (F.col("uzak") > J.CONTEXT_WINDOW), F.col("yargi") & F.col("uzak").isNull() & absent
    each = each.withColumns({"uzakta": F.coalesce(far, F.lit(False)), "baska": other})
    any_ = lambda c, name: F.bool_or(c).alias(name)
    by = each.groupBy(*item, "metin", "o.tur", "o.oge").agg(
        any_(F.col("var"), "var"), any_(F.col("adresli"), "adresli"), any_(F.col("sayfa").isNotNull(), "okundu"), any_(F.col("yargi"), "yargi"),
        any_(F.col("yargi") & ~F.col("uzakta") & ~F.col("baska"), "yakin"), any_(F.col("uzakta"), "uzakta"),
    )
    number = F.col("tur") == "number"
    lost = F.when(~number | ~_document_number(F.col("metin"), F.col("oge")), "missing")
    placed = F.when(number & ~F.col("yargi"), "uncited").when(number & ~F.col("yakin"), F.when(F.col("uzakta"), "far").otherwise("other_subject"))
    unread = F.when(~number | ~_document_number(F.col("metin"), F.col("oge")), F.when(F.col("adresli"), "unreadable").otherwise("no_url"))
    issue = F.when(~F.col("okundu"), unread).when(~F.col("var"), lost).otherwise(placed)
    level = F.when(issue.isin("no_url", "unreadable", "uncited"), "info").when((issue == "missing") & ~number & F.col("adresli"), "error").otherwise("warning")
    return by.withColumn("sorun", issue).where("sorun is not null").select(*item, "tur", "oge", "sorun", level.alias("seviye"))


def _document_number(text: Column, number: Column) -> Column:
    """Whether every place of a number is part of a document's name."""
    every = F.regexp_count(text, F.concat(F.lit(r"(?<!\d)\Q"), number, F.lit(r"\E(?!\d)")))
    named = F.regexp_count(text, F.concat(F.lit("(?i)(?:" + "|".join(SERIES) + r")[\s-]*\Q"), number, F.lit(r"\E(?!\d)")))
    return (every > 0) & (every == named)


def report_extras(items_: DataFrame, noted: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Addresses of a report that are in no note, unreadable or weak, and reports without any."""
    urls = items_.select(*key, F.explode(F.regexp_extract_all("metin", F.lit(r"https?://[^\s)<>\]]+"), 0)).alias("url")).withColumn("url", F.regexp_replace("url", r"[.,;:`'\"*>]+$", "")).distinct()
    u = urls.withColumn("anahtar", U.report_key(F.col("url"))).withColumn("sayfa_url", U.canonical(F.col("url")))
    out = u.join(noted.select(U.report_key(F.col("url")).alias("anahtar")).distinct(), "anahtar", "left_anti").select(*key, "url", F.lit("not in notes").alias("sorun"))
    out = out.unionByName(u.join(pages.select("sayfa_url"), "sayfa_url", "left_anti").select(*key, "url", F.lit("unreadable").alias("sorun")))
    out = out.unionByName(u.where(U.trust_score(F.col("url")) < 50).select(*key, "url", F.lit("weak").alias("sorun")))
    none = items_.select(*key).distinct().join(urls, key, "left_anti").select(*key, F.lit(None).cast("string").alias("url"), F.lit("no url").alias("sorun"))
    return out.unionByName(none)


def report_metrics(reports: DataFrame, key: list[str], text: str = "metin") -> DataFrame:
    """Words, headings, table rows and distinct addresses of each report."""
    lines = F.split(text, "\n")
    urls = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s)<>\]]+"), 0), lambda u: F.regexp_replace(u, "[.,;]+$", "")))
    return reports.select(
        *key, F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).alias("sozcuk"), F.size(F.filter(lines, lambda l: l.startswith("#"))).alias("baslik"),
        F.size(F.filter(lines, lambda l: l.startswith("|") & ~l.rlike(r"^\|[\s:|-]+$"))).alias("tablo_satiri"), F.size(urls).alias("adres"),
    )
