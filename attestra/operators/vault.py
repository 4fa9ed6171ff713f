"""The page vault: upserts, passages, copy groups, independent sources, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..runtime import cut, let

PASSAGE, SHINGLE, COPY, GROUP_ID, STALE_DAYS = 800, 8, 0.85, 12, 30
#: Fixed value: how much of a page, in copy form, a comparison like the earlier tooling's reads. The engine reads whole pages.
PARITY_CAP = 6000


def upsert(records: DataFrame, existing: DataFrame | None = None, text: str | None = None) -> DataFrame:
    """Newest record of each canonical address, strictly newer replacing (R04). Columns: ``url``, ``alindi``, ``kayit_no``, and ``metin`` where ``text`` names the column of texts."""
    ok = records.where("ok and trim(coalesce(markdown, '')) <> ''").withColumn("url", U.canonical(F.col("istenen_url"))).where("url <> ''")
    more = [F.col(text).alias("metin")] if text else []
    rows = ok.select("url", F.coalesce("fetched_at", F.lit(0.0)).alias("alindi"), "kayit_no", *more).withColumn("__new", F.lit(1))
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("__new", F.lit(0)).select(rows.columns))
    # The newest; of equally new ones that which was there, then the first.
    least = F.min(F.struct(-F.col("alindi"), "__new", "kayit_no", *(["metin"] if text else []))).alias("r")
    return rows.groupBy("url").agg(least).select("url", (-F.col("r.col1")).alias("alindi"), "r.kayit_no", *(["r.metin"] if text else []))


def upsert_counts(records: DataFrame, order: str = "kayit_no") -> DataFrame:
    """How many records were added, replaced an older one, or were skipped, in input order."""
    ok = records.where("ok and trim(coalesce(markdown, '')) <> ''").withColumn("url", U.canonical(F.col("istenen_url"))).where("url <> ''")
    at = F.coalesce("fetched_at", F.lit(0.0))
    before = F.max(at).over(Window.partitionBy("url").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(before.isNull(), "added").when(at > before, "updated").otherwise("skipped")
    return ok.dropDuplicates([order]).withColumn("islem", kind).groupBy("islem").agg(F.count("*").alias("n"))


def passages(text: Column, target: int = PASSAGE) -> Column:
    """Paragraphs joined up to ``target`` characters, longer ones cut hard."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > target, F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / target).cast("int")), lambda i: F.struct(F.substring(p, i * target + 1, F.lit(target)).alias("t"), F.lit(True).alias("hard")))).otherwise(F.array(F.struct(p.alias("t"), F.lit(False).alias("hard"))))))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(s: Column, x: Column) -> Column:
        flushed = F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"])))
        joined = F.when(s["buf"] == "", x["t"]).otherwise(F.concat_ws("\n", s["buf"], x["t"]))
        full = (s["buf"] != "") & (F.length(s["buf"]) + 1 + F.length(x["t"]) > target)
        hard = F.struct(F.concat(flushed, F.array(x["t"])).alias("out"), F.lit("").alias("buf"))
        soft = F.when(full, F.struct(flushed.alias("out"), x["t"].alias("buf"))).otherwise(F.struct(s["out"].alias("out"), joined.alias("buf")))
        return F.when(x["hard"], hard).otherwise(soft)

    return F.aggregate(parts, zero, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))


def page_texts(rows: DataFrame, key: str = "url", order: str = "sira", text: str = "metin") -> DataFrame:
    """Each page's passages in order, joined by line breaks."""
    p = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("m")))).alias("p"))
    return p.select(key, F.array_join("p.m", "\n").alias("metin"))


def shingles(text: Column, n: int = SHINGLE, cap: int | None = None) -> Column:
    """Hashes of the distinct runs of ``n`` words of the copy form (T03), of its first ``cap`` characters if given, in order of size; a shorter text is one run, an empty one none."""
    plain = T.copy_norm(text)
    words = F.filter(F.split(F.substring(plain, 1, cap) if cap else plain, " "), lambda w: w != "")

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(many)))

    return let(words, runs)


def copy_classes(pages: DataFrame, key: str = "url", least: float = COPY, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of pages with the same runs, (``k``, ``cls``), and the pairs of classes that overlap by ``least``, (``ca``, ``cb``, ``benzerlik``); exact.

    Runs held by one class are dropped before prefixes are taken in the order of
    frequency: they cannot be shared, but count.
    """
    base = cut(pages.select(key, shingles(F.col("metin"), cap=cap).alias("s")).where(F.size("s") > 0).select(F.col(key).alias("k"), "s"))
    base = base.withColumn("set", F.md5(F.concat_ws(",", "s")))
    heads = cut(base.groupBy("set").agg(F.min("k").alias("cls"), F.first("s").alias("s")))
    rows = heads.select("cls", F.size("s").alias("n"), F.explode("s").alias("x"))
    df = rows.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(df, "x")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("cls"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("df", "x")) + alone
    prefix = cut(shared.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("x", "cls", "n"))
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.cls") < F.col("b.cls")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(least) - 1e-9)
    met = a.join(b, (F.col("a.x") == F.col("b.x")) & fits).select(F.col("a.cls").alias("ca"), F.col("b.cls").alias("cb")).distinct()
    sets = heads.select("cls", "s")
    full = met.join(sets.toDF("ca", "sa"), "ca").join(sets.toDF("cb", "sb"), "cb")
    common = F.size(F.array_intersect("sa", "sb"))
    near = cut(full.select("ca", "cb", (common / (F.size("sa") + F.size("sb") - common)).alias("benzerlik")).where(F.col("benzerlik") >= least))
    return cut(base.select("k", "set").join(heads.select("set", "cls"), "set").select("k", "cls")), near


def copy_pairs(pages: DataFrame, key: str = "url", least: float = COPY, cap: int | None = None) -> DataFrame:
    """Pairs of pages whose runs overlap by ``least`` (J08), (``a``, ``b``, ``benzerlik``) with ``a < b``: the listing of :func:`copy_classes`."""
    m, near = copy_classes(pages, key, least, cap)
    same = m.toDF("x", "c").join(m.toDF("y", "c"), "c").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("benzerlik"))
    apart = near.join(m.toDF("x", "ca"), "ca").join(m.toDF("y", "cb"), "cb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "benzerlik")
    return same.unionByName(apart)


def roots(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``k``, ``kok``): the smallest member of everything linked to ``k``.

    Edges are drawn between labels after each round, which halves them at least.
    """
    edge = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edge = cut(edge.unionByName(edge.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = edge.select(F.col("x").alias("k")).distinct().withColumn("kok", F.col("k"))
    while edge.limit(1).count():
        low = edge.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        to = cut(low.join(low.select(F.col("x").alias("to"), F.col("to").alias("above")), "to", "left").select("x", F.coalesce("above", "to").alias("to")))
        label = cut(label.join(to, label.kok == to.x, "left").select("k", F.coalesce("to", "kok").alias("kok")))
        edge = cut(edge.join(to.toDF("x", "a"), "x").join(to.toDF("y", "b"), "y").where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct())
    return label


def class_edges(members: DataFrame, near: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that hold all copies together: each page to the head of its class, and similar classes; never all pairs."""
    return members.where("k <> cls").select(F.col("cls").alias("a"), F.col("k").alias("b")).unionByName(near.select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def copy_groups(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """``url``, ``grup``: group id is the start of the SHA-1 of the group's oldest page (R05); pages alone have one too. ``pages``: ``url``, ``alindi``; ``pairs``: links as of :func:`class_edges`."""
    one = pages.groupBy("url").agg(F.min(F.coalesce("alindi", F.lit(0.0))).alias("alindi"))
    rows = one.join(roots(pairs).withColumnRenamed("k", "url"), "url", "left").withColumn("kok", F.coalesce("kok", "url"))
    oldest = rows.groupBy("kok").agg(F.min_by("url", F.struct("alindi", "url")).alias("ilk"))
    return rows.join(oldest, "kok").select("url", F.substring(F.sha1("ilk"), 1, GROUP_ID).alias("grup"))


def independent_sources(cited: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Independent sources among the addresses of each key (A07, A08): copies of one text count once, other pages by host.

    ``cited``: key, ``url``; ``pages``: ``url``, ``host``, ``grup``. For totals see :func:`independence_totals`.
    """
    size = pages.where("grup is not null").groupBy("grup").agg(F.count_distinct("url").alias("uye"))
    known = pages.select("url", "host", "grup").dropDuplicates(["url"]).join(size, "grup", "left")
    unit = F.when(F.col("uye") > 1, F.concat(F.lit("g:"), "grup")).when(F.col("host").isNotNull(), F.concat(F.lit("h:"), "host"))
    rows = cited.select(*key, "url").distinct().withColumn("alan", U.host(F.col("url"))).join(known.withColumn("var", F.lit(1)), "url", "left")
    return rows.groupBy(*key).agg(
        F.count("*").alias("adres"), F.count("var").alias("okunan"), F.count_distinct("alan").alias("alan_adi"),
        F.count_distinct(F.when(F.col("var") == 1, F.col("alan"))).alias("okunan_alan_adi"), F.count_distinct(F.when(F.col("var") == 1, unit)).alias("bagimsiz"),
    )


def independence_totals(cited: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """One row of totals over all notes (A09): sums of :func:`independent_sources`, and copy groups, a group with the same cited members counting once."""
    sums = independent_sources(cited, pages, key).agg(
        F.count("*").alias("not_"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("alan_adi", "okunan_alan_adi")), F.coalesce(F.sum(F.col("adres") - F.col("okunan")), F.lit(0)).alias("okunamayan"), F.coalesce(F.sum("bagimsiz"), F.lit(0)).alias("bagimsiz")
    )
    known = pages.where("grup is not null").select("url", "grup").dropDuplicates(["url"])
    groups = cited.select(*key, "url").distinct().join(known, "url").groupBy(*key, "grup").agg(F.array_sort(F.collect_set("url")).alias("uyeler")).where(F.size("uyeler") > 1)
    return sums.crossJoin(groups.agg(F.count_distinct("uyeler").alias("kopya_grubu")))  # two single rows


def statistics(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """One row about the vault."""
    groups = pages.where("kopya_grubu is not null").groupBy("kopya_grubu").agg(F.count_distinct("url").alias("n")).where("n > 1").agg(F.count("*").alias("kopya_grubu"))
    p = pages.agg(F.count_distinct("url").alias("sayfa"), F.count_distinct("host").alias("alan_adi"), F.min("alindi").alias("ilk"), F.max("alindi").alias("son"))
    return p.crossJoin(rows.agg(F.count_distinct("pasaj_no").alias("pasaj"))).crossJoin(groups)  # three single rows


def bm25(items: DataFrame, terms: list[str], key: str, tokens: Column, k1: float = 1.4, b: float = 0.75, within: list[str] | None = None) -> DataFrame:
    """Okapi BM25 of every item that holds a term (R01): ``key``, ``skor``, ``terim`` (how many terms it holds).

    Only counts of the query's terms are kept; statistics are over all items, or over
    those of the same ``within`` columns. Repeated terms count once.
    """
    terms = sorted(set(terms))
    within = within or []
    t = items.select(*within, F.col(key).alias("__k"), tokens.alias("__t"))
    counts = [F.size(F.filter("__t", _equals(q))) for q in terms]
    rows = t.select(*within, "__k", F.size("__t").alias("__dl"), F.array(*counts).alias("__tf") if terms else F.array().cast("array<int>").alias("__tf"))
    stats = rows.groupBy(*within).agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *(F.count_if(F.col("__tf")[i] > 0).alias(f"__df{i}") for i in range(len(terms))))
    joined = rows.join(stats, within) if within else rows.crossJoin(F.broadcast(stats))  # without `within`, one row of statistics
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        tf = F.col("__tf")[i]
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__dl") / F.greatest("__avg", F.lit(1e-9))))).otherwise(0.0)
    return joined.select(*within, F.col("__k").alias(key), score.alias("skor"), F.size(F.filter("__tf", lambda x: x > 0)).alias("terim")).where("skor > 0")


def _equals(term: str):
    return lambda x: x == F.lit(term)


def search(rows: DataFrame, pages: DataFrame, query: str, k: int = 10, as_of: float | None = None) -> DataFrame:
    """The best passages of the vault for a query (R02): all words, or else any; one of each copy group; stale ones flagged.

    ``as_of`` is the epoch second to which age refers. A blank query is an error.
    """
    terms = [w.lower() for w in query.replace('"', " ").replace("*", " ").split() if any(ch.isalnum() for ch in w)]
    if not query.strip():
        raise ValueError("blank query")
    tokens = F.regexp_extract_all(F.lower("metin"), F.lit(T.W + "+"), 0)
    got = bm25(rows.dropDuplicates(["pasaj_no"]), terms, "pasaj_no", tokens, 1.2, 0.75)
    most = got.agg(F.max("terim")).first()[0] or 0
    hits = got.where(F.col("terim") == len(set(terms))) if most == len(set(terms)) else got
    one = pages.dropDuplicates(["url"]).select("url", "host", "baslik", "alindi", "kopya_grubu")
    full = hits.join(rows.select("pasaj_no", "url", "metin").dropDuplicates(["pasaj_no"]), "pasaj_no").join(one, "url")
    w = Window.partitionBy(F.coalesce("kopya_grubu", "url")).orderBy(F.desc("skor"), "pasaj_no")
    best = full.withColumn("r", F.row_number().over(w)).where("r = 1").orderBy(F.desc("skor"), "pasaj_no").limit(k)
    old = F.lit(as_of) - F.col("alindi") > STALE_DAYS * 86400 if as_of is not None else F.lit(False)
    cut_ = T.snippet(F.col("metin"), F.lit(terms[0] if terms else ""))
    return best.select("pasaj_no", "url", "host", "baslik", "skor", cut_.alias("ozet"), old.alias("eski"))


def budget_choice(ranked: Column, budget: int) -> Column:
    """Indices taken greedily in rank order within a token budget (R03): ``ranked`` is an array of structs (``i``, ``tokens``); the first is always taken."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        cost = x["tokens"] + 8
        skip = s["full"] | ((s["used"] + cost > budget) & (F.size(s["out"]) > 0))
        taken = F.struct(F.concat(s["out"], F.array(x["i"])).alias("out"), (s["used"] + cost).alias("used"), (s["used"] + cost >= budget).alias("full"))
        return F.when(skip, s).otherwise(taken)

    return F.array_sort(F.aggregate(ranked, zero, step)["out"])


def host_slots(fetches: DataFrame, gap: float = 0.5, bucket: float = 600.0) -> DataFrame:
    """When each fetch of a host may start (ST4): in order, ``gap`` seconds apart at least.

    slot_i = max over j <= i of (t_j + (i - j) * gap), a running maximum. It is taken in
    two levels, within ``bucket`` seconds of a host and over its buckets, so a host with
    any part of all fetches is spread over as many tasks as it has buckets.
    """
    rows = fetches.withColumn("__b", F.floor(F.col("t") / bucket))
    sizes = rows.groupBy("host", "__b").agg(F.count("*").alias("__n"))
    before = lambda c: c.over(Window.partitionBy("host").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("host", "__b", F.coalesce(before(F.sum("__n")), F.lit(0)).alias("__from"))
    own = Window.partitionBy("host", "__b").orderBy("t", "kayit_no")
    rows = cut(rows.withColumn("__i", F.row_number().over(own)).join(offsets, ["host", "__b"]).withColumn("__i", F.col("__i") + F.col("__from")).withColumn("__m", F.col("t") - F.col("__i") * gap))
    tops = rows.groupBy("host", "__b").agg(F.max("__m").alias("__top"))
    earlier = tops.select("host", "__b", before(F.max("__top")).alias("__before"))
    made = rows.join(earlier, ["host", "__b"]).withColumn("slot", F.greatest(F.max("__m").over(own), F.col("__before")) + F.col("__i") * gap)
    return made.select(*fetches.columns, "slot")
