"""Claims across runs: duplicate-safe matching, coverage of facts, consensus, conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..runtime import bounded, cut
from .vault import roots

SAME, SAME_PAGE, MIN_RUNS, LEAST_COVERAGE, QUESTIONS = 0.6, 0.35, 2, 0.6, 3


def claim_key(claim: Column) -> Column:
    return F.trim(F.regexp_replace(claim, T.S + "+", " "))


def match_in_order(left: DataFrame, right: DataFrame, key: list[str], order_l: list[str], order_r: list[str]) -> DataFrame:
    """The k-th row of each key on the left with the k-th on the right."""
    number = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return left.withColumn("kacinci", number(order_l)).join(right.withColumn("kacinci", number(order_r)), [*key, "kacinci"], "left")


def facts(plan: DataFrame) -> DataFrame:
    """The expected facts of each topic (P16): ``slug``, ``no``, ``ad``, ``desen``; facts without a name or pattern are dropped."""
    rows = plan.select("slug", F.posexplode("olgular").alias("no", "o")).select("slug", "no", F.trim("o.ad").alias("ad"), F.trim("o.ara").alias("desen"))
    return rows.where("ad <> '' and desen <> ''").distinct()


def fact_hits(known: DataFrame, claims: DataFrame, claim: str = "iddia") -> DataFrame:
    """Facts named in claims of their topic (J03): ``slug``, ``no``, ``run_id``; found in the claim's own text or its normal form, never in addresses."""
    text = claims.select("slug", "run_id", T.fact_text(F.col(claim)).alias("t")).withColumn("n", T.norm(F.col("t"), False)).distinct()
    desen = F.concat(F.lit("(?iu)"), "desen")
    return text.join(bounded(known), "slug").where(F.regexp("t", desen) | F.regexp("n", desen)).select("slug", "no", "run_id").distinct()


def fact_coverage(known: DataFrame, hits: DataFrame) -> DataFrame:
    """Covered and expected facts of each topic (A10)."""
    done = hits.groupBy("slug", "no").agg(F.count_distinct("run_id").alias("calistirma"))
    rows = known.join(done, ["slug", "no"], "left")
    out = rows.groupBy("slug").agg(F.count("*").cast("int").alias("toplam"), F.count("calistirma").cast("int").alias("kapsanan"))
    return out.withColumn("yuzde", F.floor(100 * F.col("kapsanan") / F.col("toplam")).cast("int")).withColumn("yeterli", F.col("kapsanan") / F.col("toplam") >= LEAST_COVERAGE)


def follow_up(known: DataFrame, hits: DataFrame) -> DataFrame:
    """Missing facts of each topic as at most ``QUESTIONS`` questions, the rest folded into the last."""
    missing = known.join(hits.select("slug", "no").distinct(), ["slug", "no"], "left_anti")
    n = F.row_number().over(Window.partitionBy("slug").orderBy("no"))
    rows = missing.withColumn("soru", F.least(n, F.lit(QUESTIONS)))
    return rows.groupBy("slug", "soru").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "ad"))), lambda x: x["ad"]), "; ").alias("olgular"))


def claim_features(found: DataFrame, key: list[str], claim: str = "iddia") -> DataFrame:
    """What claims are compared by: words of the quotations or else of the claim, address keys, numbers."""
    ev = T.evidence(F.col(claim))
    own = F.regexp_replace(F.regexp_replace(claim, r"\[[^\]]*\]\([^)]*\)", ""), T.PREFIX, "")
    quote = F.array_join(ev["quotes"], " ")
    words = T.word_set(T.norm(F.when(quote != "", quote).otherwise(own), False))
    keys = F.array_distinct(F.transform("urls", lambda u: U.consensus_key(u)))
    return found.select(*key, F.col(claim).alias("iddia"), words.alias("kelimeler"), keys.alias("anahtarlar"), ev["numbers"].alias("sayilar"), (quote != "").alias("alintili"))


def same_claim(a: str, b: str) -> Column:
    """Whether two claims are one (V13); ``a`` and ``b`` prefix their columns."""
    c = lambda p, n: F.col(f"{p}{n}")
    na, nb = c(a, "sayilar"), c(b, "sayilar")
    apart = (F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb)
    share = F.size(F.array_intersect(c(a, "kelimeler"), c(b, "kelimeler"))) / F.greatest(F.lit(1), F.least(F.size(c(a, "kelimeler")), F.size(c(b, "kelimeler"))))
    page = F.arrays_overlap(c(a, "anahtarlar"), c(b, "anahtarlar")) & ((share >= SAME_PAGE) | F.arrays_overlap(na, nb))
    return F.coalesce(~apart & ((share >= SAME) | page), F.lit(False))


def _id(key: list[str]) -> Column:
    """One name for a key, by a 128-bit digest."""
    return F.md5(F.to_json(F.struct(*key)))


def same_claim_pairs(features: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of claims of one topic and different runs that are the same.

    Lossless candidates: a claim that shares ``SAME`` of the smaller one's words holds one
    of that one's rarest words (a prefix in the order of frequency); all others share a
    page, and on it a word of the longer prefix of ``SAME_PAGE``, or a number.
    """
    f = cut(features.withColumn("id", _id(key)))
    words = f.select("slug", "id", F.size("kelimeler").alias("n"), F.explode("kelimeler").alias("x"))
    df = words.groupBy("slug", "x").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "x"))
    ranked = words.join(df, ["slug", "x"]).withColumn("r", rank)
    rare = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * SAME - 1e-9) + 1).select("slug", "x", F.col("id").alias("ia"))
    by_word = rare.join(words.select("slug", "x", F.col("id").alias("ib")), ["slug", "x"]).where("ia <> ib")
    # On a common page less has to be shared: one of the smaller claim's rarest words, or a number.
    at = f.select("slug", "id", F.explode("anahtarlar").alias("page"))
    low = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * SAME_PAGE - 1e-9) + 1).select("slug", "x", F.col("id").alias("ia"))
    mine, theirs = at.withColumnRenamed("id", "ia"), at.withColumnRenamed("id", "ib")
    by_page = low.join(mine, ["slug", "ia"]).join(words.select("slug", "x", F.col("id").alias("ib")).join(theirs, ["slug", "ib"]), ["slug", "page", "x"]).where("ia <> ib")
    numbers = f.select("slug", "id", F.explode("sayilar").alias("x")).join(at, ["slug", "id"])
    by_number = numbers.withColumnRenamed("id", "ia").join(numbers.withColumnRenamed("id", "ib"), ["slug", "page", "x"]).where("ia < ib")
    met = by_word.unionByName(by_page.select(by_word.columns)).unionByName(by_number.select(by_word.columns)).select(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib")).distinct()
    left = f.select(*(F.col(c).alias(f"a_{c}") for c in f.columns))
    right = f.select(*(F.col(c).alias(f"b_{c}") for c in f.columns))
    rows = met.join(left, F.col("ia") == F.col("a_id")).join(right, F.col("ib") == F.col("b_id"))
    return rows.where(same_claim("a_", "b_") & (F.col("a_run_id") != F.col("b_run_id")))


def clusters(features: DataFrame) -> DataFrame:
    """Greedy consensus (R06): in the order of runs and findings, a claim joins the first cluster without its run that holds the same claim.

    The order makes this sequential, but only among claims that are linked: each connected
    component of the same-claim pairs is clustered apart, so no topic is one task.
    """
    key = ["run_id", "dosya", "sira"]
    pairs = cut(same_claim_pairs(features, ["slug", *key]).select("ia", "ib"))
    root = roots(pairs, "ia", "ib").withColumnRenamed("k", "id")
    rows = features.withColumn("id", _id(["slug", *key])).join(root, "id", "left").withColumn("kok", F.coalesce("kok", "id"))
    schema = "slug string, kume string, run_id string, dosya string, sira int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple[set, list]] = []
        out = []
        for r in pdf.sort_values(key, kind="stable").itertuples(index=False):
            own = (set(r.kelimeler), set(r.sayilar), set(r.anahtarlar))
            at = next((i for i, (runs, members) in enumerate(made) if r.run_id not in runs and any(_same(own, m) for m in members)), len(made))
            if at == len(made):
                made.append((set(), []))
            made[at][0].add(r.run_id)
            made[at][1].append(own)
            out.append((r.slug, f"{r.kok}:{at}", r.run_id, r.dosya, r.sira))
        return pd.DataFrame(out, columns=["slug", "kume", *key])

    linked = rows.join(root.select(F.col("kok")).distinct(), "kok", "left_semi")
    alone = rows.join(root.select("id"), "id", "left_anti").select("slug", F.concat(F.col("kok"), F.lit(":0")).alias("kume"), *key)
    return linked.groupBy("slug", "kok").applyInPandas(one, schema).unionByName(alone)


def _same(a: tuple[set, set, set], b: tuple[set, set, set]) -> bool:
    """:func:`same_claim` on words, numbers and address keys."""
    if a[1] and b[1] and not a[1] & b[1]:
        return False
    share = len(a[0] & b[0]) / max(1, min(len(a[0]), len(b[0])))
    return share >= SAME or (bool(a[2] & b[2]) and (share >= SAME_PAGE or bool(a[1] & b[1])))


def cluster_statistics(clustered: DataFrame) -> DataFrame:
    """How many clusters of each topic have how much support."""
    size = clustered.groupBy("slug", "kume").agg(F.count_distinct("run_id").cast("int").alias("destek"))
    return size.groupBy("slug", "destek").agg(F.count("*").alias("kume"))


def representatives(clustered: DataFrame, features: DataFrame) -> DataFrame:
    """Each cluster's member with the most quoted words, else its first."""
    rows = clustered.join(features, ["slug", "run_id", "dosya", "sira"])
    rank = F.struct(F.col("alintili"), F.when(F.col("alintili"), F.size("kelimeler")).otherwise(0))
    w = Window.partitionBy("slug", "kume").orderBy(F.desc(rank), "run_id", "dosya", "sira")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("slug", "kume", "run_id", "dosya", "sira", "iddia")


def conflicts(clustered: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs of clusters that share a page, both with numbers, none in common."""
    rows = clustered.join(features, ["slug", "run_id", "dosya", "sira"])
    c = rows.groupBy("slug", "kume").agg(F.array_distinct(F.flatten(F.collect_list("sayilar"))).alias("n"))
    at = rows.select("slug", "kume", F.explode("anahtarlar").alias("u")).distinct().join(c, ["slug", "kume"]).where(F.size("n") > 0)
    a, b = at.alias("a"), at.alias("b")
    on = (F.col("a.slug") == F.col("b.slug")) & (F.col("a.u") == F.col("b.u")) & (F.col("a.kume") < F.col("b.kume")) & ~F.arrays_overlap("a.n", "b.n")
    return a.join(b, on).select(F.col("a.slug").alias("slug"), F.col("a.kume").alias("kume_a"), F.col("b.kume").alias("kume_b")).distinct()


def plan_problems(plan: DataFrame) -> DataFrame:
    """What is wrong with each topic of a plan, and facts that several topics share."""
    shared = plan.where(F.size("olgular") > 0).groupBy(F.to_json("olgular").alias("j")).agg(F.count("*").alias("n"), F.collect_list("slug").alias("s")).where("n > 1").select(F.explode("s").alias("slug")).distinct().withColumn("ortak", F.lit(True))
    p = plan.join(shared, "slug", "left")
    issues = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("slug").rlike("^[a-z0-9][a-z0-9-]{0,40}$"), F.lit(False)), "slug"), F.when(F.trim(F.coalesce("konu", F.lit(""))) == "", "topic"), F.when(F.coalesce(F.size("sorular"), F.lit(0)) <= 0, "questions"),
        F.when(~F.col("min_url").between(3, 30), "min_url"), F.when(~F.col("min_url_required").between(2, 30), "min_url_required"),
        F.when(F.col("single_publisher_host").isNotNull() & ~F.col("single_publisher_host").rlike(r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"), "publisher"),
        F.when(F.size("olgular") > 40, "too many facts"), F.when(F.exists("olgular", lambda o: (F.trim(F.coalesce(o["ad"], F.lit(""))) == "") | (F.trim(F.coalesce(o["ara"], F.lit(""))) == "")), "empty fact"), F.when(F.col("ortak"), "shared facts"),
    ))
    return p.select("slug", issues.alias("sorunlar"))


def next_round(missing: set[str], before: set[str] | None, number: int, cap: int = 3) -> str:
    """Whether another gap round is worth it."""
    if not missing:
        return "done"
    if before is not None and missing >= before:
        return "stagnation"
    return "cap" if number >= cap else "continue"


def nli_pairs(verdicts: DataFrame, pages: DataFrame, window: int = 300, least: int = 12) -> DataFrame:
    """Premise and hypothesis of each verified claim with a quotation: ``window`` characters around it, and the claim without it."""
    rows = verdicts.where("karar = 'VERIFIED' and url is not null").withColumn("sayfa_url", U.canonical(F.col("url"))).join(pages, "sayfa_url")
    q = F.get(T.quotes(F.col("iddia")), 0)
    at = T.quote_start(F.col("sayfa"), q)
    rows = rows.where(q.isNotNull()).withColumn("at", at).where("at >= 0").withColumn("hypothesis", T.hypothesis_text(F.col("iddia")))
    return rows.where(F.length("hypothesis") >= least).select("run_id", "dosya", "sira", F.substring("sayfa", F.greatest(F.lit(1), F.col("at") - window + 1), F.length(q) + 2 * window).alias("premise"), "hypothesis")


def nli_scores(pairs: DataFrame, runner, schema: str = "run_id string, dosya string, sira int, ent double, neu double, con double") -> DataFrame:
    """Scores of a pluggable model, a function of batches (§2.11)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield runner(pdf)

    return pairs.mapInPandas(run, schema)


def nli_summary(scores: DataFrame, weak: float = 0.10, strong: float = 0.5) -> DataFrame:
    """One row about the scores."""
    return scores.agg(F.count("*").alias("toplam"), F.count_if(F.col("ent") < weak).alias("zayif"), F.count_if((F.col("ent") < weak) & (F.col("con") >= strong)).alias("celisen"))


def referee_summary(answers: DataFrame, cap: int = 30) -> DataFrame:
    """Answers of a referee by verdict (A21): repeats once, ``cap`` items, the first word that decides in 200 characters."""
    once = answers.dropDuplicates(["dosya", "cumle", "oge"]).orderBy("dosya", "cumle", "oge").limit(cap)
    head = F.lower(F.substring("yanit", 1, 200))
    verdict = F.when(head.rlike(r"\b(evet|yes)\b"), "yes").when(head.rlike(r"\b(hayır|no)\b"), "no").otherwise("unclear")
    return once.groupBy(verdict.alias("karar")).agg(F.count("*").alias("n"))
