"""One group identifier for everything linked directly or indirectly (problem 6).

In each round the minimum label is propagated across the edges and pulled forward by
pointer jumping; edges are then drawn between labels instead of nodes, and those
within one label fall away. Every label with an edge meets a smaller one or is met by
a larger, so the labels left are at least halved each round. Every round is written to
the shared checkpoint folder; the loop ends when no edge joins two labels, that is,
when no label can change.

A group of n records that share a value is n-1 edges to its smallest member, never
all pairs. Messages to a node are reduced by ``min`` before they are shuffled, so a
hub with a third of all edges costs one row for each partition. The joins of edges
with the new labels of their ends have one row on the other side for each node; where a
hub makes a partition of edges large, adaptive execution splits that side.

The labels left are at least halved in each round, so ``max_rounds`` of 200 cannot be
reached by any number of nodes; it is an error, not a result, should it be.

Defined results: null urls and null group values link nothing; a page paired with
itself, pairs in both directions and repeated pairs change nothing; a page named
only by a pair belongs to its group; empty inputs give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, free, table


def _identified(nodes: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` values with a 64-bit id each; the seed changes until all ids differ."""
    seed = 42
    while True:
        named = cut(nodes.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("id", F.xxhash64(F.lit(seed), "key")))
        if named.groupBy("id").count().where("count > 1").limit(1).count() == 0:
            return named
        seed += 1


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(``key``, ``root``) of every value of the edge list; ``root`` is the smallest value of its component."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = cut(both)
    named = _identified(both.select(F.explode(F.array("a", "b")).alias("key")), "key")
    ids = both.join(named.select(F.col("key").alias("a"), F.col("id").alias("ia")), "a").join(named.select(F.col("key").alias("b"), F.col("id").alias("ib")), "b").select("ia", "ib")
    edge = cut(ids.union(ids.select("ib", "ia")).toDF("src", "dst"))
    free(both)
    label = named.select(F.col("id").alias("node"), F.col("id").alias("label"))
    rounds, old = 0, [edge]
    while edge.limit(1).count():
        low = edge.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("low"))
        up = low.select(F.col("node").alias("low"), F.col("low").alias("above"))
        step = cut(low.join(up, "low", "left").select("node", F.coalesce("above", "low").alias("to")))
        moved = label.join(step.toDF("label", "to"), "label", "left")
        label = cut(moved.select("node", F.coalesce("to", "label").alias("label")))
        ends = edge.join(step.toDF("src", "a"), "src").join(step.toDF("dst", "b"), "dst")
        edge = cut(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        for done in old:
            free(done)
        old = [edge, step, label]  # of this round; read by the next one only
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"labels still change after {max_rounds} rounds")
    member = cut(named.join(label, named.id == label.node).select("key", "label"))
    for done in (*old, named):
        free(done)
    root = member.groupBy("label").agg(F.min("key").alias("root"))
    return member.join(root, "label").select("key", "root")


def group_edges(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Edges (a, b) from each row's ``key`` to the smallest ``key`` of its ``group``."""
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("b")).where("g is not null and b is not null")
    least = rows.groupBy("g").agg(F.min("b").alias("a"))
    return rows.join(least, "g").where("a <> b").select("a", "b")


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "kopya_cift", "url_a", "url_b").toDF("a", "b")
    return pairs.unionByName(group_edges(table(spark, sf_dir, "sayfa", "kopya_grubu", "url"), "kopya_grubu", "url"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = components(page_edges(spark, sf_dir))
    return got.where("key <> root").select(F.col("root").alias("kok_url"), F.col("key").alias("url"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its group identifier; a page linked to none is its own group."""
    pages = table(spark, sf_dir, "sayfa", "url").where("url is not null").distinct()
    got = components(page_edges(spark, sf_dir))
    return pages.join(got, pages.url == got.key, "full").select(F.coalesce("url", "key").alias("url"), F.coalesce("root", "url").alias("grup"))
