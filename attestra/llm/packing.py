"""Containers of fixed capacity filled with texts (problem 9).

Sizes are tokens of a public tokenizer. A text above the capacity is cut into full
pieces and a rest; nothing else is divided. The plan is made from the global histogram
of sizes, which has at most ``capacity`` entries whatever the number of texts:

1. Dynamic programming chooses the upper bounds of ``BUCKETS`` length buckets so that
   rounding every size up to its bucket's bound pads the fewest tokens in total.
2. Token-budget batches form inside each bucket, largest first, by the real lengths: a
   batch takes items of its bucket as long as one fits. What room a batch has left is
   its rest, and only that is given to items of smaller buckets, the largest that fits
   first. A batch is a pattern of lengths, taken as often as the counts allow.
3. Items are numbered where they lie, by length within each partition, and the counts of
   the partitions before are added; an item's number tells its container. Nothing is
   sorted or shuffled for that, so one length may hold any part of all items.

Both the histogram and the plan are bounded by the capacity, so what reaches the driver
and what is broadcast is, too; the counts have a row for each length and partition.

Defined results: null and empty texts have no tokens, take no room and are in no
container; a text of exactly the capacity fills one container; of documents that occur
twice the longest text counts; empty tables give no container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, table
from .bpe import VOCABULARY, with_token_counts

CAPACITY = 2048
BUCKETS = 64
#: Rows up to which the counts by length and partition are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ascending upper bounds, ``buckets`` at most, that minimise the padding of all sizes of ``histogram``.

    The padding of one more bucket falls ever more slowly, so the best division into a
    given number is the best one under some price of a bucket; the price is searched
    for, and each trial is one dynamic program over the sizes.
    """
    sizes = np.array(sorted(histogram), np.int64)
    n = len(sizes)
    if not n:
        return []
    counts = np.array([histogram[s] for s in sizes.tolist()], np.float64)
    c, m = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * sizes)))

    def division(price: float) -> list[int]:
        best, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = best[:j] + (c[j] - c[:j]) * sizes[j - 1] - (m[j] - m[:j])
            back[j] = int(np.argmin(total))
            best[j] = total[back[j]] + price
        out, j = [], n
        while j:
            out.append(int(sizes[j - 1]))
            j = int(back[j])
        return out[::-1]

    low, high = 0.0, float(c[-1] * sizes[-1])
    got = division(high)
    for _ in range(60):
        price = (low + high) / 2
        trial = division(price)
        if len(trial) <= buckets:
            high, got = price, trial
            if len(trial) == buckets:
                break
        else:
            low = price
    return got


class _Left:
    """Counts of items by size, with the largest size that still has some at or below a given one."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.count[size] = n
        self.below = np.arange(capacity + 1)  # a path to the next size with items, shortened as it is used

    def at_most(self, size: int, pattern: dict[int, int]) -> int:
        """The largest size up to ``size`` with more items than ``pattern`` takes; 0 if none has."""
        size = self._root(size)
        while size and self.count[size] <= pattern.get(size, 0):
            size = self._root(size - 1)
        return size

    def _root(self, size: int) -> int:
        top = size
        while size and not self.count[size]:
            size = int(self.below[size]) if self.below[size] != size else size - 1
        while top > size:
            self.below[top], top = size, int(self.below[top]) if self.below[top] != top else top - 1
        return size


def lay_out(counts: dict[int, int], bounds: list[int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Batches as (items of each size, how often), using up ``counts`` of items by size.

    A batch is filled from its own bucket as long as an item of it fits, then from smaller ones.
    """
    left = _Left(counts, capacity)
    floors = [0, *bounds[:-1]]
    out = []
    for floor, bound in zip(reversed(floors), reversed(bounds)):
        while (size := left.at_most(bound, {})) > floor:
            pattern: dict[int, int] = {}
            room = capacity
            while size:
                pattern[size] = pattern.get(size, 0) + 1
                room -= size
                size = left.at_most(min(room, bound), pattern)
            times = int(min(left.count[s] // k for s, k in pattern.items()))
            out.append((pattern, times))
            for s, k in pattern.items():
                left.count[s] -= k * times
    return out


def _plan(batches: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For each size, in order: from which number on its items go how many to a container, and the first container."""
    rows, done, first = [], {}, 0
    for pattern, times in batches:
        for size, k in pattern.items():
            rows.append((size, done.get(size, 0), k, first))
            done[size] = done.get(size, 0) + k * times
        first += times
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table_.T)


def _numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``pid`` and ``no``: the place of each row among those of its length in its partition."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        pid = TaskContext.get().partitionId()
        for pdf in frames:
            before = pdf["uzunluk"].map(lambda s: seen.get(s, 0))
            pdf["pid"], pdf["no"] = pid, before + pdf.groupby("uzunluk").cumcount()
            for s, n in pdf["uzunluk"].value_counts().items():
                seen[s] = seen.get(s, 0) + n
            yield pdf

    return cut(pieces.mapInPandas(count, "doc_id bigint, parca int, bas int, uzunluk int, pid int, no bigint"))


def fill(items: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``items`` (``doc_id``, ``tokens``) to (``kap``, ``doc_id``, ``parca``, ``bas``, ``uzunluk``, ``kova``): the container of each piece, and the bound of its bucket."""
    sized = items.where("tokens > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))).alias("parca"), "tokens")
    bas = F.col("parca") * capacity
    pieces = _numbered(sized.select("doc_id", "parca", bas.alias("bas"), F.least(F.lit(capacity), F.col("tokens") - bas).alias("uzunluk")))
    sums = cut(pieces.groupBy("uzunluk", "pid").agg(F.count("*").alias("n")))
    found = {r["uzunluk"]: r["n"] for r in sums.groupBy("uzunluk").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    bounds = bucket_bounds(found, buckets)
    plan = items.sparkSession.sparkContext.broadcast((np.array(bounds or [capacity]), *_plan(lay_out(found, bounds, capacity))))  # bounded by the capacity
    before = F.sum("n").over(Window.partitionBy("uzunluk").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("uzunluk", "pid", F.coalesce(before, F.lit(0)).alias("before"))
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rows = pieces.join(offsets, ["uzunluk", "pid"]).withColumn("no", F.col("no") + F.col("before"))

    @F.pandas_udf("struct<kap:bigint,kova:int>")
    def container(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        edges, size, start, per, first = plan.value
        shift = np.int64(1) << np.int64(48)
        for s, no in parts:
            at = np.searchsorted(size * shift + start, s.to_numpy(np.int64) * shift + no.to_numpy(np.int64), "right") - 1
            yield pd.DataFrame({"kap": first[at] + (no.to_numpy(np.int64) - start[at]) // per[at], "kova": edges[np.searchsorted(edges, s.to_numpy())].astype(np.int32)})

    return rows.withColumn("k", container("uzunluk", "no")).select("k.kap", "doc_id", "parca", "bas", "uzunluk", "k.kova")


def _sizes(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    sizes = with_token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), path=path)
    return sizes.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(_sizes(spark, sf_dir))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, those of one bucket, tokens, unused room, what padding to the buckets would add, and the least number of containers possible."""
    used = p9_containers(spark, sf_dir)
    each = used.groupBy("kap").agg(F.sum("uzunluk").alias("u"), F.sum(F.col("kova") - F.col("uzunluk")).alias("dolgu"), (F.min("kova") == F.max("kova")).alias("tek"))
    full = each.agg(F.count("*").alias("kaplar"), F.count_if("tek").alias("tek_kova"), F.coalesce(F.sum("u"), F.lit(0)).alias("birim"), F.coalesce(F.sum("dolgu"), F.lit(0)).alias("dolgu"))
    return full.select("kaplar", "tek_kova", "birim", (F.col("kaplar") * CAPACITY - F.col("birim")).alias("bos"), "dolgu", F.ceil(F.col("birim") / CAPACITY).alias("en_az"))


def p9_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with text: tokens that are missing from its pieces (``fazla``, 0 if it is whole) and its containers that are over the capacity (``asan``)."""
    sizes = cut(_sizes(spark, sf_dir))
    used = fill(sizes)
    over = used.groupBy("kap").agg(F.sum("uzunluk").alias("u")).select("kap", (F.col("u") > CAPACITY).cast("int").alias("over"))
    each = used.join(over, "kap").groupBy("doc_id").agg(F.sum("uzunluk").alias("u"), F.sum("over").alias("asan"))
    return each.join(sizes, "doc_id").select("doc_id", (F.col("tokens") - F.col("u")).alias("fazla"), F.col("asan"))
