"""Pages that share nearly all their wording (problem 2).

An exact similarity join on runs of words, by filters under several global orders:

1. One pass over all passages counts runs of words into a sketch of fixed size
   (``SKETCH`` counters, whatever the input), so that orders can put rare runs first.
2. A page has, for each of ``ORDERS`` global orders (rarity class first, then another
   scrambling of the run's hash each), the prefix that two similar pages must share.
3. Candidates share prefix runs under the first order and fit in size. Under every order
   two similar pages must share more runs than their prefixes are longer than the shortest
   lossless one; candidates that do not are dropped before verification.
4. The runs of the remaining pages are compared in full.

Any global order gives a lossless prefix filter, so neither the sketch's collisions
nor its size can lose a pair. Pages with the same set of runs are collapsed to one
class first: a group of copies, however large, is one row in the joins.

Defined results: null passages count as empty; rows that occur twice count once;
pages with fewer than eight words have no runs and are in no pair; columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, free, table
from .components import components
from .hashing import Prefix, mix

WORDS, LEAST = 8, 0.85
SKETCH = 1 << 20
ORDERS = 3
#: By how many runs the prefix of the first order is longer than need be; candidates share one more than that.
FIRST_LONGER = 6
#: By which part of a page's runs the prefixes of the orders after the first are longer than need be.
LONGER = 0.1
#: Rows up to which a list of class ids is broadcast; longer ones are shuffled.
BROADCAST_ROWS = 200_000

_ADDRESS = re.compile(r"https?://\S+|www\.\S+")
_OTHER = re.compile(r"\W+")
_GAP = 32


def all_runs(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of all runs of ``words`` consecutive words of ``text``, by place."""
    plain = _OTHER.sub(" ", _ADDRESS.sub(" ", text.lower())).strip()
    if not plain:
        return np.empty(0, np.uint64)
    p = Prefix(plain)
    if plain.isascii():
        gaps = np.flatnonzero(np.frombuffer(plain.encode(), np.uint8) == _GAP)
    else:
        gaps = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32) == _GAP)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.append(gaps, p.n)
    if len(starts) < words:
        return np.empty(0, np.uint64)
    return p.stretches(starts[: len(starts) - words + 1], ends[words - 1 :])


def runs(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of ``words`` consecutive words of ``text``."""
    return np.unique(all_runs(text, words))


def frequency_sketch(passages: DataFrame, text: str, words: int = WORDS) -> np.ndarray:
    """Counts of runs of words by hash, over all rows of ``passages``, in ``SKETCH`` counters.

    The passages of a batch are counted as one text; the few runs across their borders
    are noise that the order may carry.
    """
    blocks = 64

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH, np.int64)
        for pdf in parts:
            h = all_runs("\n".join(t for t in pdf.iloc[:, 0] if t), words)
            total += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        short = np.minimum(total, 65535).astype(np.uint16)
        yield pd.DataFrame({"block": range(blocks), "counts": [b.tobytes() for b in short.reshape(blocks, -1)]})

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.uint16).astype(np.int64) for b in pdf["counts"])
        return pd.DataFrame({"block": [key[0]], "counts": [total.astype(np.uint32).tobytes()]})

    schema = "block int, counts binary"
    parts = passages.select(text).mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros((blocks, SKETCH // blocks), np.uint32)
    for row in parts:
        out[row["block"]] = np.frombuffer(row["counts"], np.uint32)
    return out.ravel()


def _levels(sketch: np.ndarray) -> np.ndarray:
    """Rarity classes: 0 for what is as frequent as a counter on average, then two to each doubling."""
    return np.floor(np.log2(np.maximum(sketch / max(1.0, float(sketch.mean())), 1.0)) * 2).astype(np.int8)


def _prefix(h: np.ndarray, level: np.ndarray, order: int, keep: int) -> np.ndarray:
    rarity = level[(h % np.uint64(SKETCH)).astype(np.int64)]
    return h[np.lexsort((mix(h, order), rarity))[:keep]]


def _shortest(n: int, least: float) -> int:
    """Length of the shortest lossless prefix of ``n`` runs."""
    return n - int(np.ceil(least * n - 1e-9)) + 1


def page_texts(passages: DataFrame, key: str = "url", order: str = "sira", tie: str = "pasaj_no", text: str = "metin") -> DataFrame:
    """(``key``, ``text``): the passages of each page in order, joined by line breaks."""
    rows = passages.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), F.coalesce(text, F.lit("")).alias("m")))).alias("p"))
    return rows.select(key, F.array_join(F.col("p.m"), "\n").alias("text"))


def _signatures(pages: DataFrame, key: str, level, words: int, least: float) -> DataFrame:
    """(``key``, ``set``, ``n``, ``run``): a digest of the runs of each page, their number, and its prefix under the first order."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lv = level.value
        for pdf in parts:
            out = []
            for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                h = runs(t, words)
                if len(h):
                    digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                    out.append((k, digest, len(h), _prefix(h, lv, 0, _shortest(len(h), least) + FIRST_LONGER).view(np.int64)))
            yield pd.DataFrame(out, columns=[key, "set", "n", "run"])

    return pages.select(key, "text").mapInPandas(sign, f"{key} string, set binary, n int, run array<bigint>")


def _compared(pages: DataFrame, key: str, level, words: int, least: float) -> DataFrame:
    """(``key``, ``n``, ``runs``, ``p1``, ...): the runs of each page, and its longer prefixes under the orders after the first, by the lower halves of their hashes."""

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lv = level.value
        for pdf in parts:
            out = []
            for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                h = runs(t, words)
                keep = _shortest(len(h), least) + int(LONGER * len(h))
                out.append((k, len(h), h.view(np.int64), *(_prefix(h, lv, i, keep).astype(np.uint32).view(np.int32) for i in range(1, ORDERS))))
            yield pd.DataFrame(out, columns=[key, "n", "runs", *(f"p{i}" for i in range(1, ORDERS))])

    schema = f"{key} string, n int, runs array<bigint>, " + ", ".join(f"p{i} array<int>" for i in range(1, ORDERS))
    return pages.select(key, "text").mapInPandas(sets, schema)


def similar_classes(passages: DataFrame, words: int = WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Classes of pages with the same runs, (``url``, ``cls``), and pairs of similar classes, (``a``, ``b``, ``benzerlik``) with ``a < b``; a class id is the smallest url of the class."""
    level = passages.sparkSession.sparkContext.broadcast(_levels(frequency_sketch(passages, "metin", words)))
    signed = cut(_signatures(page_texts(passages), "url", level, words, least))
    heads = cut(signed.groupBy("set").agg(F.min("url").alias("cls")))
    members = cut(signed.select("url", "set").join(heads, "set").select("url", "cls"))
    classes = signed.join(heads.select(F.col("cls").alias("url")), "url", "left_semi")
    posting = cut(classes.select(F.explode("run").alias("run"), F.xxhash64("url").alias("cid"), "n"))
    free(signed)
    shared = posting.groupBy("run").agg(F.count("*").alias("df")).where("df > 1").select("run")
    lists = cut(posting.join(shared, "run"))
    free(posting)
    a, b = lists.alias("a"), lists.alias("b")
    fits = (F.least("a.n", "b.n") >= F.lit(least) * F.greatest("a.n", "b.n") - 1e-9) & (F.col("a.cid") < F.col("b.cid"))
    hits = a.join(b, (F.col("a.run") == F.col("b.run")) & fits).groupBy(F.col("a.cid").alias("ca"), F.col("b.cid").alias("cb")).agg(F.count("*").alias("hits"), F.min(F.least("a.n", "b.n")).alias("n"))
    met = cut(hits.where(F.col("hits") >= F.least(F.lit(FIRST_LONGER + 1), F.ceil(F.col("n") * least - 1e-9))).select("ca", "cb"))
    free(lists)
    wanted = met.select(F.explode(F.array("ca", "cb")).alias("cid")).distinct()
    # Classes whose hashed ids are equal, should there ever be some, all stay candidates.
    named = cut(heads.select(F.col("cls").alias("url"), F.xxhash64("cls").alias("cid")).join(wanted, "cid"))
    free(heads)
    texts = page_texts(passages.join(_bounded(named.select("url")), "url", "left_semi"))
    known = cut(_compared(texts, "url", level, words, least).join(_bounded(named), "url"))
    short = known.drop("runs")
    both = met.join(short.select(*(F.col(c).alias(f"{c}_a") for c in short.columns)), F.col("ca") == F.col("cid_a"))
    both = both.join(short.select(*(F.col(c).alias(f"{c}_b") for c in short.columns)), F.col("cb") == F.col("cid_b"))
    need = F.floor(F.least("n_a", "n_b") * LONGER)  # one less than the filter's bound, for runs with the same lower half
    for i in range(1, ORDERS):
        both = both.where(F.size(F.array_intersect(f"p{i}_a", f"p{i}_b")) >= need)
    pairs = cut(both.select(F.least("url_a", "url_b").alias("a"), F.greatest("url_a", "url_b").alias("b")))
    full = known.select("url", "runs")
    joined = pairs.join(full.toDF("a", "ra"), "a").join(full.toDF("b", "rb"), "b")
    common = F.size(F.array_intersect("ra", "rb"))
    scored = joined.select("a", "b", (common / (F.size("ra") + F.size("rb") - common)).alias("benzerlik"))
    out = cut(scored.where(F.col("benzerlik") >= least))
    for done in (met, named, known, pairs):
        free(done)
    return members, out


def _bounded(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if it is short; its length is checked first."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def page_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of different pages: of one class, and of two similar classes."""
    x, y = members.alias("x"), members.alias("y")
    same = x.join(y, (F.col("x.cls") == F.col("y.cls")) & (F.col("x.url") < F.col("y.url"))).select(F.col("x.url").alias("url_a"), F.col("y.url").alias("url_b"))
    one = pairs.join(members.toDF("ua", "a"), "a").join(members.toDF("ub", "b"), "b").select(F.least("ua", "ub").alias("url_a"), F.greatest("ua", "ub").alias("url_b"))
    return same.unionByName(one)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pasaj", "url", "sira", "pasaj_no", "metin")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pairs(*similar_classes(_passages(spark, sf_dir)))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its class, its group of near copies and the number of classes its class is linked to."""
    members, pairs = similar_classes(_passages(spark, sf_dir))
    roots = components(pairs).withColumnRenamed("key", "cls")
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("baglanti"))
    return members.join(roots, "cls", "left").join(links, "cls", "left").select("url", F.col("cls").alias("sinif"), F.coalesce("root", "cls").alias("kopya_grubu"), F.coalesce("baglanti", F.lit(0)).alias("baglanti"))
