"""Long spans that stand verbatim in more than one document (problem 10).

1. Every document is reduced to fingerprints: the smallest hash of 64 characters in
   each run of 137 such hashes. Every span of 200 characters holds one, and the same
   one in every document, so documents without a common fingerprint need no more work.
2. For each shared fingerprint the smallest document that has it is the reference;
   what surrounds the shared fingerprints of a reference is its shard.
3. The shards are turned into suffix automata, and the surroundings of the same
   fingerprints in other documents are streamed through them. The matching statistics
   give for each place the longest match that ends there; from 200 characters on,
   the automaton's state at length 200 names the span, equal in every document.
4. Stretches around a shared fingerprint that are not in its reference leave as one
   row each. They are reduced to finer fingerprints (128 characters in each run of
   73), and only stretches that have one in common with another document are matched
   by the digests of their 200 characters.

A shard is sent once for each ``STREAMED`` documents that are streamed through it, in
the same partition and ahead of them, so a reference that a third of all documents
share is split; no group of documents is collected. Documents with the same text (by
128-bit digests) are one class, named by its smallest document, until the very end.
Fingerprints are 64-bit hashes, which only choose what is compared.

Defined results: null, empty and short texts share nothing; a span repeated in one
document only is no case; rows that occur twice count once; case, line breaks and
white space count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded, cut, free, table
from .hashing import Prefix, window_minima

SPAN, GRAM, FINE = 200, 64, 128
#: Documents that are streamed through one copy of a shard.
STREAMED = 512
#: Shared marks up to which their documents are broadcast; more are joined by a shuffle.
BROADCAST_MARKS = 500_000
#: Places of a reference that are joined as one block.
BLOCK = 512


class Automaton:
    """The suffix automaton of one or more texts, with the end of a first occurrence for each state."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def add(self, text: str, at: int) -> None:
        """Add ``text``, whose first character is at ``at`` in the reference."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for i, c in enumerate(text, at):
            p = last
            q = nxt[p].get(c)
            if q is not None:  # texts after the first may walk along states that exist
                if length[q] == length[p] + 1:
                    last = q
                    continue
                last = self._clone(p, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[p] + 1)
            first.append(i)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: str) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def stream(self, text: str, least: int) -> list[int]:
        """For each place of ``text`` where a match of ``least`` characters ends, where these end in the reference; -1 elsewhere."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, n, out = 0, 0, [-1] * len(text)
        for i, c in enumerate(text):
            step = nxt[state].get(c)
            while step is None:
                state = link[state]
                if state < 0:
                    state, n = 0, 0
                    break
                n = length[state]
                step = nxt[state].get(c)
            else:
                state, n = step, n + 1
                if n >= least:
                    while length[link[state]] >= least:
                        state = link[state]
                        n = length[state]
                    out[i] = first[state]
        return out


def fingerprints(text: str, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of ``text``."""
    if len(text) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = Prefix(text).windows(gram)
    at = window_minima(h, SPAN - gram + 1)
    return at, h[at]


def _postings(docs: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids, marks = [], []
            for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                h = np.unique(fingerprints(t)[1])
                ids.append(np.full(len(h), i, np.int64))
                marks.append(h.view(np.int64))
            if ids:
                yield pd.DataFrame({"cid": np.concatenate(ids), "mark": np.concatenate(marks)})

    return docs.select("doc_id", "text").mapInPandas(run, "cid bigint, mark bigint")


def _regions(docs: DataFrame) -> DataFrame:
    """(``ref``, ``salt``, ``cid``, ``parts``, ``streamed``): what surrounds the marks of each reference in each document, merged where it touches, with the places of the marks; and the reference's own as a shard, not to be streamed, for each salt."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for cid, t, pairs in zip(pdf["cid"], pdf["text"], pdf["marks"]):
                at, h = fingerprints(t)
                to = {p["mark"]: (p["ref"], p["copies"]) for p in pairs}
                by_ref: dict[tuple[int, int], list[list[int]]] = {}
                for p, m in zip(at.tolist(), h.view(np.int64).tolist()):
                    ref = to.get(m)
                    if ref is None:
                        continue
                    lo, hi = max(0, p - (SPAN - GRAM)), min(len(t), p + SPAN)
                    spans = by_ref.setdefault(ref, [])
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = hi
                        spans[-1].append(p)
                    else:
                        spans.append([lo, hi, p])
                for (ref, copies), spans in by_ref.items():
                    parts_ = [{"at": s[0], "text": t[s[0] : s[1]], "marks": s[2:]} for s in spans]
                    out.append((ref, cid % copies, cid, parts_, True))
                    if ref == cid:
                        out += [(ref, salt, cid, parts_, False) for salt in range(copies)]
            yield pd.DataFrame(out, columns=["ref", "salt", "cid", "parts", "streamed"])

    return docs.mapInPandas(run, "ref bigint, salt int, cid bigint, parts array<struct<at:int,text:string,marks:array<int>>>, streamed boolean")


def _rest(ends: np.ndarray, marks: list[int], base: int) -> list[tuple[int, int]]:
    """Runs [a, b) of starts of spans that hold a mark and are not in the reference."""
    left = ends[SPAN - 1 :] < 0
    near = np.zeros(len(left) + 1, np.int64)
    for p in marks:
        near[max(0, p - base - (SPAN - GRAM))] += 1
        near[min(len(left), p - base + 1)] -= 1
    left &= np.cumsum(near[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], left, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _matches(regions: DataFrame) -> DataFrame:
    """Matched runs: with ``rest`` null a run of ends of spans, [``own``, ``own`` + ``size``) in the document and [``at``, ``at`` + ``size``) in the reference; else ``size`` starts of spans from ``own`` on that are not in the reference, in the text ``rest``.

    The rows of a reference follow a copy of its shard in each partition.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sam = None, Automaton()
        for pdf in frames:
            out: list[tuple] = []
            for ref, salt, cid, parts, streamed in zip(pdf["ref"], pdf["salt"], pdf["cid"], pdf["parts"], pdf["streamed"]):
                if (ref, salt) != known:
                    known, sam = (ref, salt), Automaton()
                if not streamed:
                    for part in parts:
                        sam.add(part["text"], part["at"])
                    continue
                for part in parts:
                    text, base = part["text"], part["at"]
                    ends = np.array(sam.stream(text, SPAN), np.int64)
                    hit = np.flatnonzero(ends >= 0)
                    if len(hit):
                        breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(ends[hit]) != 1)) + 1
                        for g in np.split(hit, breaks):
                            out.append((ref, cid, int(ends[g[0]]), int(g[0]) + base, len(g), None))
                    if len(text) >= SPAN:
                        out += [(ref, cid, -1, a + base, b - a, text[a : b + SPAN - 1]) for a, b in _rest(ends, part["marks"], base)]
            yield pd.DataFrame(out, columns=["ref", "cid", "at", "own", "size", "rest"])

    sorted_ = regions.repartition("ref", "salt").sortWithinPartitions("ref", "salt", "streamed")
    return sorted_.mapInPandas(run, "ref bigint, cid bigint, at bigint, own int, size int, rest string")


def shared_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (``doc_id``, ``text``): the classes (``doc_id``, ``cid``, ``n``) of documents long enough, the matched runs of classes, and the spans (``cid``, ``own``, ``name``) that two classes share but their reference has not."""
    long = docs.select("doc_id", "text").where(F.length("text") >= SPAN)
    named = cut(long.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.length("text").alias("n")).distinct())
    heads = named.groupBy("digest").agg(F.min("doc_id").alias("cid"))
    members = cut(named.join(heads, "digest").select("doc_id", "cid", "n"))
    copies = members.where("doc_id <> cid").select(F.col("doc_id").alias("cid"))  # of a text, only the first document takes part
    postings = cut(_postings(long).join(bounded(copies), "cid", "left_anti"))
    refs = postings.groupBy("mark").agg(F.min("cid").alias("ref"), F.max("cid").alias("top")).where("ref <> top").select("mark", "ref")
    met = cut(postings.join(refs, "mark"))
    load = met.groupBy("ref").agg((F.floor(F.count("*") / STREAMED) + 1).cast("int").alias("copies"))  # a document counts once for each mark: at least
    wanted = met.join(load, "ref").groupBy("cid").agg(F.collect_set(F.struct("mark", "ref", "copies")).alias("marks"))
    if met.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS:
        wanted = F.broadcast(wanted)
    # A text that occurs twice is cut up once.
    texts = long.join(wanted, long.doc_id == wanted.cid).select("cid", "text", "marks").dropDuplicates(["cid"])
    runs = cut(_matches(_regions(texts)))
    free(postings)
    free(met)
    return members, runs.where("rest is null").drop("rest"), cut(_unreferenced(runs.where("rest is not null").select("cid", "own", "rest")))


def _unreferenced(rest: DataFrame) -> DataFrame:
    """(``cid``, ``own``, ``name``): spans of the stretches ``rest`` that stand in two documents, by their start and digest."""

    def fine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for cid, own, t in zip(pdf["cid"], pdf["own"], pdf["rest"]):
                out += [(cid, own, m) for m in np.unique(fingerprints(t, FINE)[1]).view(np.int64).tolist()]
            yield pd.DataFrame(out, columns=["cid", "own", "mark"])

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for cid, own, t in zip(pdf["cid"], pdf["own"], pdf["rest"]):
                out += [(cid, own + i, hashlib.md5(t[i : i + SPAN].encode("utf-8", "surrogatepass")).digest()) for i in range(len(t) - SPAN + 1)]
            yield pd.DataFrame(out, columns=["cid", "own", "name"])

    twice = lambda rows, name: rows.groupBy(name).agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select(name)
    marks = cut(rest.mapInPandas(fine, "cid bigint, own int, mark bigint"))
    kept = marks.join(twice(marks, "mark"), "mark").select("cid", "own").distinct()
    named = cut(rest.join(kept, ["cid", "own"], "left_semi").dropDuplicates(["cid", "own", "rest"]).mapInPandas(spans, "cid bigint, own int, name binary"))
    return named.join(twice(named, "name"), "name").select("cid", "own", "name").distinct()


def class_pairs(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of classes, ``a < b``, that share a span."""
    span = cut(runs.select("ref", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"), "cid").distinct())
    # Runs of a reference meet where they touch, block by block, before classes do.
    kinds = span.select("ref", "lo", "hi").distinct().withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))))
    x, y = kinds.toDF("ref", "lo_x", "hi_x", "block"), kinds.toDF("ref", "lo_y", "hi_y", "block")
    touch = x.join(y, ["ref", "block"]).where("lo_x < hi_y and lo_y < hi_x and (lo_x, hi_x) <= (lo_y, hi_y)").select("ref", "lo_x", "hi_x", "lo_y", "hi_y").distinct()
    at = span.select("ref", "lo", "hi", "cid")
    inner = touch.join(at.toDF("ref", "lo_x", "hi_x", "cx"), ["ref", "lo_x", "hi_x"]).join(at.toDF("ref", "lo_y", "hi_y", "cy"), ["ref", "lo_y", "hi_y"]).where("cx <> cy").select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b"))
    own = spans.select("name", "cid").distinct()
    u, v = own.toDF("name", "a"), own.toDF("name", "b")
    return inner.unionByName(u.join(v, "name").where("a < b").select("a", "b")).distinct()


def document_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    x, y = members.alias("x"), members.alias("y")
    same = x.join(y, (F.col("x.cid") == F.col("y.cid")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"))
    m = members.select("doc_id", "cid")
    one = pairs.join(m.toDF("da", "a"), "a").join(m.toDF("db", "b"), "b").select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))
    return same.unionByName(one)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, runs, spans = shared_runs(table(spark, sf_dir, "documents", "doc_id", "text"))
    return document_pairs(members, class_pairs(runs, spans))


def _merged(col: str) -> Column:
    """An array of structs (lo, hi) in order, with those that touch as one."""
    kind = "array<struct<lo:bigint,hi:bigint>>"

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(out) > 0) & (x["lo"] <= last["hi"]), longer).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(F.col(col)), F.array().cast(kind), step)


def shared_intervals(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """(``cid``, ``araliklar``, ``fazla``): the maximal stretches [lo, hi) of each class that another class has too, and those of them that a reference or a smaller class keeps.

    Of the stretches with the same start only the longest goes on before the shuffle, so
    a document has no more of them than characters.
    """
    lo, hi = (F.col("own") - (SPAN - 1)).cast("bigint"), (F.col("own") + F.col("size")).cast("bigint")
    longest = lambda rows, keys: rows.groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    theirs = longest(runs.where("cid <> ref").select("cid", lo.alias("lo"), hi.alias("hi")), ["cid"])
    o = longest(runs.where("cid <> ref").select("ref", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi")), ["ref"]).toDF("ref", "from", "to")
    r = runs.where("cid = ref").select("ref", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"), (F.col("own") - F.col("at")).alias("shift"))
    blocks = lambda rows, a, b: rows.withColumn("block", F.explode(F.sequence(F.floor(F.col(a) / BLOCK), F.floor((F.col(b) - 1) / BLOCK))))
    met = blocks(r, "lo", "hi").join(blocks(o, "from", "to"), ["ref", "block"]).where("from < hi and lo < to")
    ours = met.select(F.col("ref").alias("cid"), (F.greatest("lo", "from") + F.col("shift") - (SPAN - 1)).alias("lo"), (F.least("hi", "to") + F.col("shift")).alias("hi"))
    first = spans.groupBy("name").agg(F.min("cid").alias("keeper"))
    rest = spans.join(first, "name").select("cid", F.col("own").cast("bigint").alias("lo"), (F.col("own") + SPAN).cast("bigint").alias("hi"), (F.col("cid") != F.col("keeper")).alias("spare"))
    each = theirs.withColumn("spare", F.lit(True)).unionByName(ours.withColumn("spare", F.lit(False))).unionByName(rest)
    both = longest(each, ["cid", "spare"])
    pair = F.struct("lo", "hi")
    return both.groupBy("cid").agg(F.collect_list(pair).alias("all"), F.collect_list(F.when(F.col("spare"), pair)).alias("over")).select("cid", _merged("all").alias("araliklar"), _merged("over").alias("fazla"))


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    members, runs, spans = shared_runs(docs)
    copies = members.groupBy("cid").agg(F.count_distinct("doc_id").alias("copies"))
    return docs, members.join(copies, "cid").join(shared_intervals(runs, spans), "cid", "left")


def _length(col: str) -> Column:
    return F.coalesce(F.aggregate(col, F.lit(0).cast("bigint"), lambda s, x: s + x["hi"] - x["lo"]), F.lit(0))


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of its code points in a span that another document has too."""
    docs, known = _known(spark, sf_dir)
    covered = known.select("doc_id", F.when(F.col("copies") > 1, F.col("n").cast("bigint")).otherwise(_length("araliklar")).alias("ortak"))
    return docs.select("doc_id").distinct().join(covered, "doc_id", "left").select("doc_id", F.coalesce("ortak", F.lit(0)).alias("ortak"))


def p10_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the spans that another one keeps: (``doc_id``, ``metin``, ``cikan``).

    A span stays where it is named: in its reference, or else in the smallest document
    that has it. The reference may lose part of it to a reference of its own, so a span
    may come to stand in two documents, one part in each. Of documents with the same text the smallest keeps it, the others are
    left empty. Null texts stay null; texts below the span's length stay as they are.
    """
    docs, known = _known(spark, sf_dir)
    cuts = known.select("doc_id", (F.col("doc_id") != F.col("cid")).alias("copy"), "fazla")
    rows = docs.groupBy("doc_id").agg(F.max("text").alias("text")).join(cuts, "doc_id", "left")
    # What stands before, between and after the stretches that go.
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("fazla", lambda x: x["hi"]))
    ends = F.concat(F.transform("fazla", lambda x: x["lo"]), F.array(F.length("text").cast("bigint")))
    left = F.array_join(F.zip_with(edges, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    kept = F.when(F.col("copy"), "").when(F.size("fazla") > 0, left).otherwise(F.col("text"))
    return rows.withColumn("metin", kept).select("doc_id", "metin", F.coalesce(F.length("text") - F.length("metin"), F.lit(0)).cast("bigint").alias("cikan"))
