"""Oversized items cut into overlapping pieces (problem 3).

Content-defined chunking: a rolling hash over the characters before each place
marks landmarks; the cut snaps from the landmark to the nearest boundary of the
coarsest kind that occurs between the minimum and the maximum size: blank line,
line break, sentence end, white space. Only where the window has none of these is
the text cut at the landmark itself, then never between a character and its
combining marks unless nothing else is left. As a cut depends only on the text
around it, an edit changes only the pieces next to it.

A piece is ``overlap`` code points at most of the end of the piece before, plus
its own body; both together stay within ``limit``. The bodies in order are the
text, so nothing is lost. Items within the limit give one piece, null and empty
texts give one piece with that text. Rows that occur twice give pieces twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

LIMIT, OVERLAP, LEAST = 800, 80, 240
WINDOW = 16

_PARAGRAPH = re.compile(r"\n(?:[ \t]*\n)+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…।؟]+[\"'”’»)\]]*\s+|[。！？][」』”’）]*")
_SPACE = re.compile(r"\s+")
_LEVELS = (_PARAGRAPH, _LINE, _SENTENCE, _SPACE)


def boundaries(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the boundaries of each kind in ``text``: blank lines, line breaks, sentence ends, white space."""
    out = []
    for level in _LEVELS:
        found = np.array([m.span() for m in level.finditer(text)], np.int64).reshape(-1, 2)
        out.append((found[:, 0], found[:, 1]))
    return out


def coarsest_boundary(text: str, limit: int = LIMIT, found: list[tuple[np.ndarray, np.ndarray]] | None = None) -> str:
    """The coarsest kind of boundary that suffices to cut ``text``: every stretch between two of it is within ``limit``."""
    paragraph, line, _, space = found or boundaries(text)
    for name, (starts, ends) in (("paragraph", paragraph), ("line", line), ("space", space)):
        if int((np.append(starts, len(text)) - np.concatenate(([0], ends))).max()) <= limit:
            return name
    return "none"


def _landmarks(text: str) -> np.ndarray:
    """A hash of the ``WINDOW`` characters before each place."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(a) + 1, np.uint64)
    for back in range(min(WINDOW, len(a))):
        h[back + 1 :] += a[: len(a) - back] * np.uint64(pow(0x5851F42D4C957F2D, back, 1 << 64))
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def cut_places(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, found: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[int]:
    """Where the bodies of the pieces of ``text`` end; the last is its length."""
    n = len(text)
    if n <= limit:
        return [n]
    marks = _landmarks(text)
    ends = [e for _, e in found or boundaries(text)]
    out, at, room = [], 0, limit
    while n - at > room:
        lo, hi = at + least, at + room
        mark = hi - int(np.argmin(marks[lo : hi + 1][::-1]))  # of equal ones the last, for the fewest pieces
        place = 0
        for level in ends:
            i, j = np.searchsorted(level, (lo, hi + 1))
            if i < j:
                near = level[i:j]
                place = int(near[np.argmin(np.abs(near - mark))])
                break
        else:
            place = mark
            while place > lo and place < n and unicodedata.combining(text[place]):
                place -= 1
        out.append(place)
        at, room = place, limit - overlap
    out.append(n)
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, found: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece."""
    out, at = [], 0
    for end in cut_places(text, limit, overlap, least, found):
        start = max(0, at - overlap)
        if 0 < start < at:  # the repeated part begins after white space, where it has any
            space = _SPACE.search(text, start, at)
            if space and space.end() < at:
                start = space.end()
        out.append((start, at, end))
        at = end
    return out


def with_pieces(df: DataFrame, text: str = "metin", limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """One row for each piece of each row of ``df``: its columns with ``text`` cut, and ``parca`` (from 0), ``bas`` (where the piece starts), ``govde`` (where its own part starts), ``sinir`` (null within the limit).

    Rows within the limit never leave the JVM; the others are cut by an Arrow
    function and keep their partition, so nothing is shuffled.
    """
    cut = "array<struct<parca:int,bas:int,govde:int,metin:string,sinir:string>>"

    @F.pandas_udf(cut)
    def cut_up(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for t in s:
                if t is None:
                    out.append(None)
                    continue
                found = boundaries(t)
                kind = coarsest_boundary(t, limit, found)
                out.append([{"parca": i, "bas": a, "govde": b, "metin": t[a:e], "sinir": kind} for i, (a, b, e) in enumerate(pieces(t, limit, overlap, least, found))])
            yield pd.Series(out, dtype=object)

    col = F.col(f"`{text}`")
    made = cut_up(F.when(F.length(col) > limit, col))
    whole = F.array(F.struct(F.lit(0).alias("parca"), F.lit(0).alias("bas"), F.lit(0).alias("govde"), col.alias("metin"), F.lit(None).cast("string").alias("sinir")))
    taken = {"parca", "bas", "govde", "sinir", "__p", text}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    rows = df.select(*rest, F.explode(F.coalesce(made, whole)).alias("__p"))
    return rows.select(*rest, F.col("__p.metin").alias(text), "__p.parca", "__p.bas", "__p.govde", "__p.sinir")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_pieces(table(spark, sf_dir, "pasaj", "pasaj_no", "metin"))
    return made.where("sinir is not null and parca = 0").select("pasaj_no", "sinir").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages as numbered pieces, in the order of ``sira``; identical rows once."""
    made = with_pieces(table(spark, sf_dir, "pasaj").dropDuplicates(["pasaj_no"]))
    return made.select("pasaj_no", "url", "sira", "parca", "bas", "govde", "metin")


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each passage keep their promises: sizes, overlaps, and a digest of the bodies put together again."""
    made = with_pieces(table(spark, sf_dir, "pasaj", "pasaj_no", "metin").dropDuplicates(["pasaj_no"]))
    own = F.col("metin").substr(F.col("govde") - F.col("bas") + 1, F.length("metin"))
    rows = made.withColumn("own", own).groupBy("pasaj_no").agg(
        F.max(F.length("metin")).alias("en_uzun"), F.max(F.col("govde") - F.col("bas")).alias("ortusme"), F.array_sort(F.collect_list(F.struct("parca", "own"))).alias("p"), F.count("*").alias("n")
    )
    right = (F.col("en_uzun") <= LIMIT) & (F.col("ortusme") <= OVERLAP) & (F.col("p.parca") == F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: i - 1))
    return rows.select("pasaj_no", right.alias("tutar"), (F.col("n") > 1).alias("bolundu"), F.md5(F.array_join("p.own", "")).alias("ozet"))
