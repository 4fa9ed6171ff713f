"""One form for texts that look alike (problem 4).

``skeleton``   every text in the form used for comparing: full-width forms as
               plain ones, every space of one width as U+0020, invisible
               characters removed, letters of other scripts that look like Latin
               ones as these, accents composed. Two texts look the same if and
               only if their skeletons are equal. Case, digits, accents, dots and
               raised digits are kept, so different texts stay different.
``canonical``  the same, but words of another script keep their own letters; only
               letters that stand among Latin ones are replaced.

Which letters look the same is Unicode's own mapping of confusable characters, asked
once for each session from the library that Spark ships (:func:`letter_table`).

ASCII texts are their own form and stay in the JVM. Of the others, composition is
needed only where the normalization quick check says no or maybe; there the unstable
characters are isolated with the starter before them, only these segments are
composed, and the results are spliced into the unchanged text.

Defined results: null stays null, empty stays empty; a text of invisible
characters only becomes empty; line breaks and tabs are kept.
"""

from __future__ import annotations

import itertools
import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table

# Characters that take no room (Default_Ignorable_Code_Point), as ranges.
INVISIBLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
INVISIBLE = "".join(chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1))
# Spaces other than U+0020.
SPACES = "               　"


# Letters of the Latin script itself that look like another one, and what the mapping leaves out or reads with a dot.
LATIN_TWINS = "ɑɡﬀﬁﬂﬃﬄﬆ"
ALSO = {"ӏ": "l", "Ү": "Y", "ү": "y"}
DOTTED = "іјϳ"

_known: dict[int, dict[str, str]] = {}


def _single_letters() -> list[str]:
    """Letters that run from left to right and are not wide: those that could stand for a Latin one."""
    blocks = [range(0xB5, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000)]
    return [c for c in map(chr, itertools.chain(*blocks)) if unicodedata.category(c)[0] in "LN" and unicodedata.category(c) not in ("Nd", "No") and unicodedata.bidirectional(c) not in ("R", "AL") and unicodedata.east_asian_width(c) not in "WF"]


def confusable_letters(skeletons: dict[str, str]) -> dict[str, str]:
    """Letters and the Latin ones they look like, from the skeletons of Unicode's mapping.

    A letter stands for a Latin one of its case. Left out are letters of the Latin
    script, those that only lack the dot of i and j, and of two letters of one script
    with the same look the later, as texts in that script must stay apart.
    """
    latin: dict[str, list[str]] = {}
    for c in string.ascii_letters:
        latin.setdefault(skeletons[c], []).append(c)
    out: dict[str, str] = {}
    taken: set[tuple[str, str]] = set()
    for c, look in skeletons.items():
        if c.isascii() or c in ALSO:
            continue
        name, plain = unicodedata.name(c, ""), unicodedata.normalize("NFKC", c)
        script = name.split(" ")[0]
        if plain != c and plain.isascii() and plain.isalpha() and "".join(skeletons[x] for x in plain) == look:
            out[c] = plain  # mathematical letters, ligatures, Roman numerals
            continue
        if look not in latin or (script in ("LATIN", "SMALL", "MODIFIER") and c not in LATIN_TWINS):
            continue
        same = [x for x in latin[look] if x.isupper() == (c.isupper() or not c.islower() and look == "l")] or latin[look]
        if same[0] in "ij" and c not in DOTTED:
            continue
        if c not in LATIN_TWINS and (script, same[0]) in taken:
            continue
        taken.add((script, same[0]))
        out[c] = same[0]
    out.update(ALSO)
    # Letters composed of one of these and accents.
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in out:
            whole = unicodedata.normalize("NFC", out[parts[0]] + parts[1:])
            if len(whole) == 1:
                out[c] = whole
    return out


def letter_table(spark: SparkSession) -> dict[str, str]:
    """:func:`confusable_letters` by the mapping that comes with Spark: a table of bounded size, asked once."""
    key = id(spark.sparkContext)
    if key not in _known:
        asked = [*string.ascii_letters, *_single_letters()]
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        _known[key] = confusable_letters(dict(zip(asked, checker.getSkeleton("\n".join(asked)).split("\n"), strict=True)))
    return _known[key]


@lru_cache(1)
def _widths() -> dict[str, str]:
    """Full-width and half-width forms and spaces."""
    out = {c: " " for c in SPACES}
    for c in map(chr, range(0xFF01, 0xFFEF)):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and len(plain) == 1:
            out[c] = plain
    return out


@lru_cache(1)
def unstable_class() -> str:
    """A character class of what the quick check for composed form does not pass: characters that change, that combine, or that compose with one before."""
    after = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    # Ideographs, syllables of Hangul, surrogates and private characters are stable.
    every = [*range(0xC0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FB00), *range(0xE0000, 0xE1000)]
    for c in every:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and unicodedata.normalize("NFC", chr(c)) == chr(c):
            after.update(map(ord, d[1:]))
    hits = [c for c in every if c in after or unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c)]
    out, start = [], hits[0]
    for a, b in zip(hits, [*hits[1:], -1]):
        if b != a + 1:
            out.append(chr(start) if a == start else f"{chr(start)}-{chr(a)}")
            start = b
    return "".join(out)


@lru_cache(1)
def _segment() -> re.Pattern[str]:
    u = unstable_class()
    return re.compile(f"[^{u}]?[{u}]+")


def compose(text: str) -> str:
    """``text`` in composed form; only unstable segments with the starter before them are touched."""
    return _segment().sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


@lru_cache(1)
def _fold() -> dict[int, str | None]:
    return {ord(c): p for c, p in _widths().items()} | {ord(c): None for c in INVISIBLE}


def folded(text: str) -> str:
    """Widths, spaces and invisible characters folded; composed only where the quick check does not pass."""
    text = text.translate(_fold())
    return text if unicodedata.is_normalized("NFC", text) else compose(text)


_WORDS = re.compile(r"[^\W\d_]{2,}")


class Forms:
    """The forms of texts by one table of letters."""

    def __init__(self, letters: dict[str, str]):
        self.letters = {ord(c): p for c, p in letters.items()}
        alike = "[" + "".join(letters) + "]"
        latin = "[A-Za-zÀ-ɏ]"
        self.mixed = re.compile(f"{latin}{alike}|{alike}{latin}").search

    def skeleton(self, text: str) -> str:
        """The form of ``text`` to compare by. Letters are replaced before and after composition, as accents may stand on them."""
        if text.isascii():
            return text
        plain = folded(text).translate(self.letters)
        return plain if unicodedata.is_normalized("NFC", plain) else compose(plain)

    def canonical(self, text: str) -> str:
        """The form of ``text`` to keep: as the skeleton, but only words that mix scripts get other letters."""
        if text.isascii():
            return text
        text = folded(text)
        return _WORDS.sub(lambda m: m.group().translate(self.letters) if self.mixed(m.group()) else m.group(), text) if self.mixed(text) else text


def _apply(col: Column, name: str, letters: dict[str, str]) -> Column:
    """ASCII texts are their own form and never leave the JVM."""

    @F.pandas_udf("string")
    def form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        change = getattr(Forms(letters), name)
        for s in parts:
            yield s.map(lambda t: None if t is None else change(t))

    return F.coalesce(form(F.when(F.octet_length(col) != F.length(col), col)), col)


def with_forms(df: DataFrame, text: str, skeleton: str | None = "skeleton", canonical: str | None = None) -> DataFrame:
    """``df`` with one or both forms of ``text``; columns of those names are replaced."""
    col = F.col(f"`{text}`")
    letters = letter_table(df.sparkSession)
    made = {out: _apply(col, kind, letters) for kind, out in (("skeleton", skeleton), ("canonical", canonical)) if out}
    return df.withColumns(made)


def look_alike_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of rows of (``alan``, ``no``, ``metin``) whose texts look the same but are stored differently.

    Rows are reduced to two digests before any shuffle. Only classes that hold
    more than one stored form are joined with themselves, so exact copies, however
    many, produce nothing among themselves. Null texts are in no pair; identical
    rows count once.
    """
    keyed = with_forms(texts.where(F.col("metin").isNotNull()), "metin").select("alan", "no", F.unhex(F.md5("skeleton")).alias("look"), F.unhex(F.md5("metin")).alias("stored"))
    keyed = cut(keyed)
    mixed = keyed.groupBy("alan", "look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("alan", "look")
    rows = keyed.join(mixed, ["alan", "look"], "left_semi").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.alan") == F.col("b.alan")) & (F.col("a.look") == F.col("b.look")) & (F.col("a.no") < F.col("b.no")) & (F.col("a.stored") != F.col("b.stored")))
    return pairs.select(F.col("a.alan").alias("alan"), F.col("a.no").alias("no_a"), F.col("b.no").alias("no_b")).distinct()


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pasaj").select(F.lit("metin").alias("alan"), F.col("pasaj_no").alias("no"), "metin")
    m = table(spark, sf_dir, "onbellek").select(F.lit("markdown").alias("alan"), F.col("kayit_no").alias("no"), F.col("markdown").alias("metin"))
    return p.unionByName(m)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(_both(spark, sf_dir))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables in its one form, with the digest to compare by."""
    made = with_forms(_both(spark, sf_dir), "metin", "skeleton", "canonical")
    return made.select("alan", "no", F.col("canonical").alias("metin"), F.md5("skeleton").alias("anahtar"))
