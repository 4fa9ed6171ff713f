"""Sentence units in many languages and scripts (problem 7).

Every place where a sentence could end is a candidate: closing punctuation with what
may follow it, line breaks, and white space in Thai. A candidate is taken or left by a
maximum-entropy model over the tokens next to it, their case, length, digits and
script (``sentences_model.json``; :mod:`attestra.llm.sentences_fit` trains it on
boundaries that are reliable: ends of lines and texts, and points that the next word
shows to be none). Two rules of writing come before the model: there is no boundary
inside a quotation, and scripts with a closing mark of their own end at that mark.
Where no language is given, every paragraph, and every stretch of it in another script,
is told its own. A token's features are those of its last 24 characters.

Offsets are code points of the stored text. Defined results: null and empty texts
give no sentence; blank texts give none; white space belongs to no sentence; a text
without any boundary is one sentence; identical rows count once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

BUCKETS = 1 << 14

# Marks by their use.
OPEN, CLOSE = "“„«「『‹(（[【《〈", "”»」』›)）]】》〉"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"'}
QUOTES = '"“„«「『‹'
WIDE_STOPS = "。！？｡"
OWN_STOPS = "।॥؟۔"
STOPS = ".!?…" + OWN_STOPS + WIDE_STOPS

_CANDIDATE = re.compile(rf"[{STOPS}]+|\n+")
_INVISIBLE = "​‌‍⁠﻿­"
_THAI = re.compile("[฀-๿]")
_WORD = re.compile(r"[^\s\"“”„«»「」『』()（）\[\]…!?.,;:、，]+(?:['’.][^\s\"“”„«»「」『』()（）\[\]…!?.,;:、，]+)*\Z")
_UNCASED = ("ar", "hi")
_TOKEN = re.compile(r"[^\s]+")
_GAP = re.compile(r"\s*")
_BLOCK = re.compile(r"\s*(?:#{1,6}\s|[-*+]\s|\||>\s|```|~~~|\d{1,3}[.)]\s)")


def _quotation_depth(text: str) -> list[int]:
    """For each place, 0 outside quotations and brackets, else the place after which the outermost one ends."""
    out = [0] * (len(text) + 1)
    stack: list[tuple[str, int]] = []
    for i, c in enumerate(text):
        if stack and c in stack[-1][0]:
            _, start = stack.pop()
            if not stack:
                out[start : i + 1] = [i + 1] * (i + 1 - start)
        elif c == "\n" and text[i + 1 : i + 2] == "\n":
            stack.clear()  # a quotation that is never closed ends with its paragraph
        elif c in PAIRS and not (c in "([" and not stack and i and text[i - 1] == "]"):
            stack.append((PAIRS[c], i))
    return out


def shape(token: str) -> str:
    """Letters by case, digits by number, other characters as they are; short."""
    token = re.sub(r"\d+", lambda m: "0" * min(3, len(m.group())), token[:24])
    token = re.sub(r"[^\W\d_]+", lambda m: ("X" if m.group()[0].isupper() else "x") + ("x" if len(m.group()) > 1 else "") + ("X" if any(ch.isupper() for ch in m.group()[1:]) else "") + ("l" if len(m.group()) > 4 else ""), token)
    return token[:12]


def script(ch: str) -> str:
    o = ord(ch) if ch else 0
    for name, lo, hi in (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)):
        if lo <= o <= hi and ch.isalpha():
            return name
    return "digit" if ch.isdigit() else "mark"


# Common words, by which the language of a text is told where none is given.
_COMMON = {
    "en": "the of and in to a for was by that with", "tr": "ve ile bu için bir olarak da de ise her", "de": "der die und von das für im nach bei den", "fr": "le la les des et en du une de est",
    "es": "el la los de en y se una por con", "ru": "в и на по из через не что", "ar": "في من إلى على عن إن", "hi": "के में ने को का की है", "th": "", "zh": "", "ja": "",
}
_COMMON_OF = {w: [k for k, v in _COMMON.items() if w in v.split()] for v in _COMMON.values() for w in v.split()}


def language(text: str) -> str:
    """The most likely of the languages known here."""
    n = max(1, sum(ch.isalpha() for ch in text))
    if len(_THAI.findall(text)) > 0.2 * n:
        return "th"
    kana = sum("぀" <= ch <= "ヿ" for ch in text)
    han = sum("一" <= ch <= "鿿" for ch in text)
    if kana > 0.05 * n:
        return "ja"
    if han > 0.2 * n:
        return "zh"
    score: dict[str, int] = {}
    for w in text.lower().split():
        for k in _COMMON_OF.get(w, ()):
            score[k] = score.get(k, 0) + 1
    return max(score, key=score.get) if score else "en"


_FAMILY = re.compile(r"(?P<thai>[\u0e00-\u0e7f])|(?P<east>[\u3040-\u30ff\u3400-\u9fff])|(?P<arabic>[\u0600-\u06ff])|(?P<indic>[\u0900-\u097f])|(?P<cyrillic>[\u0400-\u052f])|(?P<latin>[A-Za-z\u00c0-\u024f])")
#: Characters of words of another script that do not end a stretch of one script: names and terms within it.
GUESTS = 40


def zones(text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of the stretches of ``text``, which meet and cover it.

    A stretch is a paragraph, or a part of one in scripts of one family; up to ``GUESTS``
    characters of another script between words of one do not divide it. Each has the
    language of its own words, or where these do not tell, that of the whole text.
    """
    whole = None
    out: list[tuple[int, int, str]] = []
    for m in re.finditer(r"(?:(?!\n[ \t]*\n).)+(?:\n[ \t]*(?=\n))?|\n", text, re.S):
        runs: list[list] = []  # family, start, end, characters of words
        for w in _TOKEN.finditer(text, *m.span()):
            seen: dict[str, int] = {}
            for f in _FAMILY.finditer(w.group()):
                seen[f.lastgroup] = seen.get(f.lastgroup, 0) + 1
            family = max(seen, key=seen.get) if seen else None
            if runs and family in (None, runs[-1][0]):
                runs[-1][2], runs[-1][3] = w.end(), runs[-1][3] + len(w.group())
            elif family is not None or not runs:
                runs.append([family, w.start(), w.end(), len(w.group())])
        if runs and runs[0][0] is None and len(runs) > 1:
            runs[1][1] = runs[0][1]
            del runs[0]
        i = 1
        while i + 1 < len(runs):
            if runs[i][3] <= GUESTS and runs[i - 1][0] == runs[i + 1][0]:
                runs[i - 1][2], runs[i - 1][3] = runs[i + 1][2], runs[i - 1][3] + runs[i][3] + runs[i + 1][3]
                del runs[i : i + 2]
            else:
                i += 1
        # A few words at the edge of a paragraph belong to what they stand beside.
        while len(runs) > 1 and min(runs[0][3], runs[-1][3]) <= GUESTS // 2 and max(runs[0][3], runs[-1][3]) > GUESTS // 2:
            if runs[0][3] <= GUESTS // 2:
                runs[1][1] = runs[0][1]
                del runs[0]
            else:
                runs[-2][2] = runs[-1][2]
                del runs[-1]
        for k, (family, start, _, _) in enumerate(runs):
            end = m.end() if k + 1 == len(runs) else runs[k + 1][1]
            part = text[start:end]
            fixed = {"thai": "th", "arabic": "ar", "indic": "hi", "cyrillic": "ru"}.get(family)
            if not fixed and (family == "east" or any(x in _COMMON_OF for x in part.lower().split())):
                fixed = language(part)
            if not fixed:
                whole = fixed = whole or language(text)
            out.append((start, end, fixed))
    # What stands between is white space and belongs to what it follows; stretches of one language that meet are one.
    merged: list[tuple[int, int, str]] = []
    for start, end, lang in out:
        if merged and merged[-1][2] == lang:
            merged[-1] = (merged[-1][0], end, lang)
        else:
            if merged:
                merged[-1] = (merged[-1][0], start, merged[-1][2])
            merged.append((start if merged else 0, end, lang))
    if merged:
        merged[-1] = (merged[-1][0], len(text), merged[-1][2])
    return merged or [(0, len(text), "en")]


def features(lang: str, before: str, stop: str, gap: str, after: str, closed: str) -> list[str]:
    """Features of a candidate: the token before, its mark, white space, the token after, the quotation closed by it."""
    first = after.lstrip("\"“„«「『(¿¡‘'[")[:1]
    low = before.lower()
    sa, sb = shape(after), shape(before)
    case = "open" if after[:1] in QUOTES and after else "up" if any(ch.isupper() for ch in after[:20]) else "low" if first.isalpha() and first.islower() else "digit" if first.isdigit() else "uncased" if first.isalpha() else "none" if not after else "mark"
    tail = re.search(r"\d+\Z", low)
    numbers = "-" if not tail else ("short" if len(tail.group()) < 3 else "long") + ("" if tail.start() == 0 else "+")
    name = low if len(low) <= 12 and not low[-1:].isdigit() else shape(before)
    return [
        "bias", f"s={stop[-1:]}", f"c={case}", f"s={stop[-1:]} c={case}", f"b={lang}:{name}", f"b={lang}:{name} c={case}", f"bs={sb}", f"bs={sb} c={case}", f"n={lang}:{numbers}", f"n={lang}:{numbers} c={case}",
        f"a={lang}:{after.lower()[:14] if not any(ch.isdigit() for ch in after) else sa}", f"as={sa}", f"l={min(6, len(low))} c={case}", f"g={len(gap) > 1}", f"q={closed}", f"q={closed} c={case}", f"sc={script(first)} q={closed}", f"dot={'.' in before} c={case}",
    ]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@lru_cache(1)
def weights() -> np.ndarray:
    raw = json.loads(resources.files(__package__).joinpath("sentences_model.json").read_text())
    out = np.zeros(BUCKETS)
    out[raw["at"]] = raw["weight"]
    return out


class Candidate:
    __slots__ = ("end", "start", "kind", "features")

    def __init__(self, end: int, start: int, kind: str, feats: list[str] | None = None):
        self.end, self.start, self.kind, self.features = end, start, kind, feats


def candidates(text: str, lang: str | list[tuple[int, int, str]]) -> list[Candidate]:
    """Places where a sentence may end: ``sure`` and ``no`` by rule, ``open`` ones for the model. ``lang`` is a language, or :func:`zones`."""
    if isinstance(lang, str):
        lang = [(0, len(text), lang)]
    out: list[Candidate] = []
    inside: list[int] = []
    for start, end, code in lang:
        if code == "th":
            out += [Candidate(m.start(), m.end(), "sure") for m in re.compile(r"\s+").finditer(text, start, end)]
        else:
            inside = inside or _quotation_depth(text)
            out += _candidates(text, start, end, code, inside)
    return out


def _candidates(text: str, at: int, limit: int, lang: str, inside: list[int]) -> list[Candidate]:
    """The candidates of ``text`` between ``at`` and ``limit``."""
    out: list[Candidate] = []
    n = len(text)
    while (m := _CANDIDATE.search(text, at)) and m.start() < limit:
        i, j = m.span()
        at = j
        if text[i] == "\n":
            if inside[i]:
                continue
            k = _GAP.match(text, j).end()
            blank = text[i:k].count("\n") > 1
            block = bool(_BLOCK.match(text, k)) or bool(_BLOCK.match(text, text.rfind("\n", 0, i) + 1))
            if blank or block:
                out.append(Candidate(i, k, "sure"))
            continue
        stop = m.group()
        closed = "-"
        if inside[i]:
            close = inside[i]
            if _GAP.match(text, j).end() < close - 1:  # not the last mark of the quotation
                continue
            if text[close - 1] in ")）]】":
                continue
            opened = close - 1
            while opened > 0 and inside[opened - 1] == close:
                opened -= 1
            before = opened
            while before and text[before - 1].isspace():
                before -= 1
            lead = text[before - 1 : before]
            closed = "start" if not lead or lead[-1] in STOPS + "\n" + "".join(CLOSE) + '"' and (out and out[-1].kind == "sure" or lead[-1] in STOPS) else "colon" if lead[-1] in ":：" else "run"
            j = at = close
        while j < n and text[j] in "\"'”’»)」』）]" and not inside[j] and text[j] not in '"':
            j += 1
            at = j
        k = j
        while k < n and (text[k].isspace() or text[k] in _INVISIBLE):
            k += 1
        gap, after = text[j:k], (_TOKEN.match(text, k) or [""])[0]
        if k >= n:
            continue
        wide = stop[-1] in WIDE_STOPS
        if not gap and not wide:
            if lang not in ("zh", "ja") or stop[-1] in ".…" or closed == "-":
                continue
        first = after[:1]
        if closed != "-":
            lead_in = after.lstrip(_INVISIBLE)[:1]
            if lang in _UNCASED and closed == "colon" and lead_in not in ",;:—–-،":
                out.append(Candidate(j, k, "sure"))
                continue
            if lead_in in ",;:—–-，、；" or (lead_in.isalpha() and lead_in.islower() and not any(ch.isupper() for ch in re.split(r"[^\w]", after)[0])):
                out.append(Candidate(j, k, "no"))
                continue
            if closed == "start" and lang in ("zh", "ja") and first not in QUOTES:
                out.append(Candidate(j, k, "no"))  # who said it follows
                continue
            if lang == "ja" and closed != "start" and first in "とっ":
                out.append(Candidate(j, k, "no"))
                continue
            if lang in ("zh", "ja"):
                out.append(Candidate(j, k, "sure"))
                continue
        elif wide or stop[-1] in OWN_STOPS or (lang in _UNCASED and stop[-1] in "!?"):
            out.append(Candidate(j, k, "sure"))
            continue
        elif lang in ("zh", "ja") and stop[-1] == "…":
            continue
        before = (_WORD.search(text[max(0, i - 24) : i]) or [""])[0]
        out.append(Candidate(j, k, "open", features(lang, before, stop if len(stop) < 2 else "…", gap, after, closed)))
    return out


def starts(text: str | None, lang: str | None = None, model: np.ndarray | None = None) -> list[int]:
    """Offsets of the first characters of the sentences of ``text``."""
    return [a for a, _ in spans(text, lang, model)]


def spans(text: str | None, lang: str | None = None, model: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of ``text``."""
    if not text or not text.strip():
        return []
    w = weights() if model is None else model
    out = []
    start = len(text) - len(text.lstrip())
    for c in candidates(text, lang or zones(text)):
        take = c.kind == "sure" or (c.kind == "open" and w[[bucket(f) for f in c.features]].sum() > 0)
        if take and c.start > start and c.start < len(text):
            out.append((start, c.end))
            start = c.start
    out.append((start, len(text.rstrip())))
    return out


def with_sentences(df: DataFrame, text: str = "metin", lang: str | None = None) -> DataFrame:
    """One row for each sentence of each row of ``df``: its other columns, ``cumle_no`` from 0, ``bas``, ``cumle``."""
    kind = "array<struct<cumle_no:int,bas:int,cumle:string>>"

    @F.pandas_udf(kind)
    def split(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs in parts:
            yield pd.Series([[{"cumle_no": i, "bas": a, "cumle": t[a:b]} for i, (a, b) in enumerate(spans(t, g))] for t, g in zip(texts, langs)], dtype=object)

    code = F.col(f"`{lang}`") if lang else F.lit(None).cast("string")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, "cumle_no", "bas", "cumle", "__s")]
    return df.select(*rest, F.explode(split(F.col(f"`{text}`"), code)).alias("__s")).select(*rest, "__s.cumle_no", "__s.bas", "__s.cumle")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "cumle_secki", "pasaj_no", "dil").dropDuplicates(["pasaj_no"])
    texts = table(spark, sf_dir, "pasaj", "pasaj_no", "metin").join(chosen, "pasaj_no")
    return with_sentences(texts, "metin", "dil").select("pasaj_no", "bas").distinct()


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all passages and records, with their order."""
    p = table(spark, sf_dir, "pasaj").select(F.lit("metin").alias("alan"), F.col("pasaj_no").alias("no"), "metin")
    m = table(spark, sf_dir, "onbellek").select(F.lit("markdown").alias("alan"), F.col("kayit_no").alias("no"), F.col("markdown").alias("metin"))
    return with_sentences(p.unionByName(m)).select("alan", "no", "cumle_no", "bas", "cumle").distinct()
