"""Exact byte-level BPE over whole texts (problem 8).

A text is split by the tokenizer's own pattern; each pre-token is encoded by
backtracking over longest vocabulary matches. A candidate token is kept only if
it is compatible with its left neighbour, i.e. the merge rules could have left
exactly these two tokens side by side; compatibility of adjacent tokens and the
merge that made a token are memoised, so a pre-token takes linear time. Bytes are
mapped to Latin-1 characters so that the Aho-Corasick trie works on ``str``.

Long runs of letters (scripts without spaces) are first cut between bytes that
are adjacent in no vocabulary entry: no merge can cross such a place, so the
pieces encode independently and repeat often enough for the cache.

Defined results: null and empty texts give an empty list; blank texts, emoji, odd
and invisible characters are encoded byte by byte; strings of special tokens are
ordinary text; lone surrogates cannot occur in Spark strings. Extra columns are
kept by :func:`with_token_ids` unless they carry the output's name, which the
output replaces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import table

#: Vocabulary file of the public tokenizer byte_bpe_50k (a parameter everywhere).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE_LIMIT = 400_000
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """One vocabulary with its trie, memo tables and pre-token cache."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.text = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.trie = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.trie.add_word(token, rank)
        self.adjacent = np.zeros((256, 256), bool)
        for token in self.rank:
            raw = token.encode("latin-1")
            for a, b in zip(raw, raw[1:]):
                self.adjacent[a, b] = True
        self.split_memo: dict[int, tuple[int, int]] = {}
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.shorter_memo: dict[int, int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def longest_match(self, s: str, at: int) -> int:
        """Rank of the longest vocabulary entry that starts at ``at``."""
        window = s[at : at + self.longest]
        n = self.trie.longest_prefix(window)
        rank = self.rank
        while n > 1:
            r = rank.get(window[:n])
            if r is not None:
                return r
            n -= 1
        return rank[window[0]]

    def shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of ``token``, or -1."""
        got = self.shorter_memo.get(token)
        if got is None:
            t = self.text[token]
            got = -1
            for n in range(len(t) - 1, 0, -1):
                r = self.rank.get(t[:n])
                if r is not None:
                    got = r
                    break
            self.shorter_memo[token] = got
        return got

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``; a single byte gives itself twice."""
        got = self.split_memo.get(token)
        if got is None:
            t = self.text[token]
            if len(t) == 1:
                got = (token, token)
            else:
                seq = [self.rank[c] for c in t]
                while len(seq) > 2:
                    best, where = token, -1
                    for i in range(len(seq) - 1):
                        r = self.rank.get(self.text[seq[i]] + self.text[seq[i + 1]])
                        if r is not None and r < best:
                            best, where = r, i
                    seq[where : where + 2] = [best]
                got = (seq[0], seq[1])
            self.split_memo[token] = got
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge rules can leave ``left`` and ``right`` adjacent."""
        key = (left, right)
        got = self.pair_memo.get(key)
        if got is None:
            if len(self.pair_memo) >= _CACHE_LIMIT:
                self.pair_memo.clear()
            got = self.pair_memo[key] = self._compatible(left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges on both sides of the border from the latest to the earliest. A border
        # pair that merges before the merge undone last would have been taken by the rules.
        limit = 1 << 60
        while True:
            r = self.rank.get(self.text[left] + self.text[right])
            if r is not None and r < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    inner = self.parts(left)[1]
                    if inner != left:
                        limit, left = left, inner
                        break
                else:
                    inner = self.parts(right)[0]
                    if inner != right:
                        limit, right = right + 1, inner
                        break
                undo_left = not undo_left
            else:
                return True

    def backtrack(self, s: str) -> tuple[int, ...]:
        """Ids of one stretch ``s`` of Latin-1 mapped bytes."""
        whole = self.rank.get(s)
        if whole is not None:
            return (whole,)
        n, text = len(s), self.text
        out: list[int] = []
        dead = bytearray(n + 1)  # ends from which the rest could not be encoded
        at, token = 0, self.longest_match(s, 0)
        while True:
            end = at + len(text[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = self.longest_match(s, at)
                continue
            token = self.shorter(token)
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= len(text[last])
                token = self.shorter(last)

    def word(self, w: str) -> tuple[int, ...]:
        raw = w.encode("utf-8")
        if len(raw) <= 16:
            return self.backtrack(raw.decode("latin-1"))
        a = np.frombuffer(raw, np.uint8)
        cuts = np.flatnonzero(~self.adjacent[a[:-1], a[1:]]) + 1
        if not len(cuts):
            return self.backtrack(raw.decode("latin-1"))
        out: list[int] = []
        pieces, start = self.pieces, 0
        for end in [*cuts.tolist(), len(raw)]:
            piece = raw[start:end]
            ids = pieces.get(piece)
            if ids is None:
                if len(pieces) >= _CACHE_LIMIT:
                    pieces.clear()
                ids = pieces[piece] = self.backtrack(piece.decode("latin-1"))
            out += ids
            start = end
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for w in self.split(text):
            try:
                out += cache[w]
            except KeyError:
                ids = self.word(w)
                if len(w) <= 48:
                    if len(cache) >= _CACHE_LIMIT:
                        cache.clear()
                    cache[w] = ids
                out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of ``path``, built once in each Python worker."""
    got = _encoders.get(path)
    if got is None:
        got = _encoders[path] = Encoder(path)
    return got


def shipped(spark: SparkSession, path: str) -> str | None:
    """The name under which the vocabulary at ``path`` reaches the executors; None if the driver has no such file, so that they must."""
    if not os.path.isfile(path):
        return None
    spark.sparkContext.addFile(path)  # served by the driver; the same file again changes nothing
    return os.path.basename(path)


def encode_batches(path: str, name: str | None, text_at: int, out: str, counts: bool):
    """A ``mapInArrow`` function that replaces column ``text_at`` by ids or by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name) if name else path)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            kept = [i for i in range(batch.num_columns) if i != text_at]
            if counts:
                made = pa.array([enc.count(t) for t in texts], pa.int32())
            else:
                offsets, flat = [0], []
                for t in texts:
                    flat += enc.encode(t)
                    offsets.append(len(flat))
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32)))
            schema = pa.schema([*(batch.schema.field(i) for i in kept), pa.field(out, made.type)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], schema=schema)

    return run


def _map(df: DataFrame, text: str, out: str, path: str, counts: bool) -> DataFrame:
    kept = [c for c in df.columns if c not in (text, out)]
    kind: T.DataType = T.IntegerType() if counts else T.ArrayType(T.IntegerType())
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, kind)])
    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`")).mapInArrow(encode_batches(path, shipped(df.sparkSession, path), len(kept), out, counts), schema)


def with_token_ids(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with ``out``, the token ids of each text."""
    return _map(df, text, out, path, False)


def with_token_counts(df: DataFrame, text: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with ``out``, the number of tokens of each text."""
    return _map(df, text, out, path, True)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_ids(table(spark, sf_dir, "documents", "doc_id", "text"))
