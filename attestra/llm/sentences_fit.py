"""Trains the boundary model on reliable boundaries: ``python -m attestra.llm.sentences_fit DIR``.

Reliable boundaries are candidates before a line break and the ends of texts. Reliable
non-boundaries are points before a lower-case word, a digit or a comma, and all points
after a token that stands before points at least ``OFTEN`` times in its language but
never at the end of a line or text. Candidates after tokens that do end texts, before
a word in upper case, are taken as boundaries too. At most ``ROWS`` passages are read,
those with the smallest numbers.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from .sentences import BUCKETS, QUOTES, _WORD, bucket, candidates, shape

ROWS, OFTEN, ROUNDS = 20_000, 40, 60


def _key(lang: str, before: str) -> tuple[str, str]:
    if before[-1:].isdigit():
        return lang, "0" if len(re.sub(r".*\D", "", before)) < 3 else "000"
    return lang, before.lower() if len(before) <= 12 else shape(before)


def examples(texts: list[tuple[str, str]]) -> tuple[list[list[int]], list[int]]:
    seen: Counter = Counter()
    ends: Counter = Counter()
    found = []
    for lang, text in texts:
        last = text.rstrip()
        m = re.search(r"([.!?…।؟]+)[\"”»)]*\Z", last)
        if m:
            before = (_WORD.search(last[max(0, m.start() - 24) : m.start()]) or [""])[0]
            ends[_key(lang, before)] += 1
        for c in candidates(text, lang):
            if c.kind != "open":
                continue
            end = c.end
            while end and text[end - 1] in ".!?…\"”»)।؟ ":
                end -= 1
            key = _key(lang, (_WORD.search(text[max(0, end - 24) : end]) or [""])[0])
            seen[key] += 1
            broken = "\n" in text[c.end : c.start]
            ends[key] += broken
            found.append((c, key, broken, text[c.start :].lstrip("¿¡(")[:24]))
    rare = {k for k, n in seen.items() if n < OFTEN}
    x, y = [], []
    for c, key, broken, after in found:
        stop = "s=." in c.features or "s=…" in c.features
        word = re.split(r"\s", after)[0]
        if broken:
            label = 1
        elif not stop:
            label = 0 if after[:1].islower() and not re.search("[A-Z]", word) else 1
        elif after[:1].isdigit() or after[:1] in ",;—" or (after[:1].islower() and not any(ch.isupper() for ch in word)):
            label = 0
        elif key not in rare and not ends[key]:
            label = 0
        elif ends[key] and (after[:1].isalpha() or after[:1] in QUOTES):
            label = 1
        else:
            continue
        x.append([bucket(f) for f in c.features])
        y.append(label)
    return x, y


def train(x: list[list[int]], y: list[int], l2: float = 1e-5) -> np.ndarray:
    """Maximum-entropy weights by adaptive gradient steps over all examples."""
    a, t = np.array(x), np.array(y, float)
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for part in np.array_split(rng.permutation(len(a)), max(1, len(a) // 512)):
            p = 1 / (1 + np.exp(-w[a[part]].sum(1)))
            g = np.bincount(a[part].ravel(), np.repeat((p - t[part]) / len(part), a.shape[1]), BUCKETS) + l2 * w
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
    return w


def main(folder: str) -> None:
    import duckdb

    con = duckdb.connect()
    rows = con.sql(f"select distinct p.pasaj_no, c.dil, p.metin from '{folder}/pasaj.parquet' p join '{folder}/cumle_secki.parquet' c using (pasaj_no) order by 1 limit {ROWS}").fetchall()
    texts = [(r[1], r[2]) for r in rows]
    held = texts[::5]
    x, y = examples([t for i, t in enumerate(texts) if i % 5])
    w = train(x, y)
    hx, hy = examples(held)
    p = w[np.array(hx)].sum(1) > 0
    print(len(x), "examples,", sum(y), "boundaries; held-out accuracy", round(float((p == np.array(hy)).mean()), 5))
    x, y = examples(texts)
    w = train(x, y)
    at = np.flatnonzero(np.abs(w) > 1e-3)
    Path(__file__).with_name("sentences_model.json").write_text(json.dumps({"at": at.tolist(), "weight": [round(float(v), 4) for v in w[at]]}))


if __name__ == "__main__":
    main(sys.argv[1])
