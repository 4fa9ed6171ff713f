import random

import numpy as np

from attestra.llm import hashing as H
from attestra.llm import neardup as N


def test_window_minima():
    rng = random.Random(1)
    for k in range(150):
        h = np.array([rng.randrange(4 if k % 2 else 1 << 36) << 24 | rng.randrange(1 << 24) for _ in range(rng.randrange(1, 60))], np.uint64)
        top = h >> np.uint64(24)
        w = rng.randrange(1, 12)
        want = sorted({max(i for i in range(s, s + w) if top[i] == top[s : s + w].min()) for s in range(len(h) - w + 1)}) if len(h) >= w else []
        assert H.window_minima(h, w).tolist() == want


def test_long_inputs_are_taken_in_parts(monkeypatch):
    h = np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64)
    want = H.window_minima(h, 7).tolist()
    monkeypatch.setattr(H, "_PLACE", (1 << 24) - 1)
    whole = H.window_minima(h, 7).tolist()
    assert whole == want and sorted(set(np.concatenate([H.window_minima(h[i : i + 100 + 6], 7) + i for i in range(0, 494, 100)]).tolist())) == want


def test_windows_are_content_only():
    a, b = H.Prefix("xxabcdefgh").windows(5), H.Prefix("çabcdefgh").windows(5)
    assert a[2:].tolist() == b[1:].tolist()


def brute(pages):
    import re

    runs = {}
    for u, t in pages.items():
        w = re.findall(r"\w+", re.sub(r"https?://\S+|www\.\S+", " ", t.lower()))
        runs[u] = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    us = sorted(u for u in runs if runs[u])
    return {(a, b) for i, a in enumerate(us) for b in us[i + 1 :] if len(runs[a] & runs[b]) >= 0.85 * len(runs[a] | runs[b])}


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    pages = {}
    for i in range(90):
        base = [rng.choice(words) for _ in range(rng.choice((9, 40, 200)))]
        pages[f"u{i}a"] = " ".join(base)
        for j in range(rng.randrange(3)):
            edit = list(base)
            for _ in range(rng.randrange(3)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            pages[f"u{i}b{j}"] = "See https://x.example/a?b " * j + " ".join(edit).upper()
    boiler = " ".join(rng.choice(words) for _ in range(60))
    pages |= {f"v{i}": boiler + " " + " ".join(f"x{i}y{k}" for k in range(60)) for i in range(40)}  # shared, but not similar
    pages["short"], pages["blank"] = "one two three", ""
    rows = [(u, k, i * 2 + k, part) for i, (u, t) in enumerate(pages.items()) for k, part in enumerate((t[: len(t) // 2].rsplit(" ", 1)[0], t[len(t[: len(t) // 2].rsplit(" ", 1)[0]) :]))]
    rows += rows[:5] + [(None, 0, 10**6, "x"), ("nulls", 0, 10**6 + 1, None)]
    df = spark.createDataFrame(rows, "url string, sira int, pasaj_no long, metin string")
    got = [tuple(r) for r in N.page_pairs(*N.similar_classes(df)).collect()]
    assert set(got) == brute(pages) and len(got) == len(set(got))


def test_empty(spark):
    df = spark.createDataFrame([], "url string, sira int, pasaj_no long, metin string")
    assert N.page_pairs(*N.similar_classes(df)).count() == 0
