import itertools
import random

from attestra.llm import packing as P


def padding(h, bounds):
    return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in h.items())


def test_bounds_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        h = {rng.randrange(1, 40): rng.randrange(1, 9) for _ in range(9)}
        for k in (1, 2, 3, 4):
            got = P.bucket_bounds(h, k)
            best = min(padding(h, c) for m in range(1, k + 1) for c in itertools.combinations(sorted(h), min(m, len(h))) if max(c) == max(h))
            # A price reaches every optimum on the convex hull; between its corners fewer buckets may come out.
            assert len(got) <= k and (padding(h, got) == best or len(got) < k)


def test_everything_is_laid_out():
    rng = random.Random(6)
    for _ in range(20):
        counts = {b: rng.randrange(0, 50) for b in rng.sample(range(1, 101), 12)}
        used = {}
        for pattern, times in P.lay_out(counts, P.bucket_bounds({b: n for b, n in counts.items() if n}, 4), 100):
            assert sum(b * k for b, k in pattern.items()) <= 100 and times > 0
            for b, k in pattern.items():
                used[b] = used.get(b, 0) + k * times
        assert used == {b: n for b, n in counts.items() if n}


def test_containers(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice((0, 1, 7, 300, 700, 1024, 2047, 2048, 2049, 5000, rng.randrange(1, 2048)))) for i in range(600)] + [(600, None)]
    got = P.fill(spark.createDataFrame(rows, "doc_id long, tokens int")).toPandas()
    total = got.groupby("doc_id").uzunluk.sum().to_dict()
    assert total == {i: n for i, n in rows if n}
    full = got.groupby("kap").uzunluk.sum()
    assert full.max() <= 2048 and full.sum() / (2048 * len(full)) > 0.97
    assert not got.duplicated(["doc_id", "parca"]).any()
    pieces = got.groupby("doc_id").size().to_dict()
    assert all(pieces[i] == -(-n // 2048) for i, n in rows if n)


def test_empty(spark):
    assert P.fill(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, tokens int")).count() == 0


def test_hot_length(spark):
    got = P.fill(spark.createDataFrame([(i, 500) for i in range(3000)] + [(3000 + i, 48) for i in range(750)], "doc_id long, tokens int")).toPandas()
    assert got.groupby("kap").uzunluk.sum().eq(2048).mean() > 0.98


def test_batches_form_inside_their_bucket():
    """Rests alone go to smaller buckets: a batch leaves its bucket only when none of its items fits."""
    rng = random.Random(4)
    counts = {s: rng.randrange(1, 30) for s in rng.sample(range(1, 101), 60)}
    bounds = P.bucket_bounds(counts, 6)
    assert 1 < len(bounds) <= 6
    left = dict(counts)
    for pattern, times in P.lay_out(counts, bounds, 100):
        floor = max([0, *(b for b in bounds if b < max(pattern))])
        own = {s: k for s, k in pattern.items() if s > floor}
        room = 100 - sum(s * k for s, k in own.items())
        assert not any(floor < s <= room and left[s] > own.get(s, 0) for s in left)
        for s, k in pattern.items():
            left[s] -= k * times


def test_copies_of_a_document_count_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (1, "a b c d"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.p9_containers(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["bas"]) for r in got] == [(1, 0)] and got[0]["uzunluk"] >= 4
    assert P.p9_report(spark, str(tmp_path)).first()["kaplar"] == 1
