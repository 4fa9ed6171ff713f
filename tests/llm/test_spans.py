import random

from attestra.llm import spans as S


def test_automaton():
    rng = random.Random(2)
    for k in range(200):
        ab = "ab" if k % 2 else "abc"
        texts = ["".join(rng.choice(ab) for _ in range(rng.randrange(1, 40))) for _ in range(3)]
        a, at = S.Automaton(), 0
        for t in texts:
            a.add(t, at)
            at += len(t) + 1
        ref, q = "\n".join(texts), "".join(rng.choice(ab) for _ in range(50))
        for i, e in enumerate(a.stream(q, 4)):
            w = q[i - 3 : i + 1] if i >= 3 else None
            assert (e >= 0) == (w is not None and any(w in t for t in texts))
            assert e < 0 or ref[e - 3 : e + 1] == w


def grams(t):
    return {t[i : i + 200] for i in range(len(t) - 199)}


def case(seed):
    rng = random.Random(seed)

    def fresh(n):
        return "".join(rng.choice("abcdefghij klmn\né中") for _ in range(n))

    pool = [fresh(rng.choice((150, 199, 200, 201, 260, 700))) for _ in range(12)] + ["a" * 450, "ab" * 150]
    docs = {i: fresh(rng.randrange(0, 300)) + "".join(rng.choice(pool) + fresh(rng.randrange(0, 90)) for _ in range(rng.randrange(0, 4))) for i in range(60)}
    docs[60], docs[61], docs[62] = docs[3], "", docs[5] + docs[5]
    docs[63] = docs[3][:100] + "x" + docs[3][100:]
    return docs


def test_against_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        docs = case(seed)
        g = {i: grams(t) for i, t in docs.items()}
        want = {(a, b) for a in docs for b in docs if a < b and g[a] & g[b]}
        rows = [(i, t) for i, t in docs.items()] + [(64, None), (3, docs[3])]
        monkeypatch.setattr(S, "STREAMED", 2 + seed)  # references are split
        members, runs, spans = S.shared_runs(spark.createDataFrame(rows, "doc_id long, text string"))
        got = [tuple(r) for r in S.document_pairs(members, S.class_pairs(runs, spans)).collect()]
        assert set(got) == want and len(got) == len(set(got))


def test_coverage(spark, tmp_path):
    docs = case(5)
    spark.createDataFrame([(i, t) for i, t in docs.items()] + [(70, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["ortak"] for r in S.p10_coverage(spark, str(tmp_path)).collect()}
    g = {i: grams(t) for i, t in docs.items()}
    for i, t in docs.items():
        covered = set()
        for p in range(len(t) - 199):
            if any(j != i and t[p : p + 200] in g[j] for j in docs):
                covered.update(range(p, p + 200))
        assert got[i] == len(covered), i
    assert got[70] == 0


def test_empty(spark):
    members, runs, spans = S.shared_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert S.document_pairs(members, S.class_pairs(runs, spans)).count() == 0


def test_spans_without_a_reference(spark, tmp_path):
    """Documents 1 to 3 share with document 0 a fingerprint only; what they share among themselves is found all the same."""
    rng = random.Random(9)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmn") for _ in range(n))
    holds: list[str] = []
    while len(holds) < 2:
        core = fresh(64)
        pool = [fresh(140) + core + fresh(140) for _ in range(100)]
        holds = [t for t in pool if 140 in S.fingerprints(t)[0].tolist()]
    docs = {0: holds[0], 1: holds[1], 2: "x" + holds[1], 3: fresh(30) + holds[1] + fresh(400)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    members, runs, spans = S.shared_runs(df)
    assert {r["cid"] for r in spans.select("cid").collect()} == {1, 2, 3}
    assert set(map(tuple, S.document_pairs(members, S.class_pairs(runs, spans)).collect())) == {(1, 2), (1, 3), (2, 3)}


def test_trimmed(spark, tmp_path):
    docs = case(7)
    spark.createDataFrame([(i, t) for i, t in docs.items()] + [(3, docs[3]), (70, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in S.p10_trimmed(spark, str(tmp_path)).collect()}
    assert got[70]["metin"] is None and got[60]["metin"] == "" and len(got) == len(docs) + 1
    g = {i: grams(t) for i, t in docs.items()}
    for i, t in docs.items():
        assert got[i]["cikan"] == len(t) - len(got[i]["metin"])
        others = set().union(*(g[j] for j in docs if j != i))
        if not g[i] & others:
            assert got[i]["metin"] == t
    # Nearly every shared span is still whole in some document; one may be divided between two references.
    left = set().union(*(grams(got[i]["metin"]) for i in docs))
    shared = {x for i in docs for x in g[i] if any(x in g[j] for j in docs if j != i)}
    assert len(shared & left) > 0.95 * len(shared)
