from pyspark.sql import functions as F

from attestra.operators import claims as C

CLAIM = "slug string, run_id string, dosya string, sira int, iddia string, kelimeler array<string>, anahtarlar array<string>, sayilar array<string>, alintili boolean"


def features(spark, rows):
    return spark.createDataFrame([("s", run, f"{run}.md", i, text, text.split(), urls, nums, True) for i, (run, text, urls, nums) in enumerate(rows)], CLAIM)


def sizes(spark, rows):
    c = C.clusters(features(spark, rows)).collect()
    by = {}
    for r in c:
        by.setdefault(r["kume"], set()).add(r["run_id"])
    return sorted(map(len, by.values()), reverse=True)


def test_three_runs(spark):
    a, a2 = "one two three four five", "one two three four other"
    rows = [("r1", a, [], []), ("r1", "bbb ccc ddd eee", [], []), ("r2", a2, [], []), ("r2", "fff ggg hhh iii", [], []), ("r3", a, [], []), ("r3", "jjj kkk lll mmm", [], [])]
    assert sizes(spark, rows) == [3, 1, 1, 1]


def test_numbers_decide(spark):
    same = "alpha beta gamma delta"
    apart = [("r1", same, ["u"], ["1"]), ("r2", same, ["u"], ["2"])]
    assert sizes(spark, apart) == [1, 1] and C.conflicts(C.clusters(features(spark, apart)), features(spark, apart)).count() == 1
    assert sizes(spark, [("r1", same, ["u"], ["1"]), ("r2", "other words are here", ["u"], ["1", "3"])]) == [2]
    assert sizes(spark, [("r1", same, ["u"], []), ("r2", "alpha beta words here", ["u"], [])]) == [2]
    assert sizes(spark, [("r1", same, ["u"], []), ("r2", "alpha words are here", ["v"], [])]) == [1, 1]


def test_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(f"r{rng.randrange(3)}", " ".join(rng.sample(vocabulary, rng.randrange(1, 9))), rng.sample(["u", "v", "x"], rng.randrange(2)), rng.sample(["1", "2"], rng.randrange(2))) for _ in range(60)]
    want = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i < j and a[0] != b[0] and C._same((set(a[1].split()), set(a[3]), set(a[2])), (set(b[1].split()), set(b[3]), set(b[2]))):
                want.add((i, j))
    got = C.same_claim_pairs(features(spark, rows), ["slug", "run_id", "dosya", "sira"]).select("a_sira", "b_sira").collect()
    assert {tuple(sorted(r)) for r in got} == want


def test_ordered_match(spark):
    a = spark.createDataFrame([("f", "c", 0), ("f", "c", 1), ("f", "d", 2)], "f string, k string, sira int")
    b = spark.createDataFrame([("f", "c", 9, "X"), ("f", "c", 8, "Y")], "f string, k string, o int, v string")
    assert [r["v"] for r in C.match_in_order(a, b, ["f", "k"], ["sira"], ["o"]).orderBy("sira").collect()] == ["Y", "X", None]


def test_facts(spark):
    plan = spark.createDataFrame([("s", [("A", "alpha"), ("B", "beta|BETTA"), ("C", "/gamma"), ("", "x"), ("D", "delta")]), ("t", None)], "slug string, olgular array<struct<ad:string,ara:string>>")
    k = C.facts(plan)
    claims = spark.createDataFrame([("s", "r1", "ALPHA and [betta](https://x.example/gamma) https://y.example/delta"), ("s", "r2", "alpha"), ("z", "r1", "delta")], "slug string, run_id string, iddia string")
    hits = C.fact_hits(k, claims)
    assert sorted((r["no"], r["run_id"]) for r in hits.collect()) == [(0, "r1"), (0, "r2"), (1, "r1")]
    r = C.fact_coverage(k, hits).first()
    assert (r["toplam"], r["kapsanan"], r["yuzde"], r["yeterli"]) == (4, 2, 50, False)
    assert [x["olgular"] for x in C.follow_up(k, hits).orderBy("soru").collect()] == ["C", "D"]


def test_plan_and_rounds(spark):
    schema = "slug string, konu string, sorular array<string>, min_url int, min_url_required int, single_publisher_host string, olgular array<struct<ad:string,ara:string>>"
    plan = spark.createDataFrame([("ok", "t", ["q"], 5, None, "a.example", None), ("Bad Slug", "", [], 99, 1, "no host", [("", "x")]), ("x", "t", ["q"], None, None, None, [("f", "g")]), ("y", "t", ["q"], None, None, None, [("f", "g")])], schema)
    got = {r["slug"]: r["sorunlar"] for r in C.plan_problems(plan).collect()}
    assert got["ok"] == [] and got["Bad Slug"] == ["slug", "topic", "questions", "min_url", "min_url_required", "publisher", "empty fact"] and got["x"] == got["y"] == ["shared facts"]
    assert [C.next_round(*a) for a in ((set(), None, 0), ({1}, {1}, 1), ({1}, {1, 2}, 1), ({1}, None, 3))] == ["done", "stagnation", "continue", "cap"]


def test_scores(spark):
    pairs = spark.createDataFrame([("r", "d", 1, "p", "h"), ("r", "d", 2, "p", "h")], "run_id string, dosya string, sira int, premise string, hypothesis string")

    def stub(pdf):
        out = pdf[["run_id", "dosya", "sira"]].copy()
        out["ent"], out["neu"], out["con"] = 0.05, 0.1, [0.9, 0.1][: len(out)] if len(out) == 2 else 0.9
        return out

    r = C.nli_summary(C.nli_scores(pairs.coalesce(1), stub)).first()
    assert (r["toplam"], r["zayif"], r["celisen"]) == (2, 2, 1)
    answers = spark.createDataFrame([("d", "c1", "o", "Evet, uygun"), ("d", "c1", "o", "Evet, uygun"), ("d", "c2", "o", "no"), ("d", "c3", "o", None)], "dosya string, cumle string, oge string, yanit string")
    assert {x["karar"]: x["n"] for x in C.referee_summary(answers).collect()} == {"yes": 1, "no": 1, "unclear": 1}
