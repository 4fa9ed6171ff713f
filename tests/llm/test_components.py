import random

from attestra.llm import components as K


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


def solve(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return {r["key"]: r["root"] for r in K.components(df).collect()}


def test_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)]
    want = {k: v for k, v in brute(pairs).items() if sum(x == v for x in brute(pairs).values()) > 1}
    assert solve(spark, pairs) == want


def test_long_chain_hub_and_dirt(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    random.Random(4).shuffle(chain)
    hub = [("hub", f"x{i}") for i in range(400)] + [("hub", "hub"), (None, "x1"), ("x2", None), ("x1", "hub"), ("x1", "hub")]
    got = solve(spark, chain + hub)
    assert {got[f"c{i:04d}"] for i in range(301)} == {"c0000"} and {got[f"x{i}"] for i in range(400)} == {"hub"}


def test_empty(spark):
    assert solve(spark, [(None, None), ("a", "a")]) == {}


def test_group_edges_are_a_star(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "c"), (None, "d"), ("h", None), ("h", "e"), ("g", "b")], "g string, k string")
    assert sorted(map(tuple, K.group_edges(df, "g", "k").distinct().collect())) == [("a", "b"), ("a", "c")]


def test_hub_with_most_edges(spark):
    """A third of all edges and more at one node, in both directions, beside a chain that leads to it."""
    rows = [("hub", f"n{i:04d}") if i % 2 else (f"n{i:04d}", "hub") for i in range(3000)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(300)] + [("c300", "n2999"), ("x", "y")]
    got = solve(spark, rows)
    assert len(got) == 3304 and {v for k, v in got.items() if k not in "xy"} == {"c000"} and got["y"] == "x"
