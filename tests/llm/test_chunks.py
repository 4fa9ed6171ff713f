from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import chunks as C

TEXT = st.text(st.sampled_from("ab .\n\t。é\u0301中"), max_size=3000) | st.text(st.sampled_from("ab"), max_size=3000)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_bodies_are_the_text(text):
    got = C.pieces(text)
    assert "".join(text[b:e] for _, b, e in got) == text
    assert all(e - a <= C.LIMIT and 0 <= b - a <= C.OVERLAP for a, b, e in got)
    assert got[0][0] == 0 and all(x[2] == y[1] for x, y in zip(got, got[1:]))


def test_natural_boundaries_come_first():
    text = "\n\n".join(["word " * 90 + "end."] * 6)
    assert all(text[:e].endswith("\n\n") or e == len(text) for e in C.cut_places(text))


def test_an_edit_changes_its_neighbourhood_only():
    import random

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    old, new = set(C.cut_places(text)), {p - 9 for p in C.cut_places(text[:300] + "inserted " + text[300:])}
    assert len(old & new) > 0.8 * len(old)


def test_kinds():
    assert C.coarsest_boundary("a" * 800 + "\n \t\n" + "b" * 800) == "paragraph"
    assert C.coarsest_boundary("a" * 700 + "\n" + "b" * 700) == "line" and C.coarsest_boundary("a " * 900) == "space" and C.coarsest_boundary("a" * 801) == "none"


def test_defined_results(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "x y", 2), (4, "z" * 2000, 3), (4, "z" * 2000, 3)]
    df = spark.createDataFrame(rows, "pasaj_no long, metin string, parca int")  # clashing column
    got = C.with_pieces(df).collect()
    by = {n: [r for r in got if r["pasaj_no"] == n] for n in (1, 2, 3, 4)}
    assert [r["metin"] for r in by[1] + by[2] + by[3]] == [None, "", "x y"] and by[3][0]["sinir"] is None
    assert len(by[4]) == 6 and {r["sinir"] for r in by[4]} == {"none"} and max(len(r["metin"]) for r in by[4]) <= 800
    assert C.with_pieces(df.limit(0)).count() == 0
