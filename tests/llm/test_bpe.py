import base64

import pytest

from attestra.llm import bpe

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_public_encoder(public):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = bpe.encoder()

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
    def check(text):
        assert enc.encode(text) == public.encode_ordinary(text)

    check()
    for text in ("a" * 6000, " " * 3000, "ab" * 3000, "\n \n" * 500, "'s't'll" * 40, "<|endoftext|> x", "保管庫" * 400 + "Ａb\x1c x\x1f  y", "İstanbul'da ne\u200b var 🀄🀄", "หากไม่มีระบบ" * 50):
        assert enc.encode(text) == public.encode_ordinary(text)


def test_compatibility_rejects_what_merges(public):
    enc = bpe.encoder()
    a, b = enc.rank["t"], enc.rank["h"]
    assert not enc.compatible(a, b) and enc.compatible(enc.rank["q"], enc.rank["z"]) == (len(public.encode_ordinary("qz")) == 2)


def test_defined_results(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "ab ab", None), (3, "ab ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column of the output's name
    got = bpe.with_token_ids(df).orderBy("doc_id").collect()
    assert [r["ids"] for r in got][:2] == [[], []] and len(got) == 4 and got[2]["ids"] == bpe.encoder().encode("ab ab")
    assert bpe.with_token_ids(df.limit(0)).count() == 0
    assert [r["tokens"] for r in bpe.with_token_counts(df).orderBy("doc_id").collect()] == [0, 0, 2, 2]
