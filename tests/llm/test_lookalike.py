import sys
import unicodedata

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import lookalike as L


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_segments_compose_like_the_whole(text):
    assert L.compose(text) == unicodedata.normalize("NFC", text)


def test_unstable_characters_are_known():
    """By every code point there is, and by every pair of an unstable character and one of each combining class."""
    segment = L._segment()
    unstable = []
    for c in map(chr, range(sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c):
            assert segment.fullmatch(c), hex(ord(c))
            unstable.append(c)
    marks = list({unicodedata.combining(c): c for c in unstable}.values())
    starters = "aAeouI\u0928\u1100\uac00\u0627\u3046\U00011131"
    for c in unstable:
        for m in marks:
            for text in ("a" + c + m, m + c, c + m + "x"):
                assert L.compose(text) == unicodedata.normalize("NFC", text), ascii(text)
        for x in starters:
            assert L.compose(x + c) == unicodedata.normalize("NFC", x + c), ascii(x + c)
    assert L.compose("a\ufe20\u0323") == "\u1ea1\ufe20"


@pytest.fixture(scope="module")
def forms(spark):
    return L.Forms(L.letter_table(spark))


def test_skeleton_is_stable_for_accents_and_widths(forms):
    @settings(max_examples=200, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
    def check(text):
        assert forms.skeleton(unicodedata.normalize("NFD", text)) == forms.skeleton(unicodedata.normalize("NFC", text))

    check()


def test_what_looks_the_same(forms):
    for a, b in [
        ("Ａｂ　１", "Ab 1"), ("é", "e\u0301"), ("a\u200bb\ufeff", "ab"), ("a\u00a0b", "a b"), ("раре", "pape"), ("ё", "e\u0308"), ("со\u00addе", "code"), ("αlpha", "alpha"), ("ɡo", "go"), ("ᎪᏢᎢ", "APT"), ("Ⅳ ⅻ", "IV xii"),
        ("𝐀𝗯", "Ab"), ("օne", "one"), ("ﬁt", "fit"), ("І", "I"), ("ӏ", "l"), ("Α\u0301", "Á"), ("x\U000e0041y", "xy"),
    ]:
        assert forms.skeleton(a) == forms.skeleton(b), (a, b)


def test_what_does_not(forms):
    for a, b in [("a", "A"), ("1", "2"), ("²", "2"), ("u", "ü"), ("ı", "i"), ("a b", "a  b"), ("a b", "ab"), ("и", "u"), ("١", "1"), ("σ", "ο"), ("ι", "i"), ("l", "1"), ("O", "0"), ("æ", "ae"), ("ß", "β"), ("ا", "l"), ("ſ", "f")]:
        assert forms.skeleton(a) != forms.skeleton(b), (a, b)


def test_words_keep_their_script(forms):
    assert forms.canonical("сор и Nоd") == "сор и Nod"


def test_pairs(spark):
    rows = [("metin", 1, "Ab"), ("metin", 2, "Ａb"), ("metin", 3, "Ab"), ("metin", 3, "Ab"), ("metin", 4, "ab"), ("markdown", 5, "Аb"), ("metin", 6, None), ("metin", 7, ""), ("metin", 8, "\u200b")]
    df = spark.createDataFrame(rows, "alan string, no long, metin string")
    assert sorted(map(tuple, L.look_alike_pairs(df).collect())) == [("metin", 1, 2), ("metin", 2, 3), ("metin", 7, 8)]
    assert L.look_alike_pairs(df.limit(0)).count() == 0
    same = spark.createDataFrame([("metin", i, "é" if i else "e\u0301") for i in range(200)], "alan string, no long, metin string")
    assert L.look_alike_pairs(same).count() == 199  # a large group of copies gives nothing among itself
