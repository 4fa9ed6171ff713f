"""The queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chunks, components, lookalike, markup, neardup, packing, residue, sentences, spans

QUERIES = {
    f.__name__: f
    for f in (
        markup.p1_found, markup.p1_clean, markup.p1_votes, neardup.p2_found, neardup.p2_groups, chunks.p3_found, chunks.p3_pieces, chunks.p3_rebuilt, lookalike.p4_found, lookalike.p4_canonical,
        residue.p5_found, residue.p5_kept, components.p6_found, components.p6_groups, sentences.p7_found, sentences.p7_sentences, bpe.p8_ids,
        packing.p9_containers, packing.p9_report, packing.p9_sizes, spans.p10_found, spans.p10_coverage, spans.p10_trimmed,
    )
}

_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LONGEST = "list_max(list_transform(regexp_split_to_array(metin, '{}'), lambda x: length(x))) <= 800"
_EDGES = """
    stars as (select min(url) over (partition by kopya_grubu) a, url b from sayfa where kopya_grubu is not null and url is not null),
    pairs as (select url_a a, url_b b from kopya_cift where url_a is not null and url_b is not null union select a, b from stars),
    edges as (select a, b from pairs union select b, a from pairs),
    reached(n, r) as (select a, a from edges union select e.b, g.r from reached g join edges e on g.n = e.a where g.r < e.b),
    roots as (select n, min(r) r from reached group by n)"""


# The SQL of problem 4 knows the forms by itself. Full-width ASCII by its rule, spaces and invisible characters, look-alike letters of Cyrillic and Greek.
_SQL_SPACES = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_SQL_NOTHING = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}]"
_SQL_ALIKE = "АВЕЅІЈКМНОРСТУХҮԌԚԜһасԁеіјӏорԛѕԝхуѵ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳον" + "ЁЇёї"
_SQL_LATIN = "ABESIJKMHOPCTYXYGQWhacdeijlopqswxyv" + "ABEZHIKMNOPTYXjov" + "ËÏëï"


def _folded(col: str) -> str:
    """The form of a text to compare by, in SQL."""
    wide = f"translate({col}, '{''.join(map(chr, range(0xFF01, 0xFF5F))) + _SQL_SPACES}', '{''.join(map(chr, range(0x21, 0x7F))).replace(chr(39), chr(39) * 2) + ' ' * len(_SQL_SPACES)}')"
    return f"nfc_normalize(translate(nfc_normalize(regexp_replace({wide}, '{_SQL_NOTHING}', '', 'g')), '{_SQL_ALIKE}', '{_SQL_LATIN}'))"


_PAGES = "select url, string_agg(m, chr(10) order by sira, pasaj_no) t from (select distinct url, sira, pasaj_no, coalesce(metin, '') m from pasaj where url is not null) group by url"
_RUNS = f"""w as (select url, regexp_extract_all(regexp_replace(lower(t), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+') w from ({_PAGES})),
    r as (select distinct url, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) x from w where len(w) >= 8), n as (select url, count(*) n from r group by url)"""

ORACLE = {
    "p2_found": f"with {_RUNS}, c as (select a.url url_a, b.url url_b, count(*) k from r a join r b on a.x = b.x and a.url < b.url group by 1, 2) select url_a, url_b from c join n na on na.url = url_a join n nb on nb.url = url_b where k >= 0.85 * (na.n + nb.n - k)",
    "p2_groups": f"with recursive {_RUNS}, d as (select url, md5(string_agg(x, chr(1) order by x)) d, count(*) n from r group by url), m as (select url, min(url) over (partition by d) cls, n from d), rc as (select r.url cls, r.x from r semi join (select distinct cls from m) k on k.cls = r.url), "
    "c as (select a.cls ca, b.cls cb, count(*) k from rc a join rc b on a.x = b.x and a.cls < b.cls group by 1, 2), l as (select ca, cb from c join n na on na.url = ca join n nb on nb.url = cb where k >= 0.85 * (na.n + nb.n - k)), e as (select ca a, cb b from l union select cb, ca from l), "
    "g(n, r) as (select a, a from e union select e.b, g.r from g join e on g.n = e.a where g.r < e.b), o as (select n, min(r) r from g group by n), z as (select a, count(*) b from e group by a) "
    "select m.url, m.cls as sinif, coalesce(o.r, m.cls) as kopya_grubu, coalesce(z.b, 0) as baglanti from m left join o on o.n = m.cls left join z on z.a = m.cls",
    "p4_found": f"with t as (select distinct 'metin' alan, pasaj_no no, metin m from pasaj where metin is not null union all select distinct 'markdown', kayit_no, markdown from onbellek where markdown is not null), s as (select alan, no, m, {_folded('m')} k from t) "
    "select distinct a.alan, a.no as no_a, b.no as no_b from s a join s b on a.alan = b.alan and a.k = b.k and a.no < b.no and a.m <> b.m",
    "p10_found": "with t as (select doc_id, text from documents where length(text) >= 200), g as (select distinct doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: md5(substr(text, i, 200)))) x from t), s as (select x from g group by x having count(*) > 1) "
    "select distinct a.doc_id as doc_a, b.doc_id as doc_b from (select * from g where x in (from s)) a join (select * from g where x in (from s)) b on a.x = b.x and a.doc_id < b.doc_id",
    "p3_found": "select distinct pasaj_no, case when "
    + _LONGEST.format(r"\n([ \t]*\n)+")
    + " then 'paragraph' when "
    + _LONGEST.format(r"\n")
    + " then 'line' when "
    + _LONGEST.format(_WHITE)
    + " then 'space' else 'none' end as sinir from pasaj where length(metin) > 800",
    "p3_rebuilt": "select distinct pasaj_no, true as tutar, coalesce(length(metin), 0) > 800 as bolundu, md5(coalesce(metin, '')) as ozet from pasaj",
    "p6_found": f"with recursive {_EDGES} select r as kok_url, n as url from roots where n <> r",
    "p9_sizes": "select distinct doc_id, 0 as fazla, 0 as asan from documents where text is not null and text <> ''",
    "p10_coverage": "with t as (select distinct doc_id, text from documents where length(text) >= 200), g as (select doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: {'i': i, 'x': md5(substr(text, i, 200))}), recursive := true) from t), s as (select x from g group by x having count(distinct doc_id) > 1), "
    "h as (select doc_id, i, lag(i) over (partition by doc_id order by i) p from (select distinct doc_id, i from g where x in (from s))), c as (select doc_id, sum(least(200, i - coalesce(p, -1000))) n from h group by doc_id) select d.doc_id, cast(coalesce(c.n, 0) as bigint) as ortak from (select distinct doc_id from documents) d left join c using (doc_id)",
    "p6_groups": f"with recursive {_EDGES}, pages as (select distinct url from sayfa where url is not null) select coalesce(p.url, r.n) as url, coalesce(r.r, p.url) as grup from pages p full join roots r on p.url = r.n",
}
