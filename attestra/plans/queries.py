"""The core's queries over the domain's tables, and the SQL that those are held against that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import claims as C
from ..operators import logs as L
from ..operators import notes as N
from ..operators import pages as P
from ..operators import support as S
from ..operators import vault as V
from ..operators import verdict as J
from ..operators import reports as R
from ..runtime import bounded, cut, table
from . import vectors

KEY = ["run_id", "slug", "dosya"]
AS_OF = 1767225600.0  # 2026-01-01, so that no result depends on the day it is made
QUERIES: dict = dict(vectors.QUERIES)
ORACLE: dict[str, str] = dict(vectors.ORACLE)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Pieces of SQL shared by several queries.
_CANON = """
  case when regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) = '' then '' else
  case when lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) in ('', 'http') then 'https' else lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) end || '://' || {h}
  || case when regexp_replace(regexp_extract({u}, '//[^/?#]*([^?#]*)', 1), '/+$', '') = '' then '/' else regexp_replace(regexp_extract({u}, '//[^/?#]*([^?#]*)', 1), '/+$', '') end
  || case when len({q}) = 0 then '' else '?' || array_to_string({q}, '&') end end"""
_HOST = "regexp_replace(regexp_replace(lower(regexp_extract({u}, '//([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', '')"
_PAIRS = "list_transform(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {{'k': url_decode(replace(string_split(p, '=')[1], '+', ' ')), 'v': url_decode(replace(regexp_replace(p, '^[^=]*=?', ''), '+', ' '))}})"
_PARAMS = "list_transform(list_sort(list_filter(" + _PAIRS + ", lambda p: not regexp_matches(lower(p.k), 'utm_|^aff') and lower(p.k) not in ('fbclid', 'gclid', 'ref'))), lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+'))"


def _canon(u: str) -> str:
    return _CANON.format(u=u, h=_HOST.format(u=u), q=_PARAMS.format(u=u))


_OK = "ok and trim(coalesce(markdown, ''), ' ') <> ''"
_LINES = "lines as (select run_id, slug, dosya, unnest(list_transform(range(len(string_split(metin, chr(10)))), lambda i: {'i': i, 'l': string_split(metin, chr(10))[i + 1]}), recursive := true) from notlar)"
_SECTIONS = f"""{_LINES},
  q as (select *, sum(case when starts_with(l, '## ') then 1 else 0 end) over (partition by run_id, slug, dosya order by i) - 1 as soru_no from lines),
  s as (select *, last_value(case when starts_with(l, '### ') then trim(substr(l, 5)) end ignore nulls) over (partition by run_id, slug, dosya, soru_no order by i) as bolum from q),
  sections as (select run_id, slug, dosya, cast(soru_no as bigint) soru_no, i satir, bolum, l metin from s where soru_no >= 0 and bolum is not null and not starts_with(l, '## ') and not starts_with(l, '### '))"""


# The verdicts in SQL, by its own steps. It knows straight quotations and no code spans, distances or alignments, which the tables do not hold; v_verdict_vectors has them.
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '</?(?:u|b|i|em|strong|span|sup|sub|small|mark|abbr|kbd|a|font|s|del|ins|wbr)(?:\\s[^<>\\n]*)?/?>', '', 'g'), '\\[([^\\]]*)\\]\\((?:[^()]|\\([^()]*\\))*\\)', '\\1', 'g'), '[`*_\"''“”‘’«»]', '', 'g'), '[|\\s\\x{a0}\\p{Z}]+', ' ', 'g'))"
_NUMBERS = (
    "'(?i)\\d{4}-\\d{2}-\\d{2}|v?\\d+(?:[.,]\\d+)+(?:-[\\p{L}\\p{N}_.]+)?|\\d+(?:[.,]\\d+)?\\s?[-–]\\s?\\d+(?:[.,]\\d+)?\\s?[x×%]?|%\\s?\\d+(?:[.,]\\d+)?|[$€₺]\\s?\\d[\\d.,]*|\\d+(?:[.,]\\d+)?\\s?(?:[×%]|(?:x|ms|saniye|sn|MB|GB|KB|kat|TL|USD|EUR)\\b)|\\d{4,}'"
)
_SPELLED = "case when regexp_full_match(n, '\\d+,\\d{1,2}') then [n, replace(n, ',', '.')] when regexp_full_match(n, '\\d+\\.\\d{1,2}') then [n, replace(n, '.', ',')] when regexp_full_match(n, '\\d{1,3}(?:[.,]\\d{3})+') then [n, regexp_replace(n, '[.,]', '', 'g'), regexp_replace(n, '[.,]', ',', 'g'), regexp_replace(n, '[.,]', '.', 'g')] else [n] end"
_VERDICTS = (
    f"with p as (select {_canon('istenen_url')} u, {_PLAIN.replace('{t}', 'markdown')} m, length(markdown) len, ham_bayt, row_number() over (partition by {_canon('istenen_url')} order by coalesce(fetched_at, 0) desc, kayit_no desc) r from onbellek where {_OK} and trim(coalesce(istenen_url, '')) <> ''), "
    "f as (select distinct run_id, slug, dosya, sira, metin, coalesce(urls, []) urls from bulgular), "
    "q as (select *, list_filter(list_transform(regexp_extract_all(metin, '\"([^\"]*)\"', 1), lambda x: trim(x)), lambda x: length(x) between 12 and 320)[1:3] q, regexp_replace(regexp_replace(regexp_replace(regexp_replace(metin, '\\[[^\\]]*\\]\\((?:[^()]|\\([^()]*\\))*\\)', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '\"[^\"]*\"', ' ', 'g'), '(?i)\\([^()]*(?:birincil|ikincil)[^()]*\\)', ' ', 'g') rest from f), "
    f"n as (select * exclude (rest), list_transform(regexp_extract_all(rest, {_NUMBERS}), lambda x: regexp_replace(regexp_replace(translate(lower(x), '–×', '-x'), '\\s', '', 'g'), '^v', '')) l from q), "
    "e as (select * exclude (l), list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x not in ('', '2024', '2025', '2026', '2027') and not regexp_full_match(x, '(?:19|20)\\d{2}-(?:\\d{1,2}|(?:19|20)\\d{2})'))[1:5] n from n), "
    f"k as (select *, list_transform(q, lambda x: {_PLAIN.replace('{t}', 'x')}) qn, list_transform(n, lambda n: '(?:^|[^\\p{{L}}\\p{{N}}_.,-])(?:' || array_to_string(list_transform({_SPELLED}, lambda v: case when regexp_matches(v, '^\\d+\\.\\d') then 'v?' else '' end || array_to_string(list_transform(string_split(v, ''), lambda c: '[' || c || ']'), '\\s?')), '|') || ')(?:$|[^\\p{{L}}\\p{{N}}_.,]|[.,](?:$|\\D))') np from e), "
    f"t as (select run_id, slug, dosya, sira, len(q) nq, len(q) + len(n) toplam, qn, np, i no, urls[i] url from k, unnest(range(1, 3)) r(i) where i <= len(urls) and len(q) + len(n) > 0), j as (select t.*, p.m, p.len, p.ham_bayt from t left join p on p.r = 1 and p.u = {_canon('t.url')}), "
    "o as (select *, len(list_filter(qn, lambda x: x <> '' and (contains(m, x) or contains(replace(m, '-', ''), replace(x, '-', ''))))) fq, len(list_filter(np, lambda x: regexp_matches(m, x))) fn from j), "
    "v as (select *, fq + fn bulunan, case when m is null then 'UNREACHABLE' when nq > 0 and fq = 0 then 'NOT_FOUND' when fq + fn = toplam then case when nq > 0 or toplam >= 2 then 'VERIFIED' else 'PARTIAL' end when (fq + fn) * 2 >= toplam or nq > 0 then 'PARTIAL' else 'NOT_FOUND' end w from o), "
    "x as (select *, case when w = 'NOT_FOUND' and len < 800 and ham_bayt > 20000 then 'UNREACHABLE' else w end karar from v), b as (select run_id, slug, dosya, sira, arg_max({'karar': karar, 'bulunan': case when karar = 'UNREACHABLE' then 0 else bulunan end, 'toplam': case when karar = 'UNREACHABLE' then 0 else toplam end}, {'r': list_position(['NO_EVIDENCE', 'UNREACHABLE', 'NOT_FOUND', 'PARTIAL', 'VERIFIED'], karar), 'b': case when karar = 'UNREACHABLE' then 0 else bulunan end, 'n': -no}) z from x group by all), "
    "w as (select k.run_id, k.slug, k.dosya, k.sira, coalesce(b.z.karar, case when len(k.q) + len(k.n) > 0 then 'UNREACHABLE' else 'NO_EVIDENCE' end) karar, cast(coalesce(b.z.bulunan, 0) as int) bulunan, cast(coalesce(b.z.toplam, 0) as int) toplam from k left join b using (run_id, slug, dosya, sira)) "
)


def _notes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "notlar")


def _findings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bulgular").withColumnRenamed("metin", "iddia").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>"))).dropDuplicates([*KEY, "sira"])


def _pages(s: SparkSession, d: str, cited: DataFrame) -> DataFrame:
    return cut(J.best_pages(table(s, d, "onbellek", "kayit_no", "istenen_url", "ok", "markdown", "ham_bayt", "fetched_at"), cited))


def _item_urls(items: DataFrame) -> DataFrame:
    return items.select(F.explode(N.bullet_urls(F.col("metin"))).alias("url")).distinct()


def _cited(found: DataFrame) -> DataFrame:
    return found.select(F.explode("urls").alias("url")).distinct()


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    f = _findings(s, d)
    return J.verify(f, _pages(s, d, _cited(f)), [*KEY, "sira"])


# Notes.


@query(f"with {_SECTIONS} select run_id, dosya, soru_no, satir, bolum, metin from sections")
def p_note_sections(s, d):
    return N.section_lines(_notes(s, d), KEY).select("run_id", "dosya", "soru_no", "satir", "bolum", "metin")


@query(
    f"with {_SECTIONS}, b as (select *, trim(metin) t from sections where bolum = 'Alıntılı bulgular'), "
    "c as (select *, trim(regexp_replace(t, '^(?:[-*]|\\d+[.)])\\s+', '')) iddia from b where regexp_matches(t, '^(?:[-*]|\\d+[.)])\\s+')) "
    "select run_id, dosya, soru_no, row_number() over (partition by run_id, slug, dosya order by satir) - 1 as sira, iddia, len(regexp_extract_all(iddia, '\\]\\(https?://')) as adres from c where iddia not in ('', '—', '-')"
)
def p_note_findings(s, d):
    f = N.findings(_notes(s, d), KEY)
    return f.select("run_id", "dosya", "soru_no", "sira", "iddia", F.size(N.bullet_urls(F.col("iddia"))).alias("adres"))


@query(
    f"with {_SECTIONS}, p as (select run_id, slug, dosya, soru_no, 4 - count(distinct case when bolum in ('Özet', 'Alıntılı bulgular', 'Çıkarımlar', 'Boşluklar') then bolum end) e from sections group by all), a as (select run_id, slug, dosya, count(*) sorular, sum(e) eksik_bolum from p group by all), "
    "o as (select run_id, slug, dosya, count(*) maddesiz from sections where bolum = 'Alıntılı bulgular' and trim(metin) not in ('', '-', '- —', '* —', '—') and not regexp_matches(trim(metin), '^(?:```|\\||>)') and not regexp_matches(trim(metin), '^(?:[-*]|\\d+[.)])\\s+') group by all) "
    "select n.run_id, n.slug, n.dosya, coalesce(sorular, 0) as sorular, coalesce(eksik_bolum, 0) as eksik_bolum, coalesce(maddesiz, 0) as maddesiz, length(trim(n.metin)) < 300 as bos, contains(substr(n.metin, 1, 1500), 'ECONNREFUSED') as aramasiz from notlar n left join a using (run_id, slug, dosya) left join o using (run_id, slug, dosya)"
)
def p_note_problems(s, d):
    return N.note_problems(_notes(s, d), KEY)


@query(f"with {_SECTIONS} select run_id, dosya, soru_no, satir, trim(regexp_replace(trim(metin), '^(?:[-*]|\\d+[.)])\\s+', '')) bosluk from sections where bolum = 'Boşluklar' and regexp_matches(trim(metin), '^(?:[-*]|\\d+[.)])\\s+')")
def p_gap_lines(s, d):
    return N.gap_lines(_notes(s, d), KEY).select("run_id", "dosya", "soru_no", "satir", "bosluk")


_ITEMS = (
    f"{_LINES}, c as (select *, trim(l) t, starts_with(trim(l), '```') m from lines), k0 as (select *, sum(m::int) over (partition by run_id, slug, dosya order by i) % 2 = 1 or m fenced from c), "
    "k as (select *, case when fenced or t = '' then 'none' when starts_with(t, '#') then 'head' when regexp_matches(t, '^\\|[\\s:|-]*-[\\s:|-]*$') then 'none' when starts_with(t, '|') then 'table' when starts_with(t, '>') then 'quote' when regexp_matches(l, '^\\s*(?:[-*]|\\d+[.)])\\s+') then 'bullet' else 'text' end k from k0), "
    "h as (select *, last_value(case when k = 'head' then trim(regexp_replace(t, '^#+', '')) end ignore nulls) over (partition by run_id, slug, dosya order by i) baslik, lag(k) over (partition by run_id, slug, dosya order by i) p from k), "
    "g as (select *, sum((k in ('table', 'bullet') or (k = 'quote' and coalesce(p <> 'quote', true)) or (k = 'text' and coalesce(p in ('none', 'head', 'table'), true)))::int) over (partition by run_id, slug, dosya order by i) g from h), "
    "b as (select *, case k when 'table' then trim(regexp_replace(t, '^\\|+|\\|+$', '', 'g')) when 'quote' then trim(regexp_replace(t, '^>', '')) when 'bullet' then regexp_replace(l, '^\\s*(?:[-*]|\\d+[.)])\\s+', '') else t end x from g where k not in ('none', 'head'))"
)


@query(f"with {_ITEMS} select run_id, slug, dosya, cast(min(i) + 1 as int) as satir, case arg_min(k, i) when 'text' then 'paragraph' else arg_min(k, i) end as tur, trim(regexp_replace(string_agg(x, ' ' order by i), '\\s+', ' ', 'g')) as metin, coalesce(arg_min(coalesce(baslik, ''), i), '') as baslik from b group by run_id, slug, dosya, g")
def p_report_items(s, d):
    return S.report_items(_notes(s, d), KEY)


@query(
    f"with {_SECTIONS}, b as (select run_id, slug, dosya, soru_no, regexp_replace(trim(metin), '^(?:[-*]|\\d+[.)])\\s+', '') t from sections where bolum = 'Özet'), c as (select run_id, slug, dosya, soru_no, unnest(string_split(regexp_replace(t, '([.!?])\\s+([\\p{{Lu}}\"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) cumle from b where not regexp_matches(t, '^[|#>]')) "
    "select * from c where length(cumle) >= 12"
)
def p_sentences(s, d):
    lines = N.section_lines(_notes(s, d), KEY).where("bolum = 'Özet'")
    return lines.select(*KEY, "soru_no", F.explode(S.sentences(F.col("metin"))).alias("cumle"))


@query("select kayit_no, list_filter(string_split(markdown, chr(10)), lambda l: starts_with(l, '#')) as basliklar from (select distinct kayit_no, markdown from onbellek where markdown is not null)")
def p_outline(s, d):
    return table(s, d, "onbellek", "kayit_no", "markdown").where("markdown is not null").distinct().select("kayit_no", P.outline(F.col("markdown"), 10**6).alias("basliklar"))


@query()
def p_reader_passages(s, d):
    pages = table(s, d, "onbellek", "kayit_no", "ok", "markdown").where(_OK.replace(", ' ')", ")")).dropDuplicates(["kayit_no"])
    return P.with_passages(pages.select("kayit_no", "markdown"))


@query(
    f"with m as (select distinct kayit_no, markdown from onbellek where {_OK}), a as (select kayit_no, list_filter(list_transform(regexp_split_to_array(markdown, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') p from m), "
    "b as (select kayit_no, [{'o': cast([] as varchar[]), 'b': '', 't': '', 'h': false}] || flatten(list_transform(p, lambda x: case when length(x) > 800 then list_transform(range((length(x) - 1) // 800 + 1), lambda i: {'o': cast([] as varchar[]), 'b': '', 't': substr(x, i * 800 + 1, 800), 'h': true}) else [{'o': cast([] as varchar[]), 'b': '', 't': x, 'h': false}] end)) l from a), "
    "c as (select kayit_no, list_reduce(l, lambda s, x: {'o': case when x.h or (s.b <> '' and length(s.b) + 1 + length(x.t) > 800) then s.o || case when s.b <> '' then [s.b] else [] end || case when x.h then [x.t] else [] end else s.o end, "
    "'b': case when x.h then '' when s.b = '' or length(s.b) + 1 + length(x.t) > 800 then x.t else s.b || chr(10) || x.t end, 't': '', 'h': false}) z from b), d as (select kayit_no, z.o || case when z.b <> '' then [z.b] else [] end o from c) select kayit_no, cast(i - 1 as int) as sira, o[i] as metin from d, unnest(range(1, len(o) + 1)) r(i)"
)
def p_vault_passages(s, d):
    pages = table(s, d, "onbellek", "kayit_no", "ok", "markdown").where("ok and trim(coalesce(markdown, '')) <> ''").dropDuplicates(["kayit_no"])
    return pages.select("kayit_no", F.posexplode(V.passages(F.col("markdown"))).alias("sira", "metin"))


# Text.


@query("select run_id, dosya, sira, list_filter(list_transform(regexp_extract_all(metin, '\"([^\"]*)\"', 1), lambda q: trim(q)), lambda q: length(q) between 12 and 320)[1:3] as alintilar from (select distinct run_id, slug, dosya, sira, metin from bulgular)")
def t_quotes(s, d):
    f = _findings(s, d)
    return f.select("run_id", "dosya", "sira", F.slice(T.quotes(F.col("iddia")), 1, T.QUOTE_CAP).alias("alintilar"))


@query(_VERDICTS + "select run_id, dosya, sira, q as alinti, cast([] as varchar[]) as kod, n as sayi, 0 as fazla from k")
def t_evidence(s, d):
    ev = _findings(s, d).select("run_id", "dosya", "sira", T.evidence(F.col("iddia")).alias("ev"))
    over = F.col("ev.skipped.quotes") + F.col("ev.skipped.codes") + F.col("ev.skipped.numbers")
    return ev.select("run_id", "dosya", "sira", F.col("ev.quotes").alias("alinti"), F.col("ev.codes").alias("kod"), F.col("ev.numbers").alias("sayi"), over.alias("fazla"))


_V = "case when starts_with(sayi, '%') then substr(sayi, 2) else sayi end"
_THOUSANDS = "reverse(regexp_replace(reverse(regexp_replace(c, '[.,]', '', 'g')), '(\\d{{3}})', '\\1{}', 'g'))"


@query(
    f"with s as (select distinct replace(unnest(sayilar), ' ', '') r, unnest(sayilar) sayi0 from bulgular), t as (select sayi0, r as sayi, {_V.replace('sayi', 'r')} c, starts_with(r, '%') p from s), "
    "k as (select *, list_filter([c, case when regexp_full_match(c, '\\d+,\\d{1,2}') then replace(c, ',', '.') end, case when regexp_full_match(c, '\\d+\\.\\d{1,2}') then replace(c, '.', ',') end, case when regexp_full_match(c, '\\d{1,3}(?:[.,]\\d{3})+') then regexp_replace(c, '[.,]', '', 'g') end, "
    f"case when regexp_full_match(c, '\\d{{1,3}}(?:[.,]\\d{{3}})+') then ltrim({_THOUSANDS.format(',')}, ',') end, case when regexp_full_match(c, '\\d{{1,3}}(?:[.,]\\d{{3}})+') then ltrim({_THOUSANDS.format('.')}, '.') end], lambda x: x is not null) l from t), "
    "m as (select sayi0 as sayi, [sayi] || case when p then flatten(list_transform(l, lambda x: [x, x || '%', x || ' %', x || ' percent', x || ' per cent'])) else l end b from k) "
    "select sayi, list_filter(b, lambda x, i: list_position(b, x) = i) as bicimler from m"
)
def t_number_variants(s, d):
    return _findings(s, d).select(F.explode("sayilar").alias("sayi")).distinct().select("sayi", T.number_variants(F.regexp_replace("sayi", " ", "")).alias("bicimler"))


@query("select pasaj_no, trim(regexp_replace(regexp_replace(lower(replace(metin, 'İ', 'i̇')), '(?:https?://|www\\.)[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\p{Z}]+', ' ', 'g'), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') as m from (select distinct pasaj_no, metin from pasaj)")
def t_copy_norm(s, d):
    return table(s, d, "pasaj", "pasaj_no", "metin").distinct().select("pasaj_no", T.copy_norm(F.col("metin")).alias("m"))


@query("select pasaj_no, list_sort(list_distinct(regexp_extract_all(metin, '[\\p{L}\\p{N}_]{3,}'))) as sozcukler, greatest(1, length(metin) // 4) as birim from (select distinct pasaj_no, metin from pasaj)")
def t_word_set(s, d):
    p = table(s, d, "pasaj", "pasaj_no", "metin").distinct()
    return p.select("pasaj_no", F.array_sort(T.word_set(F.col("metin"))).alias("sozcukler"), T.token_estimate(F.col("metin")).alias("birim"))


@query(
    "with f as (select distinct run_id, dosya, sira, regexp_replace(regexp_replace(metin, '\\b\\d{4}-\\d{2}(?:-\\d{2})?\\b', ' ', 'g'), '(?i)\\b(?:PEP|RFC|FIPS|CVE|CWE|CAPEC|ISO|IEC|SP|BCP)[\\s\\-]*\\d[\\d.\\-]*', ' ', 'g') m from bulgular), "
    "r as (select run_id, dosya, sira, list_transform(regexp_extract_all(m, '(?:^|[^\\p{L}\\p{N}_.%])\\d{2,}(?:[.,]\\d+)?%?|%\\d+(?:[.,]\\d+)?'), lambda x: case when starts_with(x, '%') then x else regexp_replace(x, '^[^\\d]', '') end) l from f), k as (select *, list_filter(l, lambda x: not regexp_full_match(x, '20[12]\\d')) n from r) "
    "select run_id, dosya, sira, list_filter(n, lambda x, i: list_position(n, x) = i) as sayilar from k"
)
def t_rare_numbers(s, d):
    return _findings(s, d).select("run_id", "dosya", "sira", T.rare_numbers(F.col("iddia")).alias("sayilar"))


@query()
def t_concrete_items(s, d):
    return p_sentences(s, d).select("run_id", "dosya", "soru_no", F.explode(S.items(F.col("cumle"))).alias("i")).select("run_id", "dosya", "soru_no", "i.*")


@query("select run_id, dosya, sira, cast(regexp_extract(t, '(\\d{4})-\\d{2}', 1) as int) as yil, cast(regexp_extract(t, '\\d{4}-(\\d{2})', 1) as int) as ay, case when contains(lower(t), 'birincil') then 'primary' else 'secondary' end as tur from (select distinct run_id, dosya, sira, regexp_extract_all(metin, '\\([^()]*(?:birincil|ikincil)[^()]*\\)')[-1] as t from bulgular) where t is not null")
def t_citation_tag(s, d):
    rows = _findings(s, d).withColumn("k", T.citation_tag(F.col("iddia"))).where("k is not null")
    return rows.select("run_id", "dosya", "sira", F.col("k.year").alias("yil"), F.col("k.month").alias("ay"), F.col("k.kind").alias("tur"))


@query("select kayit_no, len(regexp_extract_all(lower(markdown), 'ignore (?:all |the )?(?:previous|prior|above) (?:instructions|prompts)|disregard (?:the )?(?:previous|above)|you are now|system prompt|önceki (?:tüm )?talimatları (?:yok say|unut)|reveal your (?:system )?prompt|do not tell the user|new instructions:')) as n from (select distinct kayit_no, markdown from onbellek where markdown is not null)")
def t_injection(s, d):
    return table(s, d, "onbellek", "kayit_no", "markdown").where("markdown is not null").distinct().select("kayit_no", T.injection_count(F.col("markdown")).alias("n"))


@query(
    "select kayit_no, regexp_matches(markdown, '(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]{20,}|\\b(?:[a-z0-9]+[_-])*(?:api[_-]?key|access[_-]?token|auth[_-]?token|secret[_-]?key|client[_-]?secret|password)\\s*[=:]\\s*[^\\s\"'']{6,}') or regexp_matches(markdown, '\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{4,}|\\b(?:sk|pk|rk|gh[pousr]|xox[abpr])[-_][A-Za-z0-9_-]{16,}|\\bAKIA[0-9A-Z]{16}\\b') as gizli from (select distinct kayit_no, markdown from onbellek where markdown is not null)"
)
def t_masked(s, d):
    return table(s, d, "onbellek", "kayit_no", "markdown").where("markdown is not null").distinct().select("kayit_no", (T.mask_secrets(F.col("markdown")) != F.col("markdown")).alias("gizli"))


# Addresses and trust.


@query(f"select distinct istenen_url, {_canon('istenen_url')} as url from onbellek where istenen_url is not null")
def u_canonical(s, d):
    return table(s, d, "onbellek", "istenen_url").where("istenen_url is not null").distinct().select("istenen_url", U.canonical(F.col("istenen_url")).alias("url"))


@query(f"select {_HOST.format(u='url')} as alan, count(distinct url) as n from sayfa where url is not null group by 1")
def u_host_counts(s, d):
    return table(s, d, "sayfa", "url").where("url is not null").groupBy(U.host(F.col("url")).alias("alan")).agg(F.count_distinct("url").alias("n"))


@query(
    "select distinct istenen_url, case when regexp_matches(regexp_extract(istenen_url, '//([^/?#]*)', 1), '^(?:www\\.)?(docs|doc|developer|developers|dev|learn|help|support|manual|reference|api)\\.') then 55 else 50 end"
    " - case when starts_with(istenen_url, 'http://') then 10 else 0 end - case when regexp_matches(lower(regexp_extract(istenen_url, '//[^/?#]*([^?#]*)', 1)), '(?:^|[/-])(best|top-?\\d+|\\d+-best|review|reviews|coupon|coupons|alternatives|cheap|affiliate|ultimate-guide|deals?)(?:[/-]|$)') then 8 else 0 end"
    " - case when regexp_matches(lower(regexp_extract(istenen_url, '\\?([^#]*)', 1)), '(?:^|&)(utm_[a-z]+|aff[a-z_]*|ref|fbclid|gclid)=') then 3 else 0 end as puan from onbellek where istenen_url is not null"
)
def u_trust(s, d):
    return table(s, d, "onbellek", "istenen_url").where("istenen_url is not null").distinct().select("istenen_url", U.trust_score(F.col("istenen_url")).alias("puan"))


def _with_hints(s: SparkSession, d: str, f: DataFrame) -> DataFrame:
    """Findings with ``ipucu``, the sources their plan names (J02): those of all plans where the plan has no text for them; an empty text names none."""
    plan = table(s, d, "plan_konu", "slug", "kaynaklar").where("kaynaklar is not null").select("slug", U.hints(F.col("kaynaklar")).alias("__own"))  # as few rows as there are topics
    every = plan.agg(F.array_distinct(F.flatten(F.collect_list("__own"))).alias("__every"))
    return f.join(bounded(plan), "slug", "left").crossJoin(F.broadcast(every)).withColumn("ipucu", F.coalesce("__own", "__every")).drop("__own", "__every")


_TRUST = (
    "case when regexp_matches(regexp_extract({u}, '//([^/?#]*)', 1), '^(?:www\\.)?(docs|doc|developer|developers|dev|learn|help|support|manual|reference|api)\\.') then 55 else 50 end - case when starts_with({u}, 'http://') then 10 else 0 end - case when regexp_matches(lower(regexp_extract({u}, '//[^/?#]*([^?#]*)', 1)), '(?:^|[/-])(best|top-?\\d+|\\d+-best|review|reviews|coupon|coupons|alternatives|cheap|affiliate|ultimate-guide|deals?)(?:[/-]|$)') then 8 else 0 end - case when regexp_matches(lower(regexp_extract({u}, '\\?([^#]*)', 1)), '(?:^|&)(utm_[a-z]+|aff[a-z_]*|ref|fbclid|gclid)=') then 3 else 0 end"
)


_H, _P = _HOST.format(u="url"), "lower(regexp_extract(url, '//[^/?#]*([^?#]*)', 1))"
_PLANNED = (
    "with h as (select slug, list_transform(regexp_extract_all(kaynaklar, '(?i)(?:^|[^\\p{L}\\p{N}_@])((?:[a-z0-9-]+\\.)+[a-z]{2,}(?:/[\\p{L}\\p{N}_./%-]*)?)', 1), lambda t: {'h': regexp_replace(lower(regexp_extract(t, '^[^/]*')), '^www\\.', ''), 'p': regexp_replace(lower(regexp_extract(t, '/.*$')), '/+$', '')}) l from plan_konu where kaynaklar is not null), "
    "ev as (select list_distinct(flatten(list(l))) l from h), f as (select distinct run_id, slug, dosya, sira, metin, urls from bulgular where len(urls) > 0), u as (select f.*, url, no, coalesce(h.l, ev.l) l from f left join h using (slug) cross join ev, unnest(f.urls) with ordinality r(url, no)), "
    f"m as (select u.* exclude (l), list_filter(l, lambda i: ({_H} = i.h or (i.h not in ({', '.join(repr(x) for x in U.MULTI_TENANT)}) and ends_with({_H}, '.' || i.h))) and (i.p = '' or {_P} = i.p or starts_with({_P}, i.p || '/'))) i from u), "
    "g as (select *, least(100, greatest(0, @TRUST@ + case when len(i) > 0 then 10 else 0 end)) puan from m) "
)


def _planned(rest: str) -> str:
    return _PLANNED.replace("@TRUST@", _TRUST.replace("{u}", "url")) + rest


@query(
    _planned(
        "select run_id, dosya, sira, max(puan) as puan, list_filter([case when max(puan) < 50 then 'weak' end, case when max(puan) < 65 and not bool_or(len(i) > 0) and contains(lower(any_value(tag)), 'birincil') then 'primary-mismatch' end, case when (2026 - cast(any_value(t)[1:4] as int)) * 12 + 1 - cast(any_value(t)[6:7] as int) >= 18 then 'stale' end], lambda x: x is not null) as bayrak "
        "from (select *, regexp_extract_all(metin, '(?i)\\([^()]*(?:birincil|ikincil)[^()]*\\)')[-1] tag, list_max(regexp_extract_all(tag, '\\d{4}-(?:0[1-9]|1[0-2])')) t from g) group by run_id, slug, dosya, sira"
    )
)
def u_assessment(s, d):
    f = _with_hints(s, d, _findings(s, d).where(F.size("urls") > 0))
    planned = lambda u: F.exists("ipucu", lambda x: U.hint_matches(u, x["h"], x["p"]))
    f = f.withColumn("k", F.transform("urls", lambda u: F.struct(u.alias("u"), planned(u).alias("p")))).withColumn("k", F.transform("k", lambda x: F.struct(U.trust_score(x["u"], x["p"]).alias("n"), x["p"].alias("p"))))
    best, named = F.array_max("k.n"), F.exists("k", lambda x: x["p"])
    tag = T.citation_tag(F.col("iddia"))
    flags = F.array_compact(F.array(F.when(best < 50, "weak"), F.when((tag["kind"] == "primary") & (best < 65) & ~named, "primary-mismatch"), F.when(T.age_months(tag, 2026, 1) >= 18, "stale")))
    return f.select("run_id", "dosya", "sira", best.alias("puan"), flags.alias("bayrak"))


@query(_planned("select distinct run_id, dosya, sira, url, unnest(i).h as hh from m"))
def u_planned(s, d):
    rows = _with_hints(s, d, _findings(s, d)).select("run_id", "dosya", "sira", F.explode("urls").alias("url"), "ipucu")
    hits = rows.withColumn("i", F.explode(F.filter("ipucu", lambda x: U.hint_matches(F.col("url"), x["h"], x["p"]))))
    return hits.select("run_id", "dosya", "sira", "url", F.col("i.h").alias("hh")).distinct()


@query("select host as alan, count(distinct url) as adres, round(avg(case when starts_with(url, 'http://') then 40.0 else 50.0 end + case when regexp_matches(host, '^(docs|doc|developer|developers|dev|learn|help|support|manual|reference|api)\\.') then 5 else 0 end), 6) as ortalama from (select distinct url, regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\\.', '') host from sayfa where url is not null) group by 1")
def a_domain_trust(s, d):
    p = table(s, d, "sayfa", "url").where("url is not null").distinct()
    return p.groupBy(U.host(F.col("url")).alias("alan")).agg(F.count_distinct("url").alias("adres"), F.round(F.avg(U.trust_score(F.col("url"))), 6).alias("ortalama"))


# Verdicts.


@query(_VERDICTS + "select run_id, slug, dosya, sira, karar, bulunan, toplam from w")
def v_verdict_table(s, d):
    return _verdicts(s, d).select(*KEY, "sira", "karar", "bulunan", "toplam")


@query()
def v_verdicts(s, d):
    return _verdicts(s, d)


@query(_VERDICTS + "select karar, count(*) as n from w group by 1")
def v_verdict_counts(s, d):
    return _verdicts(s, d).groupBy("karar").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "karar")


@query(
    f"with p as (select {_canon('istenen_url')} u, markdown, row_number() over (partition by {_canon('istenen_url')} order by coalesce(fetched_at, 0) desc, kayit_no desc) r from onbellek where {_OK} and trim(coalesce(istenen_url, '')) <> ''), "
    "f as (select distinct run_id, dosya, sira, alintilar, urls from bulgular), q as (select run_id, dosya, sira, unnest(alintilar) q, urls from f), u as (select run_id, dosya, sira, q, unnest(urls[1:2]) url from q where length(q) between 12 and 320), "
    f"c as (select *, {_canon('url')} cu from u) select run_id, dosya, sira, q as alinti, coalesce(bool_or(contains(lower(p.markdown), lower(q))), false) as var from c left join p on p.u = c.cu and p.r = 1 group by all"
)
def v_quote_on_page(s, d):
    """Whether a quotation stands letter by letter on one of the first two pages cited."""
    ok = table(s, d, "onbellek", "kayit_no", "istenen_url", "ok", "markdown", "fetched_at").where("ok and trim(coalesce(markdown, '')) <> '' and trim(coalesce(istenen_url, '')) <> ''")
    p = ok.groupBy(U.canonical(F.col("istenen_url")).alias("cu")).agg(F.lower(F.max_by("markdown", F.struct(F.coalesce("fetched_at", F.lit(0.0)), "kayit_no"))).alias("m"))
    q = _findings(s, d).select("run_id", "dosya", "sira", F.explode("alintilar").alias("alinti"), F.slice("urls", 1, 2).alias("u")).where(F.length("alinti").between(12, 320)).withColumn("url", F.explode("u"))
    rows = q.withColumn("cu", U.canonical(F.col("url"))).join(p, "cu", "left")
    return rows.groupBy("run_id", "dosya", "sira", "alinti").agg(F.coalesce(F.bool_or(F.contains("m", F.lower("alinti"))), F.lit(False)).alias("var"))


@query(_VERDICTS + "select count(*) as toplam, count(*) filter (len(urls) > 0) as adresli, count(*) filter (len(urls) > 0 and len(q) + len(n) > 0) as denenen, count(*) filter (len(urls) > 0 and len(q) + len(n) = 0) as kanitsiz, count(*) filter (len(urls) = 0) as adressiz, 0 as sinir_ustu from k")
def v_coverage(s, d):
    return J.coverage(_findings(s, d))


@query()
def v_support(s, d):
    lines, f = N.section_lines(_notes(s, d), KEY), N.findings(_notes(s, d), KEY)
    return S.support(lines, f, _pages(s, d, _cited(f)), KEY)


@query()
def v_support_severity(s, d):
    return S.severity(v_support(s, d))


@query()
def v_report_check(s, d):
    items = p_report_items(s, d)
    return S.check_report(items, _pages(s, d, _item_urls(items)), KEY, pool=True)


_REPORT_KEY = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({u}, '//([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', ''), '^.*@', '') || regexp_replace(regexp_extract({u}, '//[^/?#]*([^?#]*)', 1), '/+$', '') || case when regexp_extract({u}, '\\?([^#]*)', 1) <> '' then '?' || regexp_extract({u}, '\\?([^#]*)', 1) else '' end"


@query(
    f"with {_LINES}, c as (select *, trim(l) t, starts_with(trim(l), '```') m from lines), k as (select *, sum(m::int) over (partition by run_id, slug, dosya order by i) % 2 = 1 or m fenced from c), it as (select * from k where not fenced and t <> '' and not starts_with(t, '#') and not regexp_matches(t, '^\\|[\\s:|-]*-[\\s:|-]*$')), "
    "u as (select distinct run_id, slug, dosya, regexp_replace(unnest(regexp_extract_all(l, 'https?://[^\\s)<>\\]]+')), '[.,;:`''\"*>]+$', '') url from it), "
    f"nk as (select distinct {_REPORT_KEY.replace('{u}', 'x')} y from (select unnest(urls) x from bulgular)), pg as (select distinct {_canon('istenen_url')} y from onbellek where {_OK}) "
    f"select run_id, slug, dosya, url, 'not in notes' as sorun from u where {_REPORT_KEY.replace('{u}', 'url')} not in (select y from nk where y is not null) union all select run_id, slug, dosya, url, 'unreadable' from u where {_canon('url')} not in (select y from pg where y is not null) union all select run_id, slug, dosya, url, 'weak' from u where {_TRUST.replace('{u}', 'url')} < 50 "
    "union all select run_id, slug, dosya, null, 'no url' from (select distinct run_id, slug, dosya from it) a where not exists (select 1 from u where u.run_id = a.run_id and u.slug = a.slug and u.dosya = a.dosya)"
)
def v_report_extras(s, d):
    noted = _findings(s, d).select(F.explode("urls").alias("url"))
    items = p_report_items(s, d)
    return S.report_extras(items, noted, _pages(s, d, _item_urls(items)), KEY)


_NOTE_PROBLEMS = ORACLE["p_note_problems"]


@query(
    f"with pr as ({_NOTE_PROBLEMS}), nf as (with {_SECTIONS}, b as (select *, trim(metin) t from sections where bolum = 'Alıntılı bulgular'), c as (select *, trim(regexp_replace(t, '^(?:[-*]|\\d+[.)])\\s+', '')) iddia from b where regexp_matches(t, '^(?:[-*]|\\d+[.)])\\s+')) select run_id, slug, dosya, row_number() over (partition by run_id, slug, dosya order by satir) - 1 as sira, trim(regexp_replace(iddia, '[\\s\\x{{a0}}\\p{{Z}}]+', ' ', 'g')) anahtar, iddia from c where iddia not in ('', '—', '-')), nu as (select run_id, slug, dosya, count(distinct u) adres from (select run_id, slug, dosya, unnest(regexp_extract_all(iddia, 'https?://[^\\s)<>\\]]+')) u from nf) group by all), "
    "r as (select n.metin, pr.sorular, pr.eksik_bolum, len(p.sorular) plan_soru, coalesce(nu.adres, 0) adres, coalesce(greatest(3, least(p.min_url_required, 30)), 3) en_az from notlar n join pr using (run_id, slug, dosya) left join plan_konu p using (slug) left join nu using (run_id, slug, dosya)) "
    "select case when strlen(metin) < 300 then 'too short' when regexp_matches(regexp_replace(substr(metin, 1, 1200), '(?m)^#.*$', '', 'g'), '(?i)\\b(onayınız|onaylıyor musun|planım|I will now|shall I proceed|awaiting approval)\\b') then 'planning talk' when sorular = 0 then 'no question' when plan_soru is not null and sorular < plan_soru then 'questions missing' "
    "when eksik_bolum > 0 then 'sections missing' when adres < en_az then 'too few sources' end as neden, count(*) as n from r group by 1"
)
def v_contract(s, d):
    n = _notes(s, d)
    return N.contract(n, table(s, d, "plan_konu"), N.findings(n, KEY), KEY).groupBy("neden").agg(F.count("*").alias("n"))


@query(
    "with f as (select distinct run_id, slug, dosya, sira, urls from bulgular), n as (select distinct run_id, slug, dosya from f), u as (select run_id, slug, dosya, count(distinct x) a from (select run_id, slug, dosya, unnest(urls) x from f) group by all) "
    "select n.run_id, n.dosya, coalesce(u.a, 0) as adres, coalesce(p.min_url, p.min_url_required, 8) as en_az from n left join u using (run_id, slug, dosya) left join plan_konu p using (slug) where coalesce(u.a, 0) < coalesce(p.min_url, p.min_url_required, 8)"
)
def v_weak_notes(s, d):
    return N.weak_notes(_findings(s, d), table(s, d, "plan_konu"), KEY).select("run_id", "dosya", "adres", "en_az")


@query(
    "with o as (select unnest(list(slug)) slug from plan_konu where len(olgular) > 0 group by to_json(olgular) having count(*) > 1), q as (select k.*, k.slug in (select slug from o) ortak from plan_konu k) select p.slug, list_filter(['slug', 'topic', 'questions', 'min_url', 'min_url_required', 'publisher', 'too many facts', 'empty fact', 'shared facts'], lambda x: case x "
    "when 'slug' then not coalesce(regexp_full_match(p.slug, '[a-z0-9][a-z0-9-]{0,40}'), false) when 'topic' then trim(coalesce(konu, '')) = '' when 'questions' then coalesce(len(sorular), 0) = 0 when 'min_url' then coalesce(min_url not between 3 and 30, false) when 'min_url_required' then coalesce(min_url_required not between 2 and 30, false) "
    "when 'publisher' then coalesce(not regexp_full_match(single_publisher_host, '(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{2,}'), false) when 'too many facts' then coalesce(len(olgular) > 40, false) when 'empty fact' then coalesce(len(list_filter(olgular, lambda f: trim(coalesce(f.ad, '')) = '' or trim(coalesce(f.ara, '')) = '')) > 0, false) "
    "else coalesce(ortak, false) end) as sorunlar from q p"
)
def v_plan_problems(s, d):
    return C.plan_problems(table(s, d, "plan_konu"))


@query("select slug, len(list_filter(regexp_split_to_array(coalesce(konu, ''), ',|;|\\bve\\b|/'), lambda x: trim(x) <> '')) as varlik from plan_konu where len(list_filter(regexp_split_to_array(coalesce(konu, ''), ',|;|\\bve\\b|/'), lambda x: trim(x) <> '')) >= 6")
def v_broad_topics(s, d):
    return R.broad_topics(table(s, d, "plan_konu"))


@query("select kayit_no, regexp_matches(lower(coalesce(markdown, '')), 'ignore (?:all |the )?(?:previous|prior|above) (?:instructions|prompts)|disregard (?:the )?(?:previous|above)|you are now|system prompt|önceki (?:tüm )?talimatları (?:yok say|unut)|reveal your (?:system )?prompt|do not tell the user|new instructions:') as enjeksiyon from (select distinct kayit_no, markdown from onbellek)")
def v_injection_flags(s, d):
    return R.injection_flags(table(s, d, "onbellek", "kayit_no", "markdown").distinct()).select("kayit_no", "enjeksiyon")


@query()
def v_trimmed(s, d):
    return R.trim_sections(_notes(s, d), table(s, d, "plan_konu"), KEY).select("run_id", "slug", "dosya", "atilan", F.length("metin").alias("uzunluk"))


@query()
def v_referee_candidates(s, d):
    return R.referee_candidates(_notes(s, d), KEY)


@query()
def v_marked(s, d):
    """Notes with their unsupported sentences marked."""
    return R.mark_unsupported(_notes(s, d), cut(v_support(s, d)), KEY).select("run_id", "slug", "dosya", "isaretlenen")


@query(
    f"with v as (select {_canon('url')} u, max(coalesce(alindi, 0)) t from sayfa where url is not null group by 1), c as (select distinct {_canon('istenen_url')} u from onbellek where ok and istenen_url is not null), n as (select slug, regexp_extract_all(metin, 'https?://[^\\s)<>\\]]+') l from notlar), "
    f"x as (select slug, i - 1 i, {_canon('l[i]')} u from n, unnest(range(1, len(l) + 1)) r(i)), m as (select slug, i, u, t, regexp_replace(regexp_extract(u, '//([^/?#]*)', 1), '^www\\.', '') h from x join v using (u) semi join c using (u)), "
    "h as (select slug, h, min(i) i, count(*) n, max(t) t from m group by all), g as (select slug, cast(sum(n) as bigint) kaynak, max(t) en_yeni, (list(h order by i, h))[1:8] alanlar from h group by slug) "
    "select slug, kaynak, en_yeni, alanlar, 'GÜNCELLEME KİPİ: bu konuda daha önce ' || kaynak || ' kaynak okundu (en yeni ' || strftime(make_timestamp(cast(floor(en_yeni * 1000000) as bigint)), '%Y-%m-%d') || '); yeni gelişmelere ve 30 günden eski kaynakların değişip değişmediğine odaklan, aynı kaynakları baştan tarama. Önceki kaynaklar: ' || array_to_string(alanlar, ', ') as cumle from g"
)
def j_update_plan(s, d):
    cached = table(s, d, "onbellek", "istenen_url", "ok").where("ok").select(F.col("istenen_url").alias("url"))
    return R.update_plan(_notes(s, d), table(s, d, "sayfa", "url", "alindi"), cached)


# Joins.


@query(
    "with k as (select slug, unnest(list_transform(range(len(olgular)), lambda i: {'no': i, 'o': olgular[i + 1]}), recursive := true) from plan_konu where olgular is not null), f as (select distinct slug, run_id, regexp_replace(regexp_replace(metin, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\([^()]*(?:birincil|ikincil)[^()]*\\)', ' ', 'g') t from bulgular) "
    "select distinct slug, cast(no as int) as no, run_id from k join f using (slug) where trim(ad) <> '' and trim(ara) <> '' and regexp_matches(lower(t), lower(ara))"
)
def j_fact_hits(s, d):
    return C.fact_hits(C.facts(table(s, d, "plan_konu")), _findings(s, d))


@query(
    f"with a0 as (with {_SECTIONS}, b as (select *, trim(metin) t from sections where bolum = 'Alıntılı bulgular'), c as (select *, trim(regexp_replace(t, '^(?:[-*]|\\d+[.)])\\s+', '')) iddia from b where regexp_matches(t, '^(?:[-*]|\\d+[.)])\\s+')) select run_id, slug, dosya, row_number() over (partition by run_id, slug, dosya order by satir) - 1 as sira, trim(regexp_replace(iddia, '[\\s\\x{{a0}}\\p{{Z}}]+', ' ', 'g')) anahtar, iddia from c where iddia not in ('', '—', '-')), b0 as ({_VERDICTS} select run_id, slug, dosya, trim(regexp_replace(k.metin, '[\\s\\x{{a0}}\\p{{Z}}]+', ' ', 'g')) anahtar, sira, karar from w join k using (run_id, slug, dosya, sira)), "
    "a as (select *, row_number() over (partition by run_id, slug, dosya, anahtar order by sira) kacinci from a0), b as (select *, row_number() over (partition by run_id, slug, dosya, anahtar order by sira) kacinci from b0) "
    "select run_id, slug, dosya, anahtar, cast(a.kacinci as int) as kacinci, cast(a.sira as int) as sira, b.sira as karar_sira, b.karar as karar from a left join b using (run_id, slug, dosya, anahtar, kacinci)"
)
def j_ordered_match(s, d):
    a = N.findings(_notes(s, d), KEY).withColumn("anahtar", C.claim_key(F.col("iddia"))).select(*KEY, "anahtar", "sira")
    b = _verdicts(s, d).join(_findings(s, d).select(*KEY, "sira", C.claim_key(F.col("iddia")).alias("anahtar")), [*KEY, "sira"]).select(*KEY, "anahtar", F.col("sira").alias("karar_sira"), "karar")
    return C.match_in_order(a, b, [*KEY, "anahtar"], ["sira"], ["karar_sira"])


_JUDGED = f"judged as ({_VERDICTS} select run_id, slug, dosya, sira, trim(regexp_replace(k.metin, '[\\s\\x{{a0}}\\p{{Z}}]+', ' ', 'g')) anahtar, k.metin iddia, karar from w join k using (run_id, slug, dosya, sira))"


@query(
    f"with {_LINES}, {_JUDGED}, bullets as (select *, case when regexp_matches(trim(l), '^(?:[-*]|\\d+[.)])\\s+') then trim(regexp_replace(regexp_replace(trim(l), '^(?:[-*]|\\d+[.)])\\s+', ''), '[\\s\\x{{a0}}\\p{{Z}}]+', ' ', 'g')) end anahtar from lines), "
    "v as (select run_id, slug, dosya, anahtar, bool_or(karar = 'NOT_FOUND') gone, bool_or(karar = 'PARTIAL') part from judged group by all), r as (select b.*, coalesce(gone, false) gone, coalesce(part, false) part from bullets b left join v using (run_id, slug, dosya, anahtar)) "
    "select run_id, slug, dosya, coalesce(string_agg(case when part then regexp_replace(l, '^(\\s*(?:[-*]|\\d+[.)])\\s+)', '\\1⚠ [Kısmen: partial evidence] ') else l end, chr(10) order by i) filter (not gone), '') as metin, cast(count(*) filter (gone) as int) as cikan from r group by all"
)
def j_clean_notes(s, d):
    v = _verdicts(s, d).join(_findings(s, d).select(*KEY, "sira", C.claim_key(F.col("iddia")).alias("iddia")), [*KEY, "sira"])
    return N.clean_lines(_notes(s, d), v.select(*KEY, "iddia", "karar", "neden"), KEY)


@query(
    f"with {_SECTIONS}, {_JUDGED}, gone as (select run_id, slug, dosya, iddia, unnest(list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(iddia, '\\b\\d{{4}}-\\d{{2}}(?:-\\d{{2}})?\\b', ' ', 'g'), '(?i)\\b(?:PEP|RFC|FIPS|CVE|CWE|CAPEC|ISO|IEC|SP|BCP)[\\s\\-]*\\d[\\d.\\-]*', ' ', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_.%])\\d{{2,}}(?:[.,]\\d+)?%?|%\\d+(?:[.,]\\d+)?'), lambda x: case when starts_with(x, '%') then x else regexp_replace(x, '^[^\\d]', '') end)), lambda x: not regexp_full_match(x, '20[12]\\d'))) sayi from judged where karar = 'NOT_FOUND'), "
    f"kept as (select run_id, slug, dosya, satir, unnest(list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(trim(metin), '\\b\\d{{4}}-\\d{{2}}(?:-\\d{{2}})?\\b', ' ', 'g'), '(?i)\\b(?:PEP|RFC|FIPS|CVE|CWE|CAPEC|ISO|IEC|SP|BCP)[\\s\\-]*\\d[\\d.\\-]*', ' ', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_.%])\\d{{2,}}(?:[.,]\\d+)?%?|%\\d+(?:[.,]\\d+)?'), lambda x: case when starts_with(x, '%') then x else regexp_replace(x, '^[^\\d]', '') end)), lambda x: not regexp_full_match(x, '20[12]\\d'))) sayi from sections where trim(metin) <> '' and not starts_with(trim(metin), '#') and not regexp_matches(trim(metin), '[\"“]')) "
    "select run_id, slug, dosya, iddia, satir, list(distinct sayi order by sayi) as sayilar from gone join kept using (run_id, slug, dosya, sayi) group by all"
)
def j_leftover_mentions(s, d):
    gone = _verdicts(s, d).where("karar = 'NOT_FOUND'").join(_findings(s, d).select(*KEY, "sira", "iddia"), [*KEY, "sira"])
    return N.leftover_mentions(gone, N.section_lines(_notes(s, d), KEY), KEY)


def _copy_pairs(cap: int | None) -> str:
    return _COPY_PAIRS.replace("{text}", f"substr({_COPY_TEXT}, 1, {cap})" if cap else _COPY_TEXT)


_COPY_TEXT = "trim(regexp_replace(regexp_replace(lower(replace(t, 'İ', 'i̇')), '(?:https?://|www\\.)[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\p{Z}]+', ' ', 'g'), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"
_COPY_PAIRS = (
    "with p as (select url, string_agg(m, chr(10) order by sira) t from (select distinct url, sira, coalesce(metin, '') m from pasaj) group by url), w as (select url, list_filter(string_split({text}, ' '), lambda x: x <> '') w from p), "
    "s as (select distinct url, unnest(case when len(w) = 0 then [] when len(w) < 8 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) end) x from w), n as (select url, count(*) n from s group by url) "
    "select a.url as a, b.url as b, round(cast(count(*) as double) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) as benzerlik from s a join s b on a.x = b.x and a.url < b.url join n na on na.url = a.url join n nb on nb.url = b.url group by 1, 2 having count(*) * 1.0 / (any_value(na.n) + any_value(nb.n) - count(*)) >= 0.85"
)


def _copy_texts(s: SparkSession, d: str) -> DataFrame:
    return V.page_texts(table(s, d, "pasaj", "url", "sira", "metin"))


@query(_copy_pairs(None))
def j_copy_pairs(s, d):
    return V.copy_pairs(_copy_texts(s, d)).withColumn("benzerlik", F.round("benzerlik", 6))


@query(_copy_pairs(V.PARITY_CAP))
def j_copy_pairs_parity(s, d):
    """As the earlier tooling compares: the first ``PARITY_CAP`` characters of the copy form."""
    return V.copy_pairs(_copy_texts(s, d), cap=V.PARITY_CAP).withColumn("benzerlik", F.round("benzerlik", 6))


@query(
    f"with recursive cp as ({_copy_pairs(None)}), e as (select a, b from cp union select b, a from cp), g(n, r) as (select a, a from e union select e.b, g.r from g join e on g.n = e.a where g.r < e.b), m as (select n, min(r) r from g group by n), "
    "o as (select url, min(coalesce(alindi, 0)) t from sayfa where url is not null group by url), c as (select o.url, t, coalesce(m.r, o.url) r from o left join m on m.n = o.url), f as (select r, arg_min(url, {'t': t, 'u': url}) first from c group by r) "
    "select c.url, substr(sha1(f.first), 1, 12) as grup from c join f using (r)"
)
def r_copy_groups(s, d):
    return V.copy_groups(table(s, d, "sayfa", "url", "alindi"), V.class_edges(*V.copy_classes(_copy_texts(s, d))))


@query(f"select u as url, alindi, kayit_no from (select *, row_number() over (partition by u order by alindi desc, kayit_no) r from (select distinct {_canon('istenen_url')} u, coalesce(fetched_at, 0) alindi, kayit_no from onbellek where {_OK}) where u <> '') where r = 1")
def r_upsert(s, d):
    return V.upsert(table(s, d, "onbellek", "istenen_url", "ok", "markdown", "fetched_at", "kayit_no"))


@query(
    f"with r as (select distinct {_canon('istenen_url')} u, coalesce(fetched_at, 0) t, kayit_no from onbellek where {_OK}), b as (select *, max(t) over (partition by u order by kayit_no rows between unbounded preceding and 1 preceding) m from r where u <> '') "
    "select case when m is null then 'added' when t > m then 'updated' else 'skipped' end as islem, count(*) as n from b group by 1"
)
def r_upsert_counts(s, d):
    return V.upsert_counts(table(s, d, "onbellek", "istenen_url", "ok", "markdown", "fetched_at", "kayit_no"))


_CITED = "c as (select distinct run_id, dosya, x url from (select run_id, dosya, unnest(urls) x from bulgular)), g as (select kopya_grubu, count(distinct url) n from sayfa where kopya_grubu is not null group by 1), p as (select url, any_value(host) host, any_value(kopya_grubu) k from sayfa group by url)"


@query(
    f"with {_CITED} select run_id, dosya, count(*) as adres, count(p.url) as okunan, count(distinct regexp_replace(lower(regexp_extract(c.url, '//([^/?#]*)', 1)), '^www\\.', '')) as alan_adi, "
    "count(distinct case when p.url is not null then regexp_replace(lower(regexp_extract(c.url, '//([^/?#]*)', 1)), '^www\\.', '') end) as okunan_alan_adi, count(distinct case when p.url is not null then case when g.n > 1 then 'g:' || p.k when p.host is not null then 'h:' || p.host end end) as bagimsiz from c left join p using (url) left join g on g.kopya_grubu = p.k group by all"
)
def a_independence(s, d):
    cited = _findings(s, d).select("run_id", "dosya", F.explode("urls").alias("url"))
    pages = table(s, d, "sayfa").select("url", "host", F.col("kopya_grubu").alias("grup"))
    return V.independent_sources(cited, pages, ["run_id", "dosya"])


@query(
    f"with {_CITED}, n as (select run_id, dosya, count(*) a, count(p.url) o, count(distinct regexp_replace(lower(regexp_extract(c.url, '//([^/?#]*)', 1)), '^www\\.', '')) h, count(distinct case when p.url is not null then regexp_replace(lower(regexp_extract(c.url, '//([^/?#]*)', 1)), '^www\\.', '') end) ho, count(distinct case when p.url is not null then case when g.n > 1 then 'g:' || p.k when p.host is not null then 'h:' || p.host end end) b from c left join p using (url) left join g on g.kopya_grubu = p.k group by all), "
    "m as (select run_id, dosya, p.k, list(distinct c.url order by c.url) u from c join p using (url) where p.k is not null group by all having count(distinct c.url) > 1) select count(*) as not_, coalesce(sum(h), 0) as alan_adi, coalesce(sum(ho), 0) as okunan_alan_adi, coalesce(sum(a - o), 0) as okunamayan, coalesce(sum(b), 0) as bagimsiz, (select count(distinct u) from m) as kopya_grubu from n"
)
def a_independence_totals(s, d):
    cited = _findings(s, d).select("run_id", "dosya", F.explode("urls").alias("url"))
    pages = table(s, d, "sayfa").select("url", "host", F.col("kopya_grubu").alias("grup"))
    return V.independence_totals(cited, pages, ["run_id", "dosya"])


@query(
    "with k as (select distinct slug, unnest(list_transform(range(len(olgular)), lambda i: {'no': i, 'o': olgular[i + 1]}), recursive := true) from plan_konu where olgular is not null), e as (select slug, no, trim(ad) ad, ara from k where trim(ad) <> '' and trim(ara) <> ''), "
    "f as (select distinct slug, run_id, regexp_replace(regexp_replace(metin, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\([^()]*(?:birincil|ikincil)[^()]*\\)', ' ', 'g') t from bulgular), h as (select distinct slug, no, run_id from e join f using (slug) where regexp_matches(lower(t), lower(ara))), "
    "c as (select slug, count(*) toplam, count(*) filter ((slug, no) in (select (slug, no) from h)) kapsanan, coalesce(list(ad order by no) filter ((slug, no) not in (select (slug, no) from h)), []) eksik from e group by slug), "
    "r as (select slug, list(run_id || ':' || n order by run_id) calistirma from (select f.slug, f.run_id, (select count(distinct no) from h where h.slug = f.slug and h.run_id = f.run_id) n from (select distinct slug, run_id from f) f) group by slug) "
    "select c.slug, toplam, kapsanan, cast(floor(100.0 * kapsanan / toplam) as int) as yuzde, eksik, calistirma from c left join r using (slug)"
)
def a_topic_coverage(s, d):
    k, f = C.facts(table(s, d, "plan_konu")), _findings(s, d)
    return R.topic_coverage(k, C.fact_hits(k, f), f).withColumn("calistirma", F.transform("calistirma", lambda x: F.concat_ws(":", x["run_id"], x["n"].cast("string"))))


@query(
    _planned(
        f", b as (select alan, arg_min(url, {{'p': -puan, 'r': run_id, 'd': dosya, 's': sira, 'n': no}}) url, max(puan) puan from (select *, {_H} alan from g) where alan <> '' group by alan) select alan, url, case when regexp_matches(alan, '^(docs|doc|developer|developers|dev|learn|help|support|manual|reference|api)\\.') then 'docs-like' else 'unknown' end as sinif, cast(puan as int) as puan, round((select avg(puan) from b), 6) as ortalama from b"
    )
)
def a_host_trust(s, d):
    """The best-scored address of each host that findings cite."""
    f = _with_hints(s, d, _findings(s, d)).select("run_id", "dosya", "sira", F.posexplode("urls").alias("no", "url"), "ipucu")
    return R.best_of_hosts(f.withColumn("planli", F.exists("ipucu", lambda x: U.hint_matches(F.col("url"), x["h"], x["p"]))), ["run_id", "dosya", "sira", "no"])


@query(
    "with f as (select distinct run_id, dosya, sira, list_max(regexp_extract_all(regexp_extract_all(metin, '\\([^()]*(?:birincil|ikincil)[^()]*\\)')[-1], '\\d{4}-(?:0[1-9]|1[0-2])')) t from bulgular), k as (select t from f where t is not null and (2026 - cast(t[1:4] as int)) * 12 + 1 - cast(t[6:7] as int) >= 18) select count(*) as n, min(t) as ilk, max(t) as son from k"
)
def a_stale_dates(s, d):
    return R.stale_dates(_findings(s, d), 2026, 1)


@query("select (select count(distinct url) from sayfa) as sayfa, (select count(distinct host) from sayfa) as alan_adi, (select min(alindi) from sayfa) as ilk, (select max(alindi) from sayfa) as son, (select count(distinct pasaj_no) from pasaj) as pasaj, (select count(*) from (select kopya_grubu from sayfa where kopya_grubu is not null group by 1 having count(distinct url) > 1)) as kopya_grubu")
def a_vault_statistics(s, d):
    return V.statistics(table(s, d, "sayfa"), table(s, d, "pasaj", "pasaj_no"))


_TERMS = ["audit", "log", "archive", "storage"]


@query(
    "with p as (select distinct pasaj_no, list_filter(regexp_extract_all(lower(metin), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_.\\-+%/]*'), lambda t: length(t) > 1 and t not in ("
    + ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    + ")) t from pasaj where metin is not null), c as (select pasaj_no, len(t) dl, "
    + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) f{i}" for i, w in enumerate(sorted(_TERMS)))
    + " from p), s as (select count(*) n, avg(dl) a, "
    + ", ".join(f"count(*) filter (f{i} > 0) d{i}" for i in range(4))
    + " from c) select pasaj_no, round("
    + " + ".join(f"case when f{i} > 0 then ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.4 / (f{i} + 1.4 * (0.25 + 0.75 * dl / a)) else 0 end" for i in range(4))
    + ", 6) as skor from c, s where "
    + " + ".join(f"f{i}" for i in range(4))
    + " > 0"
)
def r_bm25(s, d):
    rows = table(s, d, "pasaj", "pasaj_no", "metin").where("metin is not null").dropDuplicates(["pasaj_no"])
    return V.bm25(rows, _TERMS, "pasaj_no", T.search_tokens(F.col("metin"))).select("pasaj_no", F.round("skor", 6).alias("skor"))


@query(
    "with p as (select distinct pasaj_no, url, metin, regexp_extract_all(lower(replace(metin, 'İ', 'i̇')), '[\\p{L}\\p{N}_]+') t from pasaj), c as (select pasaj_no, url, metin, len(t) dl, "
    + ", ".join(f"coalesce(len(list_filter(t, lambda x: x = '{w}')), 0) f{i}" for i, w in enumerate(sorted(["audit", "log", "archive"])))
    + " from p), s as (select count(*) n, avg(dl) a, count(*) filter (f0 > 0) d0, count(*) filter (f1 > 0) d1, count(*) filter (f2 > 0) d2 from c), k as (select c.*, "
    + " + ".join(f"case when f{i} > 0 then ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) else 0 end" for i in range(3))
    + " skor, (f0 > 0)::int + (f1 > 0)::int + (f2 > 0)::int terim from c, s), h as (select * from k where skor > 0 and terim = case when (select max(terim) from k) = 3 then 3 else terim end), "
    "g as (select h.*, v.host, v.baslik, v.alindi, row_number() over (partition by coalesce(v.kopya_grubu, h.url) order by skor desc, pasaj_no) r from h join (select distinct on (url) url, host, baslik, alindi, kopya_grubu from sayfa) v using (url)) "
    "select pasaj_no, url, host, baslik, round(skor, 6) as skor, substr(metin, cast(greatest(1, instr(lower(metin), 'audit') - 50) as int), 150) as ozet, 1767225600 - alindi > 30 * 86400 as eski from g where r = 1 order by skor desc, pasaj_no limit 10"
)
def r_vault_search(s, d):
    return V.search(table(s, d, "pasaj"), table(s, d, "sayfa"), "audit log archive", 10, AS_OF).withColumn("skor", F.round("skor", 6))


@query()
def r_reader(s, d):
    """What a reader asking for the audit log gets of each page."""
    pages = table(s, d, "onbellek", "kayit_no", "ok", "markdown").where("ok and trim(coalesce(markdown, '')) <> ''")
    return R.read_pages(pages, "kayit_no", 300, "audit log").select("kayit_no", "tam_jeton", "iz", "secilen", "pasaj", F.length("icerik").alias("uzunluk"))


@query("select distinct kayit_no, 'audit log' as ifade, contains(trim(regexp_replace(replace(lower(regexp_replace(nfc_normalize(markdown), '[`*_\"''“”‘’«»]', '', 'g')), chr(775), ''), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\p{Z}]+', ' ', 'g')), 'audit log') as bulundu from onbellek where markdown is not null")
def r_phrases(s, d):
    pages = table(s, d, "onbellek", "kayit_no", "markdown").where("markdown is not null").distinct()
    return R.find_phrases(pages, ["audit log"], "kayit_no").select("kayit_no", "ifade", "bulundu")


@query()
def r_budget(s, d):
    """Passages of each page chosen for 'audit log' within 300 tokens, in the page's order."""
    p = p_reader_passages(s, d).withColumn("id", F.concat_ws(":", "kayit_no", "pasaj"))
    ranked = V.bm25(p, ["audit", "log"], "id", P.search_text(F.col("baslik"), F.col("metin")), within=["kayit_no"]).join(p.select("id", "pasaj", "metin"), "id")
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("skor")).alias("s"), F.col("pasaj").alias("i"), T.token_estimate(F.col("metin")).alias("tokens")))), lambda x: F.struct(x["i"].alias("i"), x["tokens"].alias("tokens")))
    return ranked.groupBy("kayit_no").agg(V.budget_choice(order, 300).alias("pasajlar"))


# Aggregations.


@query(
    "with k as (select distinct slug, unnest(list_transform(range(len(olgular)), lambda i: {'no': i, 'o': olgular[i + 1]}), recursive := true) from plan_konu where olgular is not null), e as (select slug, no, ara from k where trim(ad) <> '' and trim(ara) <> ''), "
    "f as (select distinct slug, regexp_replace(regexp_replace(metin, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\([^()]*(?:birincil|ikincil)[^()]*\\)', ' ', 'g') t from bulgular), h as (select distinct slug, no from e join f using (slug) where regexp_matches(lower(t), lower(ara))), "
    "c as (select slug, cast(count(*) as int) toplam, cast(count(h.no) as int) kapsanan from e left join h using (slug, no) group by slug) select slug, toplam, kapsanan, cast(floor(100.0 * kapsanan / toplam) as int) as yuzde, kapsanan / toplam >= 0.6 as yeterli from c"
)
def a_fact_coverage(s, d):
    k = C.facts(table(s, d, "plan_konu"))
    return C.fact_coverage(k, C.fact_hits(k, _findings(s, d)))


@query(
    "with k as (select distinct slug, unnest(list_transform(range(len(olgular)), lambda i: {'no': i, 'o': olgular[i + 1]}), recursive := true) from plan_konu where olgular is not null), e as (select slug, no, trim(ad) ad, ara from k where trim(ad) <> '' and trim(ara) <> ''), "
    "f as (select distinct slug, regexp_replace(regexp_replace(metin, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\([^()]*(?:birincil|ikincil)[^()]*\\)', ' ', 'g') t from bulgular), h as (select distinct slug, no from e join f using (slug) where regexp_matches(lower(t), lower(ara))), "
    "m as (select *, least(row_number() over (partition by slug order by no), 3) soru from e where (slug, no) not in (select (slug, no) from h)) select slug, cast(soru as int) as soru, string_agg(ad, '; ' order by no) as olgular from m group by all"
)
def a_follow_up(s, d):
    k = C.facts(table(s, d, "plan_konu"))
    return C.follow_up(k, C.fact_hits(k, _findings(s, d)))


@query(
    "with f as (select distinct run_id, dosya, sira, urls from bulgular), u as (select run_id, dosya, sira, unnest(case when len(urls) > 0 then urls else [null] end) url from f), h as (select *, case when url is not null then regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') end h from u) "
    "select run_id, dosya, count(distinct sira) as bulgu, count(distinct case when url is null then sira end) as kaynaksiz, count(distinct url) as adres, count(distinct h) as alan_adi, count(distinct regexp_replace(url, '#.*$', '')) as belge, count(distinct sira) >= 3 and count(distinct h) = 1 as tek_kaynak from h group by all"
)
def a_note_audit(s, d):
    return N.audit(_findings(s, d), ["run_id", "dosya"])


@query(
    f"with f as (select distinct run_id, slug, dosya, sira, metin, urls from bulgular where len(urls) > 0 and regexp_matches(metin, '\\d')), p as (select run_id, dosya, sira, case when regexp_matches(metin, '%|\\$|€|£|₺|\\bTL\\b|\\bUSD\\b|\\bEUR\\b|\\bv?\\d+\\.\\d+(\\.\\d+)?\\b|\\b\\d{{2,}}\\b') then 3 else 0 end + case when len(urls) = 1 then 2 else 0 end + case when list_max(list_transform(urls, lambda u: {_TRUST.replace('{u}', 'u')})) < 55 then 2 else 0 end "
    "+ case when contains(lower(metin), 'ikincil') then 1 else 0 end as puan from f) select run_id, dosya, sira, puan from p order by puan desc, run_id, dosya, sira limit 8"
)
def a_candidates(s, d):
    rows = _findings(s, d).withColumn("puan", N.candidate_score(F.col("iddia"), F.col("urls"))).where("puan is not null")
    return rows.orderBy(F.desc("puan"), "run_id", "dosya", "sira").limit(8).select("run_id", "dosya", "sira", "puan")


@query("select run_id, dosya, len(list_filter(regexp_split_to_array(metin, '\\s+'), lambda x: x <> '')) as sozcuk, len(list_filter(string_split(metin, chr(10)), lambda l: starts_with(l, '#'))) as baslik, len(list_filter(string_split(metin, chr(10)), lambda l: starts_with(l, '|') and not regexp_matches(l, '^\\|[\\s:|-]+$'))) as tablo_satiri, len(list_distinct(regexp_extract_all(metin, 'https?://[^\\s)<>\\]]+'))) as adres from notlar")
def a_report_metrics(s, d):
    return S.report_metrics(_notes(s, d), ["run_id", "dosya"])


@query(
    _VERDICTS + f", g as (select *, array_to_string(q, ' ') a, regexp_replace(metin, '\\[[^\\]]*\\]\\([^)]*\\)', '', 'g') own from k) select run_id, slug, dosya, sira, list_sort(list_distinct(regexp_extract_all({_PLAIN.replace('{t}', 'case when length(a) > 0 then a else own end')}, '[\\p{{L}}\\p{{N}}_]{{3,}}'))) as kelimeler, "
    "list_sort(list_distinct(list_transform(urls, lambda u: regexp_replace(regexp_replace(regexp_replace(u, '#.*$', ''), '/+$', ''), '://www\\.', '://')))) as anahtarlar, n as sayilar, length(a) > 0 as alintili from g"
)
def c_claim_features(s, d):
    f = C.claim_features(_findings(s, d), [*KEY, "sira"])
    return f.select(*KEY, "sira", F.array_sort("kelimeler").alias("kelimeler"), F.array_sort("anahtarlar").alias("anahtarlar"), "sayilar", "alintili")


@query()
def c_same_claims(s, d):
    f = C.claim_features(_findings(s, d), [*KEY, "sira"])
    return C.same_claim_pairs(f, [*KEY, "sira"]).select(F.col("a_slug").alias("slug"), "a_run_id", "a_dosya", "a_sira", "b_run_id", "b_dosya", "b_sira")


def _clusters(s: SparkSession, d: str):
    f = cut(C.claim_features(_findings(s, d), ["slug", "run_id", "dosya", "sira"]))
    return cut(C.clusters(f)), f


@query()
def c_clusters(s, d):
    return C.cluster_statistics(_clusters(s, d)[0])


@query()
def c_representatives(s, d):
    return C.representatives(*_clusters(s, d))


@query()
def c_conflicts(s, d):
    return C.conflicts(*_clusters(s, d))


@query()
def c_nli_pairs(s, d):
    v = _verdicts(s, d).join(_findings(s, d).select(*KEY, "sira", "iddia"), [*KEY, "sira"])
    return C.nli_pairs(v, _pages(s, d, _cited(_findings(s, d))))


# Time.


@query("select url, alindi is not null and 1767225600 - alindi > 30 * 86400 as eski from (select distinct url, alindi from sayfa)")
def w_stale_pages(s, d):
    p = table(s, d, "sayfa", "url", "alindi").distinct()
    return p.select("url", F.coalesce(F.lit(AS_OF) - F.col("alindi") > V.STALE_DAYS * 86400, F.lit(False)).alias("eski"))


@query("select kayit_no, substr(sha1('v7|' || istenen_url || '|md'), 1, 24) as anahtar, coalesce(1767225600 - fetched_at < 21600, false) as taze from (select distinct kayit_no, istenen_url, fetched_at from onbellek)")
def w_cache(s, d):
    p = table(s, d, "onbellek", "kayit_no", "istenen_url", "fetched_at").distinct()
    return p.select("kayit_no", P.cache_key(F.col("istenen_url")).alias("anahtar"), P.cache_fresh(F.col("fetched_at"), AS_OF).alias("taze"))


@query("with o as (select distinct kayit_no, host, fetched_at t from onbellek where host is not null and fetched_at is not null), i as (select *, row_number() over (partition by host order by t, kayit_no) i from o) select kayit_no, round(max(t - i * 0.5) over (partition by host order by i) + i * 0.5, 3) as slot from i")
def w_host_slots(s, d):
    p = table(s, d, "onbellek").select("kayit_no", "host", F.col("fetched_at").alias("t")).where("host is not null and t is not null").distinct()
    return V.host_slots(p).select("kayit_no", F.round("slot", 3).alias("slot"))


@query("with w as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id) adim from events) select user_id, cast(adim as bigint) as adim, count(*) as olay, round(sum(value), 2) as deger from w group by 1, 2")
def l_event_steps(s, d):
    return L.step_metrics(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
