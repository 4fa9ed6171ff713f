"""Text normalisation and evidence extraction as column expressions.

Everything stays in the JVM except what Catalyst cannot express: named character
references and composed form, which go through Arrow only for rows that need them.
Offsets and lengths are code points of the normalised text. Null in gives null out.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import lazy_udf

# Word characters and white space as the claims' tooling reads them; legal in Java and RE2.
W, NOT_W, S = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]", r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]"

# Link, tag, mark and number patterns that decide what counts as evidence.
LINK = r"\[([^\]]*)\]\((?:[^()]|\([^()]*\))*\)"
INLINE_TAG = r"(?i)</?(?:u|b|i|em|strong|span|sup|sub|small|mark|abbr|kbd|a|font|s|del|ins|wbr)(?:\s[^<>\n]{0,200})?/?>"
CITATION = r"(?i)\([^()]*\b(?:birincil|ikincil)\b[^()]*\)"
PREFIX = r"^\s*(?:⚠ \[(?:Kısmen|Anlam zayıf):[^\]]*\]\s*)+"
EDITORIAL = r"\[(?=[^\]]*\s)[^\]]*\]|\[[A-Za-z]{3,}\]"
NUMBER = (
    r"(?i)\d{4}-\d{2}-\d{2}|v?\d+(?:[.,]\d+)+(?:-[\p{L}\p{N}_.]+)?|\d+(?:[.,]\d+)?\s?[-–]\s?\d+(?:[.,]\d+)?\s?[x×%]?|%\s?\d+(?:[.,]\d+)?|[$€₺]\s?\d[\d.,]*"
    r"|\d+(?:[.,]\d+)?\s?(?:x|×|%|ms|saniye|sn|MB|GB|KB|kat|TL|USD|EUR)(?![\p{L}\p{N}_])|\d{1,3}(?:[.,]\d{3})+(?![\d])|\d{4,}"
)
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
CJK_MARKS, CJK_MARKS_AS = "。、　「」『』《》〈〉【】〔〕", '., """"""""[]()'
GENERIC_YEARS = ("2024", "2025", "2026", "2027")
QUOTE_MIN, QUOTE_MAX, QUOTE_CAP, CODE_CAP, NUMBER_CAP, PART_MIN = 12, 320, 3, 4, 5, 8
# Words that carry no search (English, then Turkish).
STOP_WORDS = (
    "a an the and or of to in on for with is are was were be been it its this that these those as at by from not no but if then than so do does did can could should would will just "
    "also into over under about how what when where which who whom why ve veya ile bir bu şu o da de mi mı mu mü için gibi daha çok en ne nasıl neden hangi ama fakat ya ki ise olarak olan"
).split()


@lazy_udf("string")
def _unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: None if t is None else html.unescape(t))


@lazy_udf("string")
def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def unescape(col: Column) -> Column:
    """Character references decoded (T01); rows without any stay in the JVM."""
    return F.coalesce(_unescape(F.when(col.rlike(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), col)), col)


def norm(col: Column, entities: bool = True) -> Column:
    """The form in which claims and pages are compared."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    c = unescape(col) if entities else col
    for pattern, to in ((INLINE_TAG, ""), (LINK, "$1")):
        c = F.regexp_replace(c, pattern, to)
    c = F.translate(F.lower(c), "–—×\xa0̇", "--x ")
    c = F.translate(c, wide + CJK_MARKS, "".join(chr(ord(x) - 0xFEE0) for x in wide) + CJK_MARKS_AS)
    for pattern, to in (
        (r"\+\s+(?=\d)", "+"), (r"(?<=\d)\s+x(?![a-z0-9])", "x"), (r"\[(`[^`]*`)\]", "$1"), (r"\|", " "), ("[`*_\"'“”‘’«»]", ""),
        (rf"(?<=[{CJK}]){S}+|{S}+(?=[{CJK}])", ""), (S + "+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def page_variants(col: Column, entities: bool = True) -> Column:
    """A page's text, with words divided at line ends also joined and hyphenated."""
    broken = r"-[ \t]*\r?\n[ \t]*"
    three = F.concat_ws("\n", norm(col, entities), norm(F.regexp_replace(col, broken, ""), entities), norm(F.regexp_replace(col, broken, "-"), entities))
    return F.when(col.rlike(broken + W), three).otherwise(norm(col, entities))


def copy_norm(col: Column) -> Column:
    """The form in which pages are compared for copies: no addresses, which any white space ends, and no marks."""
    c = F.regexp_replace(F.lower(col), rf"(?:https?://|www\.)[^{S[1:]}+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")
    return F.trim(F.regexp_replace(c, r" +", " "))


def phrase_norm(col: Column) -> Column:
    """The form in which a reader's phrase is looked up."""
    c = F.regexp_replace(_nfc(col), "[`*_\"'“”‘’«»]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "̇", ""), S + "+", " "))


def _kept(found: Column, lo: int, hi: int) -> Column:
    return F.filter(F.transform(found, lambda q: F.trim(q)), lambda q: F.length(q).between(lo, hi))


def quotes(col: Column) -> Column:
    """Quotations of a finding: straight pairs, or else curly ones; pairs are matched before short ones are dropped."""
    raw = F.regexp_replace(F.regexp_replace(col, r'\\"', "'"), PREFIX, "")
    straight = _kept(F.regexp_extract_all(raw, F.lit(r'"([^"]*)"'), 1), QUOTE_MIN, QUOTE_MAX)
    curly = _kept(F.regexp_extract_all(raw, F.lit(r"[“«]([^“”«»]*)[”»]"), 1), QUOTE_MIN, QUOTE_MAX)
    return F.when(F.size(straight) > 0, straight).otherwise(curly)


def codes(col: Column) -> Column:
    """Code spans of a finding that are not part of a quotation."""
    raw = F.regexp_replace(F.regexp_replace(col, r'\\"', "'"), PREFIX, "")
    found = F.transform(F.regexp_extract_all(raw, F.lit(r"`([^`\n]{3,80})`"), 1), lambda c: F.trim(c))
    return F.filter(found, lambda c: ~F.exists(quotes(col), lambda q: F.contains(q, c)))


def numbers(col: Column) -> Column:
    """Numbers of a finding outside links, addresses, quotations, code and citation tags."""
    raw = F.regexp_replace(F.regexp_replace(col, r'\\"', "'"), PREFIX, "")
    for pattern in (LINK, r"https?://\S+", r"`[^`\n]{3,80}`", r'"[^"]*"|[“«][^”»]*[”»]', CITATION):
        raw = F.regexp_replace(raw, pattern, " ")
    found = F.transform(F.regexp_extract_all(raw, F.lit(NUMBER), 0), lambda t: F.regexp_replace(F.regexp_replace(norm(t, False), r"^v(?=\d)", ""), " ", ""))
    return F.array_distinct(F.filter(found, lambda t: (t != "") & ~t.isin(*GENERIC_YEARS) & ~t.rlike(r"^(?:19|20)\d{2}-(?:\d{1,2}|(?:19|20)\d{2})$")))


def evidence(col: Column) -> Column:
    """Quotations, codes and numbers within their caps, and how many are over."""
    q, c, n = quotes(col), codes(col), numbers(col)
    over = lambda a, cap: F.greatest(F.lit(0), F.size(a) - cap)
    return F.struct(
        F.slice(q, 1, QUOTE_CAP).alias("quotes"), F.slice(c, 1, CODE_CAP).alias("codes"), F.slice(n, 1, NUMBER_CAP).alias("numbers"),
        F.struct(over(q, QUOTE_CAP).alias("quotes"), over(c, CODE_CAP).alias("codes"), over(n, NUMBER_CAP).alias("numbers")).alias("skipped"),
    )


def number_variants(col: Column) -> Column:
    """Spellings of one number: decimal and thousands marks, per cent."""
    percent = col.startswith("%")
    core = F.when(percent, F.substring(col, 2, 400)).otherwise(col)
    digits = F.regexp_replace(core, "[.,]", "")
    grouped = lambda mark: F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+$)", mark)
    cores = F.array_compact(
        F.array(
            core,
            F.when(core.rlike(r"^\d+,\d{1,2}$"), F.regexp_replace(core, ",", ".")),
            F.when(core.rlike(r"^\d+\.\d{1,2}$"), F.regexp_replace(core, r"\.", ",")),
            *(F.when(core.rlike(r"^\d{1,3}(?:[.,]\d{3})+$"), x) for x in (digits, grouped(","), grouped("."))),
        )
    )
    marked = F.flatten(F.transform(cores, lambda c: F.array(c, F.concat(c, F.lit("%")), F.concat(c, F.lit(" %")), F.concat(c, F.lit(" percent")), F.concat(c, F.lit(" per cent")))))
    return F.array_distinct(F.concat(F.array(col), F.when(percent, marked).otherwise(cores)))


def _literal(text: Column, between: str) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda ch: F.concat(F.lit("\\Q"), ch, F.lit("\\E"))), between)


def number_pattern(token: Column) -> Column:
    """A pattern that finds any spelling of a number with nothing of a longer one next to it."""
    one = lambda v: F.concat(F.when(v.rlike(r"^\d+\.\d"), F.lit("v?")).otherwise(F.lit("")), _literal(v, r"\s?"))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_.,-])(?:"), F.array_join(F.transform(number_variants(token), one), "|"), F.lit(r")(?![\p{L}\p{N}_])(?![.,]\p{Nd})"))


def first_digits(token: Column) -> Column:
    """The first run of digits of a number, which every spelling of it holds."""
    return F.regexp_extract(token, r"\d+", 0)


def starts_of(text: Column, pattern: Column) -> Column:
    """Code point offsets of the matches of ``pattern``, from the parts between them."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    pairs = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("p"), F.length(h).alias("h")))
    return F.aggregate(pairs, zero, lambda s, x: F.struct((s["at"] + x["p"] + x["h"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["p"])).alias("out")))["out"]


def quote_parts(quote: Column) -> Column:
    """The stretches of a quotation between ellipses and editorial insertions, normalised; those too short to tell are left out unless nothing else is left."""
    parts = F.transform(F.split(F.regexp_replace(quote, LINK, "$1"), r"\.{3,}|…|" + EDITORIAL), lambda x: norm(x, False))
    long = F.filter(parts, lambda x: F.length(x) >= PART_MIN)
    return F.when(F.size(long) > 0, long).otherwise(F.array(norm(quote, False)))


def holds_parts(page: Column, flat: Column, parts: Column) -> Column:
    """Whether all parts stand on a page, or without hyphens on the page without them."""
    return F.forall(parts, lambda p: (p != "") & (F.contains(page, p) | F.contains(flat, F.replace(p, F.lit("-"), F.lit("")))))


def has_quote(page: Column, quote: Column) -> Column:
    """Whether all parts of a quotation stand on a normalised page, hyphens apart."""
    return holds_parts(page, F.replace(page, F.lit("-"), F.lit("")), quote_parts(quote))


def code_pattern(code: Column) -> Column:
    """A pattern for a code span with no longer name around it; one that nothing matches for an empty span."""
    c = norm(code, False)
    return F.when(c == "", r"(?!)").otherwise(F.concat(F.lit(r"(?<![\p{L}\p{N}_-])\Q"), c, F.lit(r"\E(?![\p{L}\p{N}_-])")))


def has_code(page: Column, code: Column) -> Column:
    return F.contains(page, norm(code, False)) & F.regexp(page, code_pattern(code))


def has_number(page: Column, number: Column) -> Column:
    return F.contains(page, first_digits(norm(number, False))) & F.regexp(page, number_pattern(norm(number, False)))


def quote_start(page: Column, quote: Column) -> Column:
    """Where the longest part of a quotation begins on a page, from 0; -1 if nowhere."""
    longest = F.try_element_at(F.array_sort(quote_parts(quote), lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    return F.instr(page, longest) - 1


def claim_prose(col: Column) -> Column:
    """A finding's own words."""
    for pattern in (LINK, r"https?://\S+", CITATION, r"`[^`\n]{3,80}`", r'"[^"]*"|[“«][^”»]*[”»]'):
        col = F.regexp_replace(col, pattern, " ")
    return col


def fact_text(col: Column) -> Column:
    """A finding as facts are searched in it: texts of links, no addresses, no citation tags."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, LINK, "$1"), r"https?://\S+", " "), CITATION, " ")


def hypothesis_text(col: Column) -> Column:
    """A finding as a bare sentence."""
    for pattern in (r"^\s*(?:[-*]|\d+[.)])\s+", PREFIX, r"\[[^\]]*\]\([^)]*\)", r'"[^"]*"|[“«][^”»]*[”»]', CITATION):
        col = F.regexp_replace(col, pattern, " ")
    return F.regexp_replace(F.regexp_replace(col, S + "+", " "), r"^[ \-—–:;,.]+|[ \-—–:;,]+$", "")


def rare_numbers(col: Column) -> Column:
    """Numbers of two digits or more and percentages, without dates, document ids and years."""
    c = F.regexp_replace(col, r"\b\d{4}-\d{2}(?:-\d{2})?\b", " ")
    c = F.regexp_replace(c, r"(?i)\b(?:PEP|RFC|FIPS|CVE|CWE|CAPEC|ISO|IEC|SP|BCP)[\s\-]*\d[\d.\-]*", " ")
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_.])\d{2,}(?:[.,]\d+)?%?|%\d+(?:[.,]\d+)?"), 0)
    return F.array_distinct(F.filter(found, lambda t: ~t.rlike(r"^20[12]\d$")))


def citation_tag(col: Column) -> Column:
    """Year, month and kind of the last citation tag; null where there is none."""
    group = F.try_element_at(F.regexp_extract_all(col, F.lit(CITATION), 0), F.lit(-1))
    dates = F.transform(F.regexp_extract_all(group, F.lit(r"\d{4}-(?:0[1-9]|1[0-2])"), 0), lambda d: F.struct(F.substring(d, 1, 4).cast("int").alias("year"), F.substring(d, 6, 2).cast("int").alias("month")))
    last = F.array_max(dates)
    kind = F.when(F.lower(group).contains("birincil"), "primary").otherwise("secondary")
    return F.when(group.isNotNull(), F.struct(last["year"].alias("year"), last["month"].alias("month"), kind.alias("kind")))


def age_months(tag: Column, year: int, month: int) -> Column:
    return (F.lit(year) - tag["year"]) * 12 + (F.lit(month) - tag["month"])


def search_tokens(col: Column) -> Column:
    """Tokens a search is made of, with repeats."""
    found = F.regexp_extract_all(F.lower(col), F.lit(rf"{W}[\p{{L}}\p{{N}}_.\-+%/]*"), 0)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def word_set(col: Column) -> Column:
    """Distinct words of three characters or more of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(W + "{3,}"), 0))


def token_estimate(col: Column) -> Column:
    """A rough number of tokens."""
    return F.greatest(F.lit(1), F.floor(F.length(col) / 4).cast("int"))


def snippet(text: Column, word: Column, size: int = 150) -> Column:
    """``size`` characters around the first ``word``."""
    at = F.instr(F.lower(text), F.lower(word))
    return F.substring(text, F.greatest(F.lit(1), at - size // 3), F.lit(size))


def error_summary(col: Column) -> Column:
    """The last three lines with something to read, within 200 characters."""
    lines = F.filter(F.split(col, r"\r\n|[\n\r]"), lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 3)
    return F.substring(F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 2), 3), " | "), 1, 200)


def mask_secrets(col: Column) -> Column:
    """Keys, bearer tokens and assigned secrets replaced."""
    for pattern, to in (
        (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]{20,}", "$1 ***"), (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", "***"),
        (r"\b(?:sk|pk|rk|gh[pousr]|xox[abpr])[-_][A-Za-z0-9_-]{16,}", "***"), (r"\bAKIA[0-9A-Z]{16}\b", "***"),
        (r"(?i)\b((?:[a-z0-9]+[_-])*(?:api[_-]?key|access[_-]?token|auth[_-]?token|secret[_-]?key|client[_-]?secret|password)\s*[=:]\s*)[^\s\"']{6,}", "$1***"),
    ):
        col = F.regexp_replace(col, pattern, to)
    return col


# Phrases that address a model.
INJECTION = (
    r"(?i)ignore (?:all |the )?(?:previous|prior|above) (?:instructions|prompts)|disregard (?:the )?(?:previous|above)|you are now|system prompt"
    r"|önceki (?:tüm )?talimatları (?:yok say|unut)|reveal your (?:system )?prompt|do not tell the user|new instructions:"
)


def injection_count(col: Column) -> Column:
    """How often a text speaks to a model instead of a reader."""
    return F.regexp_count(col, F.lit(INJECTION))
