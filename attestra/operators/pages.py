"""Pages: HTML to blocks and Markdown, reader passages, outline, ranking within a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import lazy_udf

PASSAGE_WORDS, MAIN_LEAST, LINK_SHARE, REPEAT, THIN = 110, 400, 0.6, 120, 200
# Elements without text for readers, and names of what surrounds a page.
SILENT = frozenset("script style noscript svg iframe canvas button select template annotation annotation-xml".split())
AROUND = frozenset("nav footer aside header".split())
BLOCK = frozenset("h1 h2 h3 h4 h5 h6 p div section li tr blockquote dd dt figcaption details summary ul ol table pre main article body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OWN_KIND = HEADINGS | {"li", "pre", "tr"}
KEPT = frozenset("html body main article".split())
VOID = frozenset("br hr img meta link input source wbr area base col embed param track".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:nav|navbar|menu|footer|header|sidebar|side-bar|aside|cookie|consent|banner|advert|ads?|promo|share|social|breadcrumb|related|recommend|newsletter|subscribe|popup|modal|comment|toc|skip)(?:[\s_-]|$)", re.I)


class Element:
    """A node of a page's tree; children are elements or runs of text."""

    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str | None] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


class _Tree(HTMLParser):
    """Builds the tree. End tags close the nearest open element of their name, and all within it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#page")
        self.path = [self.root]
        self.title: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        made = Element(tag, dict(attrs))
        self.path[-1].children.append(made)
        if tag not in VOID:
            self.path.append(made)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].name == tag:
                del self.path[depth:]
                return

    def handle_data(self, data: str) -> None:
        at = self.path[-1]
        if at.name == "title":
            self.title.append(data)
        elif at.name == "script" and at.attributes.get("type") == "text/template" and len(self.path) > 1 and self.path[-2].attributes.get("itemprop") == "articleBody":
            # A page builder that ships its article as a template: it is read as one.
            inner = parse(data)
            article = Element("article")
            article.children = inner.root.children
            self.path[-2].children.append(article)
        else:
            at.children.append(data)


def parse(page: str) -> _Tree:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree


class Block(NamedTuple):
    """A stretch of text between block elements: its kind, how many of its characters are links, and whether it stands in the main part."""

    kind: str
    text: str
    links: int
    main: bool


def _unseen(e: Element, main: bool, hints: bool) -> bool:
    """Whether readers do not see an element, or it only surrounds the content."""
    style = re.sub(r"\s", "", e.attributes.get("style") or "").lower()
    if e.name in SILENT or "hidden" in e.attributes or e.attributes.get("aria-hidden") == "true" or "display:none" in style:
        return True
    if e.name in AROUND:
        return not main
    named = [e.attributes.get(k) for k in ("class", "id", "role")]
    return hints and e.name not in KEPT and any(NOISE.search(n) for n in named if n)


def blocks(root: Element, hints: bool) -> list[Block]:
    """The visible blocks of a tree in order. Walks with its own stack, so depth does not matter."""
    out: list[Block] = []
    text: list[str] = []
    links = 0
    kind = "p"

    def close(main: bool) -> None:
        nonlocal links
        raw = "".join(text)
        made = raw.strip("\n") if kind == "pre" else " ".join(raw.split())
        if made.strip():
            out.append(Block(kind, made, links, main))
        text.clear()
        links = 0

    # (element or text, in the main part, in a link, in pre, whether it is left)
    todo: list[tuple] = [(root, False, False, False, False)]
    while todo:
        node, main, link, pre, leaving = todo.pop()
        if isinstance(node, str):
            text.append(node)
            links += len(node.strip()) if link else 0
            continue
        name = node.name
        if leaving:
            if name in BLOCK:
                close(main)
                kind = "p"
            continue
        if name == "br":
            text.append("\n" if pre else " ")
        if name in VOID or _unseen(node, main, hints):
            continue
        if name in BLOCK:
            close(main)
            kind = name if name in OWN_KIND else "p"
        elif name in ("td", "th") and text:
            text.append(" | ")
        inside = (main or name in ("main", "article"), link or name == "a", pre or name == "pre")
        todo.append((node, *inside, True))
        todo += [(c, *inside, False) for c in reversed(node.children)]
    close(False)
    return out


def _long(found: list[Block]) -> int:
    return sum(len(b.text) for b in found)


def content(found: list[Block]) -> list[Block]:
    """The blocks that are content: of the main part if that is long enough, without menus and short repetitions."""
    if _long([b for b in found if b.main]) >= MAIN_LEAST:
        found = [b for b in found if b.main or b.kind in HEADINGS]
    announced = [False] * len(found)  # items of a list that a long sentence with a colon announces
    for i, b in enumerate(found[1:], 1):
        before = found[i - 1]
        if b.kind == "li":
            announced[i] = announced[i - 1] if before.kind == "li" else len(before.text) >= 70 and before.text.rstrip("¶").endswith(":")
    out: list[Block] = []
    short: set[str] = set()
    for b, listed in zip(found, announced):
        menu = b.kind not in HEADINGS and b.kind != "pre" and len(b.text) < 600 and b.links > LINK_SHARE * len(b.text)
        if menu and not listed and not (b.main and len(b.text) >= 40):
            continue
        if len(b.text) < REPEAT:
            if b.text in short:
                continue
            short.add(b.text)
        out.append(b)
    return out


def extract(page: str) -> tuple[str, list[Block]]:
    """Title and content blocks of a page (P09). Names that mean noise are heeded unless that leaves little and half of the text goes."""
    tree = parse(page)
    strict = content(blocks(tree.root, True))
    if _long(strict) < MAIN_LEAST:
        loose = content(blocks(tree.root, False))
        strict = loose if _long(loose) > 2 * _long(strict) else strict
    return "".join(tree.title).strip(), strict


_MARKDOWN = {"li": "- {}", "pre": "```\n{}\n```"} | {h: "#" * int(h[1]) + " {}" for h in sorted(HEADINGS)}


def to_markdown(found: list[Block]) -> str:
    """Blocks as Markdown (P10)."""
    return "\n\n".join(_MARKDOWN.get(b.kind, "{}").format(b.text) for b in found)


@lazy_udf("struct<baslik:string,markdown:string,ok:boolean>")
def page_markdown(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title, Markdown, and whether there is enough of it."""
    for s in parts:
        rows = []
        for t in s:
            if t is None:
                rows.append((None, None, None))
                continue
            title, blocks = extract(t)
            md = to_markdown(blocks)
            rows.append((title, md, len(md) >= THIN))
        yield pd.DataFrame(rows, columns=["baslik", "markdown", "ok"])


def _packed(units: list[str], target: int, glue: str) -> Iterator[str]:
    """Units joined in order as long as a run stays within ``target`` words."""
    run: list[str] = []
    size = 0
    for u in units:
        n = len(u.split())
        if run and size and size + n > target:
            yield glue.join(run)
            run, size = [], 0
        run.append(u)
        size += n
    if run:
        yield glue.join(run)


def _split_long(paragraph: str, target: int) -> list[str]:
    """A paragraph above twice the target as runs of sentences, sentences above it as runs of words."""
    if paragraph.startswith("```") or len(paragraph.split()) <= 2 * target:
        return [paragraph]
    out: list[str] = []
    run: list[str] = []
    for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
        words = sentence.split()
        if len(words) <= 2 * target:
            run.append(" ".join(words))
            continue
        out += [*_packed(run, target, " "), *(" ".join(words[i : i + target]) for i in range(0, len(words), target))]
        run = []
    return [x for x in [*out, *_packed(run, target, " ")] if x]


def reader_passages(markdown: str, target: int = PASSAGE_WORDS) -> list[tuple[str, str]]:
    """(heading, text) of a page in passages of about ``target`` words (P11); a passage never goes past a heading."""
    parts: list[tuple[str, list[str]]] = [("", [])]
    for paragraph in markdown.split("\n\n"):
        if paragraph.startswith("#"):
            parts.append((paragraph.lstrip("# ").strip(), []))
        else:
            parts[-1][1].extend(_split_long(paragraph, target))
    return [(heading, text.strip()) for heading, units in parts for text in _packed(units, target, "\n") if text.strip()]


@lazy_udf("array<struct<baslik:string,metin:string>>")
def passages_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: None if t is None else [{"baslik": h, "metin": m} for h, m in reader_passages(t)])


def with_passages(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """One row for each reader passage: the page's columns without ``text``, ``pasaj`` from 0, ``baslik``, ``metin``."""
    rest = [c for c in pages.columns if c not in (text, "pasaj", "baslik", "metin")]
    return pages.select(*rest, F.posexplode(passages_of(F.col(text))).alias("pasaj", "p")).select(*rest, "pasaj", "p.baslik", "p.metin")


def outline(markdown: Column, most: int = 60) -> Column:
    """Heading lines."""
    return F.slice(F.filter(F.split(markdown, "\n"), lambda l: l.startswith("#")), 1, most)


def thin_page(markdown: Column, raw_bytes: Column) -> Column:
    """Whether a page came with much markup and little text."""
    return (F.length(markdown) < 800) & (raw_bytes > 20_000)


def cache_key(url: Column, mode: str = "md", version: str = "v7") -> Column:
    """The name of a page in the cache."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit(version), url, F.lit(mode))), 1, 24)


def cache_fresh(fetched_at: Column, as_of: float, ttl: float = 6 * 3600) -> Column:
    """Whether a cached page is younger than its time to live at ``as_of``."""
    return F.coalesce(F.lit(as_of) - fetched_at < ttl, F.lit(False))


def search_text(heading: Column, text: Column) -> Column:
    return T.search_tokens(F.concat_ws(" ", heading, text))
