"""Clean text from Markdown that still carries other markup (problem 1).

Consensus over the records of a host, in two passes over those that hold any sign of
foreign markup:

1. Each container of a record is scored: HTML elements that group, by the generalised
   path of their tag names and classes (digits dropped), wiki templates and LaTeX
   environments by their name. A score is the running text of a container less what is
   links, parameters or commands. In Spark every record of a host votes for or against
   each path by the sum of its scores; a path on which ``VOTERS`` records at least have
   voted wins or loses by the majority.
2. Records are extracted again by the paths of their host: containers on losing paths are
   left out, the values of templates on winning paths are kept as text, scripts and
   styles always go, all else is turned into Markdown: headings, lists, tables, the texts
   of links, code, formulas. Lists and tables are content and are not voted on.

The kinds of foreign markup are those of which the extraction has used something up.

Everything in fenced or inline code, formulas between dollar signs, autolinks,
bracketed link texts, unfilled placeholders and bare angle signs are left as they are.

Defined results: null markdown gives null text and no kinds; empty and blank give
empty text; identical rows give one row and one vote; a fence that is never closed runs
to the end; markup that is cut off is removed to where it was cut off; a container that
is never closed is kept; a record that is nothing but lost containers is kept. Nesting
of any depth is followed, and rules are repeated until nothing changes.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table

# Element names of the HTML standard, with those it retired.
ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del "
    "details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label "
    "legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search "
    "section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_NAMES = "(?:" + "|".join(sorted(ELEMENTS.split(), key=len, reverse=True)) + ")"
CHROME = ("nav", "footer", "aside", "form", "noscript", "iframe", "template")
#: What the vote decides on: chrome and what only groups. Lists and tables are content.
CONTAINERS = (*CHROME, "div", "section", "header", "article", "main", "details", "fieldset", "center")
_RAW = ("script", "style")
#: Records of a host that must vote on a path before it wins or loses.
VOTERS = 2
#: What a character of a link weighs against one of running text.
LINK_WEIGHT = 5 / 3
#: Rows of paths up to which the votes are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
# Environments whose content has a form of its own in Markdown.
FORMED = frozenset("itemize enumerate description tabular table equation align displaymath gather multline verbatim lstlisting quote quotation abstract document center figure".split())

#: What a record must show before it is looked at closely; anything else is Markdown only.
SIGN = r"<\s*[/!A-Za-z]|&(?:#\d|#[xX]|[A-Za-z])|\[\[|''|\{\{|(?m)^\{\||^\|\}|^=={1,5}[^=\n]|^----|^;|\[https?://|\\[A-Za-z]"

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??(?: {0,3}\1[`~]*[ \t]*$|\Z)|^ {0,3}(?:`{3,}|~{3,})[^\n]*\Z", re.M | re.S)
_TICKS = re.compile(r"(?<!`)(`+)(?!`)((?:[^`\n]|\n(?!\s*\n)|(?!\1(?!`))`+)*?[^`])\1(?!`)")
_MATH = re.compile(r"\$\$.+?\$\$|(?<![\\$\w])\$(?![\s{$])(?:[^$\n\\]|\\.)*?(?<!\s)\$(?!\w)", re.S)
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[\w.+-]+@[\w.-]+>")
_URL = re.compile(r"https?://[^\s<>()\[\]\"']+")
_PLACEHOLDER = re.compile(r"\{\{\s*[\w.$-]+(?:\s*\|\s*[a-z_]+(?:\([^(){}]*\))?)*\s*\}\}|\{%[^{}\n]*%\}|[$#]\{[^{}\n]*\}")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!(?:DOCTYPE|\[CDATA\[)[^>]*>?|<\?(?:xml|php)[^>]*>?", re.S | re.I)
_TAG = re.compile(r"<\s*/?\s*" + _NAMES + r"\s*/?\s*>|</?" + _NAMES + r"(?:\s[^<>]*|/)?>", re.I)
_ATTR = r"\s+[A-Za-z][\w-]*\s*=\s*"
_CUT_TAG = re.compile(r"<" + _NAMES + r"(?:(?:" + _ATTR + r"(?:\"[^\"\n<]*\"?|'[^'\n<]*'?|[^\s<>\"']*))+[ \t]*(?=$|<)|(?=<))|</?" + _NAMES + r"\s*\Z|</" + _NAMES + r"(?=\s*$)", re.I | re.M)
_ENTITY = re.compile(r"&(?:amp;)*(?:#\d{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)|&(?:nbsp|amp|lt|gt|quot|copy|reg|mdash|ndash|hellip|laquo|raquo)(?![\w=;&])")

_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\](?![(\[])")
_OUTER = re.compile(r"(?<!\])\[(https?://[^\s\]]+)[ \t]+([^\]\n]+)\](?![(\[])")
_QUOTES = re.compile(r"(?<![A-Za-z0-9'=])('{2,5})(?!')([^'\n]+(?:'[^'\n]+)*)'{2,5}(?!')")
_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n](?:[^\n]*[^=\n])?)[ \t]*=={1,5}[ \t]*$", re.M)
_RULE = re.compile(r"^-{4,}[ \t]*$", re.M)
_TERM = re.compile(r"^;[ \t]*([^:\n]+?)[ \t]*:[ \t]+(.+)$", re.M)
_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)|^\|\}[ \t]*$", re.M | re.S)
_TEMPLATE = re.compile(r"\{\{\s*[^{}|\n]+?\s*\|[^{}]*(?:\}\}|\Z)|\{\{\s*[^{}|\n]+?\s*\n\s*\|[^{}]*?(?:\}\}|(?=\n\s*\n)|\Z)")

_TEX = re.compile(r"\\(?:begin|end)\s*\{[^{}\n]*\}?|\\[A-Za-z]+\*?(?:\s?\[[^\[\]\n]*\])?\{|(?<![\\\w:/.])\\(?:item|bf|it|em|rm|sc|tt|approx|S|P|ldots|dots|times|cdot|leq?|geq?|neq?|pm|infty|alpha|beta|gamma|delta|lambda|mu|pi|sigma|omega|sum|int|to|rightarrow|par|noindent|newline|quad|hline|centering|maketitle|LaTeX|TeX|textbackslash|linebreak|bigskip|medskip|smallskip)(?![A-Za-z])")


def _mask(text: str) -> tuple[str, list[str]]:
    """Code, formulas, autolinks and placeholders replaced by private characters, and what they were."""
    kept: list[str] = []

    def keep(m: re.Match[str]) -> str:
        kept.append(m.group())
        return f"\ue000{len(kept) - 1}\ue001"

    if "`" in text or "~~~" in text:
        text = _TICKS.sub(keep, _FENCE.sub(keep, text))
    if "$" in text:
        text = _PLACEHOLDER.sub(keep, text)
        text = _MATH.sub(keep, text)
    elif "{" in text:
        text = _PLACEHOLDER.sub(keep, text)
    if "<" in text:
        text = _AUTOLINK.sub(keep, text)
    return text, kept


def _unmask(text: str, kept: list[str]) -> str:
    while "\ue000" in text:
        text = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], text)
    return text


def _is_entity(s: str) -> bool:
    bare = re.sub(r"^&(?:amp;)*", "", s) or "amp;"
    if bare.startswith("#") or s == "&amp;" * (len(s) // 5):
        return True
    return not bare.endswith(";") or bare in html.entities.html5


def _count(rules: tuple[re.Pattern[str], ...], text: str) -> int:
    return sum(1 for r in rules for _ in r.finditer(text))


def _html_marks(text: str) -> int:
    found = _count((_TAG, _COMMENT, _CUT_TAG), text) if "<" in text else 0
    if "&" in text:
        plain = _URL.sub(" ", text)
        found += sum(_is_entity(m.group()) for m in _ENTITY.finditer(plain)) + ("&amp;" in plain)
    return found


def _wiki_marks(text: str) -> int:
    return _count((_LINK, _QUOTES, _HEADING, _TABLE, _TEMPLATE, _TERM, _OUTER, _RULE), text)


def _latex_marks(text: str) -> int:
    return _count((_TEX,), text) if "\\" in text else 0


#: How many marks of each kind of foreign markup a text holds.
MARKS = (("html", _html_marks), ("wiki", _wiki_marks), ("latex", _latex_marks))


def foreign_kinds(text: str | None) -> list[str]:
    """Which foreign markup ``text`` carries: html, wiki, latex."""
    if not text:
        return []
    m, _ = _mask(text)
    return [kind for kind, marks in MARKS if marks(m)]


_ATTRIBUTE = re.compile(r"""\b(class|id|href|alt|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""", re.I)
_PIECE = re.compile(r"<\s*(/?)\s*(" + _NAMES + r")\b([^<>]*?)(/?)\s*>", re.I | re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _generalised(name: str, attributes: str) -> str:
    found = dict((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes))
    kind = re.sub(r"\d+", "", found.get("class", "").split(" ")[0]).strip("-_")
    return f"{name}.{kind}" if kind else name


class _Open:
    """An element that is open: where its container began, what containers within it hold, and whether the text in it is left out."""

    __slots__ = ("name", "path", "text", "links", "inner", "lost", "whole")

    def __init__(self, name: str, path: str, text: int, links: int, lost: bool, whole: bool):
        self.name, self.path, self.text, self.links, self.inner, self.lost, self.whole = name, path, text, links, (0, 0), lost, whole


class _Elements:
    """The open elements while a text is read, with the running totals of text and of links; every step takes constant time.

    With a lost container of chrome goes all that is in it; in other lost ones the
    containers within are judged by their own paths.
    """

    def __init__(self, text: str, losing: frozenset[str] = frozenset()):
        self.losing, self.stack, self.places = losing, [], {}
        self.text = self.links = 0
        self.closes = {m.group(2).lower(): m.start() for m in _PIECE.finditer(text) if m.group(1)} if losing else {}

    @property
    def lost(self) -> bool:
        return bool(self.stack) and self.stack[-1].lost

    def read(self, run: int) -> None:
        self.text += run
        if self.places.get("a"):
            self.links += run

    def step(self, m: re.Match[str]) -> list[tuple[str, int, int]]:
        """Take one tag; the scores (path, text, links) of the containers that it closes."""
        name = m.group(2).lower()
        if name in _VOID or name in _RAW:
            return []
        if m.group(1):
            places = self.places.get(name)
            return self._close(places[-1]) if places else []
        if not m.group(4):
            above = self.stack[-1] if self.stack else None
            step = _generalised(name, m.group(3))
            path = f"{above.path}>{step}" if above else step
            if len(path) > 500:  # deep paths keep their identity by a digest of what is above
                path = f"#{hashlib.md5(above.path.encode()).hexdigest()}>{step}"
            whole, lost = (above.whole, above.lost) if above else (False, False)
            if name in CONTAINERS and not whole:
                # A container that is cut off is kept.
                lost = path in self.losing and self.closes.get(name, -1) >= m.end()
                whole = lost and name in CHROME
            self.places.setdefault(name, []).append(len(self.stack))
            self.stack.append(_Open(name, path, self.text, self.links, lost, whole))
        return []

    def end(self) -> list[tuple[str, int, int]]:
        return self._close(0)

    def _close(self, at: int) -> list[tuple[str, int, int]]:
        out = []
        while len(self.stack) > at:
            s = self.stack.pop()
            self.places[s.name].pop()
            text, links = self.text - s.text, self.links - s.links
            if s.name in CONTAINERS:
                # Chrome holds all that is in it, others what no container within them holds.
                own = (text, links) if s.name in CHROME else (text - s.inner[0], links - s.inner[1])
                out.append((s.path, *own))
            within = (text, links) if s.name in CONTAINERS else s.inner
            if self.stack:
                up = self.stack[-1]
                up.inner = (up.inner[0] + within[0], up.inner[1] + within[1])
        return out


def _pieces(text: str) -> Iterator[tuple[re.Match[str], bool]]:
    """The tags of a text without those inside of scripts and styles, and whether what stands before is such."""
    closes = {m.group(2).lower(): m.start() for m in _PIECE.finditer(text) if m.group(1) and m.group(2).lower() in _RAW}
    raw = ""
    for m in _PIECE.finditer(text):
        name = m.group(2).lower()
        if raw and not (m.group(1) and name == raw):
            continue
        inside = bool(raw)
        raw = name if name in _RAW and not m.group(1) and closes.get(name, -1) >= m.end() else ""
        yield m, inside


def _values(body: str) -> list[str]:
    """The values of a template: what its parameters hold."""
    return [v.split("=", 1)[-1].strip() if re.match(r"\s*[\w .-]{1,40}=", v) else v.strip() for v in body.strip("{}").split("|")[1:]]


def _template_path(body: str) -> str:
    return "wiki:" + re.sub(r"[\d_]+", " ", body.strip("{}").split("|", 1)[0]).strip().lower()[:60]


_ENVIRONMENT = re.compile(r"\\begin\s*\{([A-Za-z]+)\*?\}(.*?)\\end\s*\{\1\*?\}", re.S)


def container_scores(text: str) -> list[tuple[str, int, int]]:
    """(path, characters of text, of these links or the like) of each container of ``text``.

    Of a template, values of fewer than five words count as the like of links; of an
    environment, commands and numbers.
    """
    masked = _COMMENT.sub("", _mask(text)[0])
    out = []
    for m in _TEMPLATE.finditer(masked):
        values = _values(m.group())
        out.append((_template_path(m.group()), sum(map(len, values)), sum(len(v) for v in values if len(v.split()) < 5)))
    for m in _ENVIRONMENT.finditer(masked):
        if m.group(1) not in FORMED:
            body = m.group(2).strip()
            words = sum(len(w) for w in re.findall(r"(?<![\\A-Za-z])[^\W\d_]{2,}", body))
            out.append((f"latex:{m.group(1)}", len(body), len(body) - min(len(body), 2 * words)))
    if "<" in masked:
        elements, at = _Elements(masked), 0
        for m, raw in _pieces(masked):
            if not raw:
                elements.read(len(masked[at : m.start()].strip()))
            at = m.end()
            out += elements.step(m)
        out += elements.end()
    return out


def _html(text: str, losing: frozenset[str]) -> str:
    text = _COMMENT.sub("", text)
    parts: list[str] = []
    elements = _Elements(text, losing)
    lists: list[str] = []
    cells = 0
    at = 0
    for m, raw in _pieces(text):
        close, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        lost = elements.lost
        if not lost and not raw:
            parts.append(text[at : m.start()])
        at = m.end()
        elements.step(m)
        if lost or elements.lost:
            if lost != elements.lost:
                parts.append("\n\n")
            continue
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            parts.append("\n\n" if close else "\n\n" + "#" * int(name[1]) + " ")
        elif name in ("ul", "ol", "menu"):
            (lists.pop() if close and lists else None) if close else lists.append(name)
            parts.append("\n")
        elif name == "li":
            parts.append("" if close else "\n- ")
        elif name == "tr":
            cells = 0
            parts.append(" |\n" if close else "\n| ")
        elif name in ("td", "th"):
            if not close:
                parts.append(" | " if cells else "")
                cells += 1
        elif name in ("pre",):
            parts.append("\n```\n")
        elif name in ("code", "kbd", "samp", "tt"):
            parts.append("`")
        elif name in ("b", "strong"):
            parts.append("**")
        elif name in ("i", "em"):
            parts.append("*")
        elif name == "br":
            parts.append("\n")
        elif name == "hr":
            parts.append("\n\n---\n\n")
        elif name == "img":
            alt = next((a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() == "alt"), "")
            parts.append(alt)
        elif name in ("p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "table", "blockquote", "figure", "dl", "dd", "dt", "form"):
            parts.append("\n\n")
    if not elements.lost:
        parts.append(text[at:])
    text = _TAG.sub("", "".join(parts))
    text = _CUT_TAG.sub("", text)
    while True:  # references may be escaped more than once; each round makes the text shorter
        new = _ENTITY.sub(lambda m: html.unescape(m.group() if m.group().endswith(";") else m.group() + ";") if _is_entity(m.group()) else m.group(), text)
        if new == text:
            break
        text = _TAG.sub("", new)
    return text.replace("\xa0", " ")


def _wiki_table(m: re.Match[str]) -> str:
    rows: list[list[str]] = [[]]
    for line in m.group().split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|}"):
            break
        elif line[:1] in "|!" and line:
            rows[-1] += [c.strip() for c in re.split(r"\|\||!!", line[2:] if line.startswith("|+") else line[1:])]
        elif line and rows[-1]:
            rows[-1][-1] += " " + line
    rows = [r for r in rows if r]
    out = ["| " + " | ".join(r) + " |" for r in rows]
    if rows:
        out.insert(1, "|" + "---|" * len(rows[0]))
    return "\n".join(out)


def _wiki(text: str, winning: frozenset[str] = frozenset()) -> str:
    def template(m: re.Match[str]) -> str:
        return "\n".join(v for v in _values(m.group()) if len(v.split()) >= 5) if _template_path(m.group()) in winning else ""

    while (new := _TEMPLATE.sub(template, text)) != text:
        text = new
    text = _TABLE.sub(_wiki_table, text)
    text = _HEADING.sub(lambda m: "#" * len(m.group(1)) + " " + m.group(2).strip(), text)

    def link(m: re.Match[str]) -> str:
        inner = m.group(1)
        head = inner.split(":", 1)[0].strip().lower()
        if ":" in inner and head in ("file", "image", "category", "dosya", "resim", "kategori", "datei", "kategorie", "fichier", "catégorie", "archivo", "categoría", "файл", "категория"):
            return inner.rsplit("|", 1)[1] if "|" in inner else ""
        return inner.rsplit("|", 1)[-1]

    text = _LINK.sub(link, text)
    text = _OUTER.sub(lambda m: f"[{m.group(2)}]({m.group(1)})", text)
    text = _QUOTES.sub(lambda m: ("*" if len(m.group(1)) == 2 else "**" if len(m.group(1)) < 5 else "***").join(("", m.group(2).strip(), "")), text)
    text = _TERM.sub(r"- **\1**: \2", text)
    return _RULE.sub("---", text)


_TEX_RULES = [
    (re.compile(r"\\(section|chapter|part)\*?\{([^{}]*)\}"), r"\n## \2\n"),
    (re.compile(r"\\subsection\*?\{([^{}]*)\}"), r"\n### \1\n"),
    (re.compile(r"\\(?:sub)*(?:subsection|paragraph)\*?\{([^{}]*)\}"), r"\n#### \1\n"),
    (re.compile(r"\\begin\{(equation|align|displaymath|gather|multline)\*?\}(.*?)\\end\{\1\*?\}", re.S), lambda m: "\n$$\n" + re.sub(r"\\label\{[^{}]*\}", "", m.group(2)).strip() + "\n$$\n"),
    (re.compile(r"\\begin\{(?:verbatim|lstlisting)\}(.*?)\\end\{(?:verbatim|lstlisting)\}", re.S), r"\n```\1```\n"),
    (re.compile(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", re.S), lambda m: "\n" + "\n".join("| " + " | ".join(c.strip() for c in r.split("&")) + " |" for r in re.split(r"\\\\", m.group(1)) if r.strip()) + "\n"),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:label|cite[tp]?|ref|eqref|pageref|index|vspace|hspace|bibliography|usepackage|documentclass)\*?(?:\[[^\[\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\footnote\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"\\(?:textbf|bfseries)\{([^{}]*)\}|\{\\bf\s+([^{}]*)\}"), lambda m: f"**{m.group(1) or m.group(2) or ''}**"),
    (re.compile(r"\\(?:emph|textit)\{([^{}]*)\}|\{\\(?:it|em)\s+([^{}]*)\}"), lambda m: f"*{m.group(1) or m.group(2) or ''}*"),
    (re.compile(r"\\(?:texttt|verb)\{([^{}]*)\}"), r"`\1`"),
    (re.compile(r"\\item(?:\[[^\[\]]*\])?[ \t]*"), "- "),
    (re.compile(r"\\(?:begin|end)\s*\{[^{}\n]*\}?(?:\[[^\[\]\n]*\])?"), ""),
    (re.compile(r"\\approx(?![A-Za-z])"), "≈"), (re.compile(r"\\times(?![A-Za-z])"), "×"), (re.compile(r"\\pm(?![A-Za-z])"), "±"),
    (re.compile(r"\\S(?![A-Za-z])"), "§"), (re.compile(r"\\l?dots(?![A-Za-z])"), "…"),
]


def _latex(text: str, kept: list[str], losing: frozenset[str] = frozenset()) -> str:
    if any(p.startswith("latex:") for p in losing):
        text = _ENVIRONMENT.sub(lambda m: "\n\n" if f"latex:{m.group(1)}" in losing else m.group(), text)
    before = None
    while before != text:
        before = text
        for rule, to in _TEX_RULES:
            text = rule.sub(to, text)
    # Formulas made above are kept as they are.
    text = re.sub(r"\$\$\n.*?\n\$\$", lambda m: (kept.append(m.group()), f"\ue000{len(kept) - 1}\ue001")[1], text, flags=re.S)
    while (new := re.sub(r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}", r"\1", text)) != text:
        text = new
    text = _TEX.sub(lambda m: "", text)
    return re.sub(r"\\([%&_#$])", r"\1", text).replace("~§", " §").replace("\\\\\n", "\n")


def clean(text: str | None, winning: frozenset[str] = frozenset(), losing: frozenset[str] = frozenset()) -> tuple[str | None, list[str]]:
    """The clean text of ``text`` by the winning and losing paths of its host, and the kinds of foreign markup that were used up for it."""
    if text is None:
        return None, []
    m, kept = _mask(text)
    before = {kind: marks(m) for kind, marks in MARKS}
    if not any(before.values()):
        return text.strip(), []
    if before["latex"]:
        m = _latex(m, kept, losing)
    if before["wiki"]:
        m = _wiki(m, winning)
    if before["html"]:
        m = _html(m, losing)
    kinds = [kind for kind, marks in MARKS if before[kind] and marks(m) < before[kind]]
    out = _unmask(m, kept)
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", out, flags=re.M)).strip()
    # A record that is nothing but lost containers is kept.
    return clean(text, winning) if losing and not out else (out, kinds)


def host_votes(pages: DataFrame) -> DataFrame:
    """(``host``, ``path``, ``lehte``, ``aleyhte``, ``kazandi``): how many records of each host voted for and against each path, and whether it won, lost (false) or was not decided (null).

    A record's scores are summed before it votes; identical rows are one record.
    """

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(h, r, *s) for h, t, r in zip(pdf["host"], pdf["markdown"], pdf["kayit"]) if t for s in container_scores(t)]
            yield pd.DataFrame(out, columns=["host", "kayit", "path", "metin", "bag"])

    tagged = pages.where(F.col("markdown").rlike(r"<\s*/?\s*[A-Za-z]|\{\{|\\begin")).select("host", "markdown", F.md5(F.to_json(F.struct(*pages.columns))).alias("kayit"))
    rows = tagged.mapInPandas(score, "host string, kayit string, path string, metin bigint, bag bigint")
    each = rows.groupBy("host", "path", "kayit").agg((F.sum("metin") - LINK_WEIGHT * F.sum("bag")).alias("skor"))
    votes = each.groupBy("host", "path").agg(F.count_if(F.col("skor") > 0).alias("lehte"), F.count_if(F.col("skor") < 0).alias("aleyhte"))
    decided = (F.col("lehte") + F.col("aleyhte") >= VOTERS) & (F.col("lehte") != F.col("aleyhte"))
    return votes.withColumn("kazandi", F.when(decided, F.col("lehte") > F.col("aleyhte")))


def with_clean_text(pages: DataFrame) -> DataFrame:
    """``pages`` (with ``host``, ``markdown``) with ``temiz`` and ``turler`` added; such columns are replaced."""
    votes = cut(host_votes(pages).where("kazandi is not null"))
    paths = votes.groupBy("host").agg(F.collect_set(F.when(F.col("kazandi"), F.col("path"))).alias("__won"), F.collect_set(F.when(~F.col("kazandi"), F.col("path"))).alias("__lost"))
    if votes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        paths = F.broadcast(paths)
    signed = F.col("markdown").rlike(SIGN)
    kept = [c for c in pages.columns if c not in ("temiz", "turler")]

    @F.pandas_udf("struct<temiz:string,turler:array<string>>")
    def extract(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        chosen = lambda p: frozenset(p) if p is not None else frozenset()
        for texts, won, lost in parts:
            made = [clean(t, chosen(w), chosen(x)) for t, w, x in zip(texts, won, lost)]
            yield pd.DataFrame(made, columns=["temiz", "turler"])

    made = pages.select(*kept).join(paths, "host", "left").withColumn("__e", extract(F.when(signed, F.col("markdown")), F.col("__won"), F.col("__lost")))
    return made.select(*kept, F.when(signed, F.col("__e.temiz")).otherwise(F.trim("markdown")).alias("temiz"), F.coalesce(F.when(signed, F.col("__e.turler")), F.array().cast("array<string>")).alias("turler"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_clean_text(table(spark, sf_dir, "onbellek", "kayit_no", "host", "markdown"))
    return made.select("kayit_no", F.explode("turler").alias("tur")).distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's clean text and the foreign markup it had."""
    made = with_clean_text(table(spark, sf_dir, "onbellek", "kayit_no", "host", "markdown"))
    return made.groupBy("kayit_no").agg(F.first("temiz").alias("temiz"), F.first("turler").alias("turler"))


def p1_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes of each host on the paths of its containers."""
    return host_votes(table(spark, sf_dir, "onbellek", "kayit_no", "host", "markdown"))
