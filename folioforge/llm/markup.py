"""Problem 2: HTML, wiki and LaTeX markup in notes, to clean text.

Each text is parsed, fenced and inline code aside, to the nodes of its markup:
elements by their path, wiki and LaTeX constructs by their kind. The nodes of
all texts of one host (here: directory) are merged to a style tree. A place in
the tree is important if what stands there differs from page to page: its
importance is the entropy of presentation and of content over the pages that
have it, its own and, weighted down by depth, that of the places below; each
branch's part is measured against a fixed base, so that it does not change with
the number of pages. Blocks at places of low importance that a good part of the
host's pages share are removed from each page; the rest is rendered with
headings, lists, tables, code and formulas kept. Inline elements, breaks,
entities, formulas and wiki and LaTeX constructs are never removed as noise.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, rows_of, small_batches, written

#: A block is noise if so many pages of the host have it, at least this share of its pages with blocks, and its place is less important than this.
MIN_PAGES = 12
SHARE = 0.5
IMPORTANCE = 0.2
#: A branch that one page in so many has, or fewer, counts as wholly different.
BASE = 12
#: What a level of the tree counts for the place above it, against the level above.
DECAY = 0.9

# The names of HTML elements, current and obsolete.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress "
    "q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that can be a page's frame. Headings, cells, items and code are parts of what stands around them; html, body and main are the page.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form header hgroup menu nav ol p section table ul".split())
# Namespaces of file and category links, and magic words.
NAMESPACES = "Fichier|File|Image|Média|Media|Catégorie|Category|Modèle|Template|Portail|Portal"
MAGIC = "TOC|NOTOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|NOGALLERY|HIDDENCAT|NOCONTENTCONVERT|NOTITLECONVERT|INDEX|NOINDEX|STATICREDIRECT|NOGLOBAL|SOMMAIRE|AUCUNSOMMAIRE|SOMMAIREFORCÉ|SECTIONNONEDITABLE|CATCACHEE"
# LaTeX commands that stand without an argument.
BARE = frozenset(
    "item par noindent newline newpage clearpage pagebreak linebreak maketitle tableofcontents centering hline toprule midrule bottomrule bigskip medskip smallskip hfill vfill "
    "LaTeX TeX today ldots dots cdots quad qquad appendix small large Large footnotesize bfseries itshape alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega "
    "sum prod int infty times cdot div leq geq neq approx equiv pm to rightarrow leftarrow Rightarrow in subset cup cap forall exists partial nabla left right".split()
)

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$", re.MULTILINE)
_TICKS = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t\r]*\n)[\s\S])*?)(?<!`)\1(?!`)")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?=[\s/>])[^<>]*)>")
_COMMENT = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.IGNORECASE)
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_BREAK = re.compile(r"<(?:br|hr|wbr)\b[^<>]*>", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|style|align|bgcolor|width|color)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)

_TEMPLATE = re.compile(r"\{\{(\{)?(?:[^\S\n]*+\n\s*+)?([^{}|\n]++)(?:\n\s*+)?((?:\|[^{}]*+)?)\}\}(?(1)\})")
_WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t\r]*$", re.MULTILINE)
_QUOTES = re.compile(r"(?<!')('{2,5})(?!')([^\n]+?)(?<!')\1(?!')")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*(?:\n(?![ \t]*\|\})[^\n]*)*(?:\n[ \t]*\|\}[^\n]*)?", re.MULTILINE)
_WIKI_LINK = re.compile(rf"\[\[:?({NAMESPACES}):([^\[\]\n]*)\]\]", re.IGNORECASE)
_MAGIC = re.compile(rf"__(?:{MAGIC})__")

_COMMAND = re.compile(r"(?<![\\:])\\([A-Za-z]+)\*?(?=\{)|(?<![\w:\\/.-])\\([A-Za-z]+)\*?")
_DISPLAY = re.compile(r"\$\$(?!\$)([^$]+?)\$\$|\\\[((?:(?!\\\]).)*[\\^_=+{}](?:(?!\\\]).)*)\\\]|\\\(((?:(?!\\\)).)+)\\\)", re.DOTALL)
_INLINE = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\d$])")
_FORMULA = re.compile(r"[\\^_=+{}<>*/-]|^[A-Za-z]$|^[A-Za-z]?\d+[A-Za-z]?$")

_HELD = re.compile("\ue000(\\d+)\ue001")


class Code:
    """Takes code out of a text, and puts it back."""

    def __init__(self, text: str):
        self.kept: list[str] = []
        self.text = self._fences(text) if "`" in text or "~~~" in text else text

    def hold(self, code: str) -> str:
        self.kept.append(code)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def back(self, text: str) -> str:
        while _HELD.search(text):
            text = _HELD.sub(lambda m: self.kept[int(m[1])] if int(m[1]) < len(self.kept) else "", text)
        return text

    def _fences(self, text: str) -> str:
        out, at, start = [], 0, 0
        while m := _FENCE.search(text, at):
            at = m.end()
            mark = m[1]
            if mark[0] == "`" and "`" in m[2]:
                continue
            end = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t\r]*$", re.MULTILINE).search(text, at)
            at = end.end() if end else len(text)
            out += [self._ticks(text[start : m.start()]), self.hold(text[m.start() : at])]
            start = at
        return "".join((*out, self._ticks(text[start:])))

    def _ticks(self, text: str) -> str:
        return _TICKS.sub(lambda m: self.hold(m[0]), text) if "`" in text else text


def _entity(m: re.Match) -> bool:
    return m[1][0] == "#" or f"{m[1]};" in html5


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split()).lower()) - (1 << 63)


def html_nodes(text: str, back: Callable[[str], str] = str) -> Iterator[tuple[str, str, int, int, int]]:
    """(path, presentation, start, end, content digest) of each element, comment and entity of a text without code.

    An element's content is told apart with its code put back; without any, its digest is 0.
    """
    stack: list[tuple[str, str, str, int, int]] = []

    def close(node: tuple[str, str, str, int, int], end: int, inner_end: int) -> tuple[str, str, int, int, int]:
        _, path, look, start, inner = node
        content = text[inner:inner_end]
        return path, look, start, end, _digest(back(content)) if _BREAK.sub("", content).strip() else 0

    if "<" in text:
        for m in _TAG.finditer(text):
            name = m[2].lower()
            if name not in ELEMENTS:
                continue
            if m[1]:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if at is None:
                    yield f"/{name}", "", m.start(), m.end(), 0
                else:
                    for node in stack[at + 1 :][::-1]:
                        yield close(node, m.start(), m.start())
                    yield close(stack[at], m.end(), m.start())
                    del stack[at:]
                continue
            path = f"{stack[-1][1]}>{name}" if stack else name
            look = ";".join(sorted(f"{k.lower()}={v.strip(chr(34) + chr(39))}" for k, v in _ATTRIBUTE.findall(m[3])))
            if name in VOID or m[3].endswith("/"):
                yield path, look, m.start(), m.end(), 0
            else:
                stack.append((name, path, look, m.start(), m.end()))
        for node in stack[::-1]:
            yield close(node, len(text), len(text))
        for m in _COMMENT.finditer(text):
            yield "!--", "", m.start(), m.end(), _digest(m[0])
    if "&" in text:
        for m in _ENTITY.finditer(text):
            if _entity(m):
                yield "&", "", m.start(), m.end(), _digest(m[0])


def wiki_nodes(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    if "{{" in text:
        for m in _TEMPLATE.finditer(text):
            yield f"{{{{{m[2].strip().lower()}", "", m.start(), m.end(), _digest(m[3])
    if "=" in text:
        for m in _WIKI_HEADING.finditer(text):
            yield m[1], "", m.start(), m.end(), _digest(m[2])
    if "''" in text:
        for m in _QUOTES.finditer(text):
            yield m[1], "", m.start(), m.end(), _digest(m[2])
    if "{|" in text:
        for m in _WIKI_TABLE.finditer(text):
            yield "{|", "", m.start(), m.end(), _digest(m[0])
    if "[[" in text:
        for m in _WIKI_LINK.finditer(text):
            yield f"[[{m[1].lower()}", "", m.start(), m.end(), _digest(m[2])
    if "__" in text:
        for m in _MAGIC.finditer(text):
            yield m[0].lower(), "", m.start(), m.end(), 0


def latex_nodes(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    if "\\" in text:
        for m in _COMMAND.finditer(text):
            name, behind = m[1] or m[2], text[m.end() : m.end() + 1]
            if behind in ("{", "[") or name in BARE and not behind.isalnum() and behind not in ("\\", "-", "_", "."):
                yield f"\\{name}", "", m.start(), m.end(), _digest(text[m.end() : _arguments_end(text, m.end())])
    if "$" in text or "\\[" in text or "\\(" in text:
        for m in _DISPLAY.finditer(text):
            yield "$$", "", m.start(), m.end(), _digest(m[0])
        if "$" in text:
            for m in _INLINE.finditer(text):
                if _FORMULA.search(m[1]):
                    yield "$", "", m.start(), m.end(), _digest(m[1])


KINDS = (("html", html_nodes), ("wiki", wiki_nodes), ("latex", latex_nodes))


def nodes(text: str, back: Callable[[str], str] = str) -> list[tuple[str, str, str, int, int, int]]:
    """(markup, path, presentation, start, end, content digest) in a text whose code is taken out; back puts it in again."""
    return [(kind, *n) for kind, find in KINDS for n in (find(text, back) if kind == "html" else find(text))]


# Rendering: each step takes text without code, and returns it without its kind of markup.


def _drop(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these blocks; what stood around one stays apart."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "\n\n"]
            at = b
        else:
            at = max(at, b)
    return "".join((*out, text[at:]))


def _unhtml(text: str, code: Code) -> str:
    """HTML to text: code held, headings, lists, tables and breaks as Markdown."""
    text = _COMMENT.sub("", text)
    text = re.sub(r"<(script|style)\b[^<>]*>[\s\S]*?</\1\s*>", "", text, flags=re.IGNORECASE)

    def pre(m: re.Match) -> str:
        inner = html.unescape(_TAG.sub(lambda t: "" if t[2].lower() in ELEMENTS else t[0], m[1])).strip("\n")
        return "\n\n" + code.hold(f"```\n{inner}\n```") + "\n\n"

    text = re.sub(r"<pre\b[^<>]*>([\s\S]*?)</pre\s*>", pre, text, flags=re.IGNORECASE)
    text = re.sub(r"<code\b[^<>]*>([^\n]*?)</code\s*>", lambda m: code.hold(f"`{html.unescape(m[1])}`"), text, flags=re.IGNORECASE)
    text = re.sub(r"\s*\n\s*(?=</?(?:li|tr|td|th|dt|dd)\b|</(?:ul|ol|dl|table)\b)", "", text, flags=re.IGNORECASE)
    lists: list[list] = []

    def tag(m: re.Match) -> str:
        shut, name, rest = m[1], m[2].lower(), m[3]
        if name not in ELEMENTS:
            return m[0]
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            return "\n\n" if shut else "\n\n" + "#" * int(name[1]) + " "
        if name in ("ul", "ol", "dl", "menu", "dir"):
            if shut:
                if lists:
                    lists.pop()
            else:
                lists.append([name, 0])
            return "\n"
        if name in ("li", "dt", "dd"):
            if shut:
                return ""
            if lists:
                lists[-1][1] += 1
            depth = "  " * max(0, len(lists) - 1)
            return f"\n{depth}{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else f"\n{depth}- "
        if name == "tr":
            return "" if shut else "\n|"
        if name in ("td", "th"):
            return " |" if shut else " "
        if name in ("b", "strong"):
            return "**"
        if name in ("i", "em"):
            return "*"
        if name == "br":
            return "\n"
        if name == "hr":
            return "\n\n---\n\n"
        if name == "img":
            alt = re.search(r"""\balt\s*=\s*("[^"]*"|'[^']*')""", rest, re.IGNORECASE)
            return alt[1][1:-1] if alt else ""
        if name in ("p", "div", "table", "blockquote", "section", "article", "header", "footer", "nav", "main", "aside", "figure", "form", "html", "body", "head", "title", "tbody", "thead", "caption"):
            return "\n\n"
        return ""

    text = _TAG.sub(tag, text)
    plain = _ENTITY.sub(lambda m: html.unescape(m[0]) if _entity(m) else m[0], text)
    # markup that was escaped, once or more often, is markup still; each round has fewer entities
    escaped = plain != text and (any(m[2].lower() in ELEMENTS for m in _TAG.finditer(plain)) or _COMMENT.search(plain) or any(map(_entity, _ENTITY.finditer(plain))))
    return _unhtml(plain, code) if escaped else plain


def _argument(text: str, at: int) -> tuple[str, int]:
    """The braced argument that starts at ``at``, and the offset behind it."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{" and text[i - 1] != "\\":
            depth += 1
        elif text[i] == "}" and text[i - 1] != "\\":
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


def _arguments_end(text: str, at: int) -> int:
    """The offset behind the bracketed and braced arguments that start at ``at``."""
    while text[at : at + 1] == "[" and (shut := text.find("]", at)) > 0:
        at = shut + 1
    while text[at : at + 1] == "{":
        at = _argument(text, at)[1]
    return at


_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_SHOWN = {"textbf": "**", "textit": "*", "emph": "*", "underline": "", "texttt": "`", "textsc": "", "text": "", "mbox": "", "textrm": "", "caption": "", "title": "# ", "author": "", "date": ""}
_SILENT = frozenset("documentclass usepackage label ref cite citep citet pageref bibliographystyle bibliography input include vspace hspace setlength newcommand renewcommand includegraphics".split())


def _unlatex(text: str, code: Code) -> str:
    """LaTeX to text; formulas are held as they stand, environments opened up."""
    text = _DISPLAY.sub(lambda m: code.hold(m[0]), text)
    text = _INLINE.sub(lambda m: code.hold(m[0]) if _FORMULA.search(m[1]) else m[0], text)
    out, at, rows = [], 0, 0
    while m := _COMMAND.search(text, at):
        name, behind = m[1] or m[2], m.end()
        known = text[behind : behind + 1] in ("{", "[") or name in BARE
        out.append(text[at : m.start()])
        if not known:
            out.append(m[0])
            at = behind
            continue
        while text[behind : behind + 1] == "[" and (shut := text.find("]", behind)) > 0:
            behind = shut + 1
        inner = None
        if text[behind : behind + 1] == "{" and name not in ("item",):
            inner, behind = _argument(text, behind)
        if name in ("begin", "end"):
            if name == "begin" and inner in ("tabular", "tabularx", "array", "longtable") and text[behind : behind + 1] == "{":
                _, behind = _argument(text, behind)
            rows += {"begin": 1, "end": -1}[name] * (inner in ("tabular", "tabularx", "array", "longtable"))
            out.append("\n")
        elif name in _LEVELS:
            out.append("\n\n" + "#" * _LEVELS[name] + " " + _unlatex(inner or "", code) + "\n\n")
        elif name == "item":
            out.append("- ")
            while text[behind : behind + 1] == " ":
                behind += 1
        elif name == "footnote":
            out.append(f" ({_unlatex(inner or '', code)})")
        elif name in _SILENT:
            if out and out[-1].endswith("~"):
                out[-1] = out[-1][:-1]
        elif name in _SHOWN:
            out.append(_SHOWN[name] + _unlatex(inner or "", code) + (_SHOWN[name] if name != "title" else "\n\n"))
        elif inner is not None:
            out.append(_unlatex(inner, code) if name not in BARE else code.hold(text[m.start() : behind]))
        elif name in ("LaTeX", "TeX"):
            out.append(name)
        elif name in ("ldots", "dots"):
            out.append("…")
        at = behind
        if rows > 0:
            stop = text.find("\\end", at)
            part = text[at : stop if stop >= 0 else len(text)]
            out.append("\n".join("| " + " | ".join(c.strip() for c in line.split("&")) + " |" if line.strip() else "" for line in re.split(r"\\\\[ \t]*\n?", part.replace("\\hline", "")) if line.strip()))
            at = stop if stop >= 0 else len(text)
    return "".join((*out, text[at:]))


def _unwiki(text: str) -> str:
    """Wiki markup to text: headings and tables as Markdown, templates to their plain values."""

    def heading(m: re.Match) -> str:
        return "#" * len(m[1]) + " " + m[2]

    def tbl(m: re.Match) -> str:
        rows, now = [], []
        for line in m[0].split("\n")[1:]:
            line = line.strip()
            if line.startswith(("|}", "|-")):
                rows += [now] if now else []
                now = []
            elif line.startswith("|+"):
                rows.append([line[2:].strip()])
            elif line[:1] in ("|", "!"):
                now += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
        rows += [now] if now else []
        return "\n".join("| " + " | ".join(r) + " |" for r in rows)

    def template(m: re.Match) -> str:
        values = [v.partition("=")[2] or v for v in m[3].split("|")[1:]]
        return ", ".join(v.strip() for v in values if v.strip())

    def link(m: re.Match) -> str:
        parts = m[2].split("|")
        return parts[-1].strip() if len(parts) > 1 and m[1].lower() in ("fichier", "file", "image", "média", "media") else ""

    text = _WIKI_TABLE.sub(tbl, text)
    n = 1
    while n:  # from the innermost out; each takes braces away
        text, n = _TEMPLATE.subn(template, text)
    text = _WIKI_HEADING.sub(heading, text)
    text = _QUOTES.sub(lambda m: {2: "*", 3: "**"}.get(len(m[1]), "***") + m[2].strip() + {2: "*", 3: "**"}.get(len(m[1]), "***"), text)
    return _MAGIC.sub("", _WIKI_LINK.sub(link, text))


def clean_text(text: str, removed: list[int] | None = None) -> str:
    """The text without markup and without the branches at these node numbers."""
    code = Code(text)
    found = nodes(code.text)
    if not found:
        return text
    body, kinds = code.text, {n[0] for n in found}
    if removed:
        body = _drop(body, [(found[i][3], found[i][4]) for i in removed if i < len(found)])
    if "html" in kinds:
        body = _unhtml(body, code)
    if "latex" in kinds:
        body = _unlatex(body, code)
    if "wiki" in kinds:
        body = _unwiki(body)
    body = re.sub(r"[ \t]+\n", "\n", body)
    return code.back(re.sub(r"\n{3,}", "\n\n", body).strip("\n").rstrip())


NODES = "item_table string, item_id long, host string, node int, markup string, path string, look string, content long"
_NODES = pa.schema([("item_table", pa.string()), ("item_id", pa.int64()), ("host", pa.string()), ("node", pa.int32()), ("markup", pa.string()), ("path", pa.string()), ("look", pa.string()), ("content", pa.int64())])


def items_of(df: DataFrame, name: str, item: str, host: str, text: str) -> DataFrame:
    return df.select(F.lit(name).alias("item_table"), F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))


def markup_nodes(items: DataFrame) -> DataFrame:
    """One row for each node of markup in rows (item_table, item_id, host, text); texts without markup give none."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _NODES]
            for table, key, host, text in rows_of(batch, "item_table", "item_id", "host", "text"):
                if not text:
                    continue
                code = Code(text)
                for i, (kind, path, look, _, _, content) in enumerate(nodes(code.text, code.back)):
                    for c, v in zip(out, (table, key, host, i, kind, path, look, content), strict=True):
                        c.append(v)
            yield batch_of(_NODES, out)

    return items.select("item_table", "item_id", "host", "text").mapInArrow(run, NODES)


_PLACE = ("host", "markup", "path")
_BRANCH = (*_PLACE, "look", "content")


def _branches(found: DataFrame, *by: str) -> DataFrame:
    """Branches with the pages that hold them and the nodes there; a page is an (item_table, item_id), however many rows repeat it."""
    return found.groupBy(*by, "item_table", "item_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("nodes"))


def _variety(found: DataFrame, kind: str) -> DataFrame:
    """Places with how much one kind of their nodes' features differs, from 0 (all alike) to 1 (all different).

    The mean of -log(share of the pages), in units of log(BASE) and 1 at most:
    equal shares give equal values, whatever the number of pages. A place on one
    page can't be told to be alike.
    """
    branches = _branches(found, *_PLACE, kind)
    whole = branches.groupBy(*_PLACE).agg(F.sum("pages").alias("all"), F.sum("nodes").alias("nodes"))
    part = F.col("pages") / F.col("all")
    apart = F.sum(part * F.least(F.lit(1.0), -F.log(part) / math.log(BASE)))
    return branches.drop("nodes").join(whole, [*_PLACE]).groupBy(*_PLACE).agg(F.max("nodes").alias("nodes"), F.when(F.first("all") > 1, apart).otherwise(1.0).alias(kind))


def style_tree(found: DataFrame) -> DataFrame:
    """Places (host, markup, path) with the nodes there, the variety of their presentation and content, and their composite importance.

    A place's own importance is the greater of the two. The composite one goes
    up the tree: the mean of the places of each level below, weighted by their
    nodes, counts DECAY times as much as the level above it. A tree has as many
    rows as its hosts have places, each sent once to every place above it.
    """
    own = _variety(found, "look").join(_variety(found, "content").drop("nodes"), [*_PLACE]).withColumn("own", F.greatest("look", "content"))
    steps = F.split("path", ">")
    level = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ">")))
    above = own.select("host", "markup", F.size(steps).alias("depth"), "nodes", "own", level).select("host", "markup", F.col("col").alias("path"), (F.col("depth") - F.col("pos") - 1).alias("down"), "nodes", "own")
    levels = above.groupBy(*_PLACE, "down").agg((F.sum(F.col("own") * F.col("nodes")) / F.sum("nodes")).alias("mean")).withColumn("weight", F.pow(F.lit(DECAY), F.col("down")))
    composite = levels.groupBy(*_PLACE).agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("importance"))
    return own.join(composite, [*_PLACE]).select(*_PLACE, "nodes", F.col("look").alias("presentation"), "content", "importance")


def noise(found: DataFrame, tree: DataFrame, min_pages: int = MIN_PAGES, importance: float = IMPORTANCE, share: float = SHARE) -> DataFrame:
    """Branches (host, markup, path, look, content) of blocks with content that many of a host's pages share at a place of low importance.

    Shares are of the host's pages that have any such block: plain notes in the
    same directory have no frame, and say nothing about it.
    """
    blocks = found.where((F.col("markup") == "html") & F.element_at(F.split("path", ">"), -1).isin(*sorted(BLOCKS)) & (F.col("content") != 0))
    held = blocks.select("host", "item_table", "item_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    shared = _branches(blocks, *_BRANCH).where(F.col("pages") >= min_pages).join(held, "host").where(F.col("pages") >= share * F.col("all")).select(*_BRANCH)
    return shared.join(tree.where(F.col("importance") < importance).select(*_PLACE), [*_PLACE])


def found_markup(items: DataFrame) -> DataFrame:
    """(item_table, item_id, markup) of every text that holds nodes of that markup in its host's style tree.

    Null and empty texts hold none; repeated rows are reported once; a null id
    is reported as null.
    """
    found = written(markup_nodes(items), "markup")
    return found.join(style_tree(found), ["host", "markup", "path"]).select("item_table", "item_id", "markup").distinct()


def removed_branches(items: DataFrame) -> DataFrame:
    """(host, path, look, content, pages, importance) of the branches that clean_items removes as noise, each once; null texts hold none, an empty table gives none."""
    found = written(markup_nodes(items), "markup")
    tree = written(style_tree(found), "tree")
    gone = noise(found, tree)
    held = found.join(gone, [*_BRANCH])
    return _branches(held, *_BRANCH).join(tree.select(*_PLACE, "importance"), [*_PLACE]).select("host", "path", "look", "content", "pages", F.round("importance", 6).alias("importance"))


def clean_items(items: DataFrame) -> DataFrame:
    """(item_table, item_id, clean, removed_branches) of every row.

    Null texts stay null, texts without markup stay as they are. Repeated rows
    and null ids stay; rows of one id are treated alike.
    """
    found = written(markup_nodes(items), "markup")
    gone = found.join(noise(found, style_tree(found)), ["host", "markup", "path", "look", "content"]).groupBy("item_table", "item_id", "host").agg(F.sort_array(F.collect_set("node")).alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_table", pa.string()), ("item_id", pa.int64()), ("clean", pa.string()), ("removed_branches", pa.int32())])
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for table, key, text, removed in rows_of(batch, "item_table", "item_id", "text", "removed"):
                for c, v in zip(out, (table, key, None if text is None else clean_text(text, removed), len(removed or ())), strict=True):
                    c.append(v)
            yield batch_of(schema, out)

    joined = items.join(gone, (items["item_table"] == gone["item_table"]) & items["item_id"].eqNullSafe(gone["item_id"]) & (items["host"] == gone["host"]), "left")
    return joined.select(items["item_table"], items["item_id"], "text", "removed").mapInArrow(run, "item_table string, item_id long, clean string, removed_branches int")
