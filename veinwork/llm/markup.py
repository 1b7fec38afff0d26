"""Markup residue in texts: which kinds a text holds, and the clean text behind it.

A text is parsed once into a tree of blocks (headings, list items, code, formulas, table
rows, quotes, paragraphs) with inline runs below them. Every node that owes its form to a
markup language carries that language; a text holds a kind of markup if its tree has
such a node. The clean text is the tree written without signs.

For pages of one host wrappers are induced: their trees are aligned by simple tree
matching, nodes that stay constant are the host's template and the rest is content; the
clean texts leave the template out.

Defined cases: null and blank texts have no markup and null or blank clean text; code
and formulas keep their characters; unclosed constructs end with the text; texts are
parsed whole and in linear time; equal rows give equal rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.session import broadcast_if_small, cut, spread, tasks

# Element names of HTML.
ELEMENTS = ("a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
            "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend "
            "li link main map mark meta nav noscript object ol option p param pre q ref s samp script section select small source span strike "
            "strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr nowiki math")
_EL = "|".join(sorted(ELEMENTS.split(), key=len, reverse=True))
TAG = re.compile(rf"<(/?)({_EL})(\s[^<>]*)?\s*(/?)>", re.I)
OPEN_TAG = re.compile(rf"<(?:{_EL})\s+[A-Za-z-]+\s*=(?:\s*\"[^\"<>\n]*\"?)?", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>|<\?xml[^<>]*>|<!\[CDATA\[|\]\]>", re.S | re.I)
HIDDEN = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,8}[0-9]{0,2});", re.I)

FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[ \t]*([\w+-]*)[ \t]*$")
ATX = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*$")
SETEXT = re.compile(r"^[ \t]{0,3}(={3,}|-{3,})[ \t]*$")
QUOTE = re.compile(r"^[ \t]{0,3}>[ \t]?(?=\S)")
PIPE_ROW = re.compile(r"^[ \t]*\|[^|\n]*\|(?:[^|\n]*\|)*[ \t]*$")
PIPE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$")
STARS = re.compile(r"(?<![A-Za-z0-9*\\])(\*{1,3})(?=[^\s*])([^*\n]*?)(?<=[^\s*])\1(?![A-Za-z0-9*])")
BARS2 = re.compile(r"(?<![A-Za-z0-9_\\])(__)(?=[^\s_])([^_\n]*?)(?<=[^\s_])__(?![A-Za-z0-9_])")
BARS1 = re.compile(r"(?<![A-Za-z0-9_\\/.])(_)(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![A-Za-z0-9_])")
STRIKE = re.compile(r"(~~)(?=\S)([^~\n]+?)(?<=\S)~~")
TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)")
LINK = re.compile(r"(?<!\])\[([^\[\]\n]+)\]\([^()\s]*(?:\s\"[^\"\n]*\")?\)")
REFLINK = re.compile(r"^[ \t]{0,3}\[[^\]\n]{1,80}\]:[ \t]+\S+.*$|\[\^[\w-]{1,40}\]:?", re.M)
WORDS_MAGIC = re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|GALLERY)__|__FORCETOC__")

WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$")
WIKI_FILE = re.compile(r"\[\[(?:File|Image|Datei|Bild|Fichier|Archivo|Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]\n]*\]\]", re.I)
WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
APOS = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])([^'\n]*(?:'[^'\n]+){0,20}?)\1(?!')")
REDIRECT = re.compile(r"^[ \t]*#(?:REDIRECT|WEITERLEITUNG|REDIRECTION|REDIRECCIÓN)\b[ \t]*", re.I)
EXT_LINK = re.compile(r"\[https?://[^\s\]]+(?:\s+([^\[\]\n]+))?\]")

ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]{0,80}\]|\{[^{}\n]{0,80}\})*")
CODE_ENVS = {"verbatim", "lstlisting", "minted", "Verbatim", "alltt"}
MATH_ENVS = {"equation", "equation*", "align", "align*", "displaymath", "math", "eqnarray", "gather", "gather*", "multline"}
SECTIONING = re.compile(r"^[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}\n]*)\}")
DOLLARS = re.compile(r"(?<![\\$\w])(\$\$?)(?=[^\s$\d])([^$\n]+?)(?<=[^\s$])\1(?![\w$])|(?<![\\$\w])(\$\$?)(?=\d)([^$\n\\^_=]*[\\^_=][^$\n]*?)(?<=[^\s$])\3(?![\w$])")
PARENS = re.compile(r"\\\(((?:(?!\\[()]).)+)\\\)|\\\[((?:(?!\\[\[\]]).)+)\\\]", re.S)
DROP_CMD = re.compile(r"~?\\(?:cite[tp]?|ref|eqref|label|pageref|footnote|footnotemark|bibliography|input|includegraphics|usepackage|documentclass|vspace|hspace)\*?(?:\[[^\]\n]{0,80}\])*\{([^{}\n]*)\}")
KEEP_CMD = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]{0,80}\])?\{([^{}\n]*)\}")
GROUP_CMD = re.compile(r"\{\\(?:it|bf|em|tt|sc|sl|rm|sf|small|large|itshape|bfseries|ttfamily)\b[ \t]*([^{}\n]*)\}")
BARE_CMD = re.compile(r"(?<![A-Za-z0-9:\\])\\[A-Za-z]{2,}\*?")
ROW_END = re.compile(r"\\\\(?:\[[^\]\n]{0,20}\])?(?=\s|$)")
ESCAPE = re.compile(r"\\([%&#_{}$])")
#: Java pattern: a text without any of these signs holds no markup.
SIGNS = r"[<&\\$\[{*_`~#|>]|''|={2}|-{3}"
LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
BULLET = re.compile(r"^([ \t]*)(?:([-*+•])[ \t]+|(\d{1,3})[.)][ \t]+)(?=\S)")


@dataclass
class Node:
    kind: str
    text: str = ""
    level: int = 0
    marks: set = field(default_factory=set)


def _inline(text: str, marks: set) -> str:
    """Text of a run without inline markup; the languages met go into marks."""

    def sub(rx: re.Pattern, kind: str, to) -> None:
        nonlocal text
        new = rx.sub(to, text)
        if new != text or rx.search(text):
            marks.add(kind)
        text = new

    while True:  # markup within markup, to any depth: each pass takes signs away
        before = text
        if "<" in text:
            sub(COMMENT, "html", " ")
            sub(TAG, "html", lambda m: "\n" if m[2].lower() in ("br", "p", "div", "tr", "li", "hr") else " " if m[2].lower() in ("td", "th") else "")
            sub(OPEN_TAG, "html", "")
        if "\\" in text:
            sub(PARENS, "latex", lambda m: m[1] or m[2] or "")
        if "$" in text and DOLLARS.search(text):
            held: list[str] = []

            def keep(m: re.Match) -> str:
                held.append(m[2] or m[4])
                return f"\x00{len(held) - 1}\x00"

            sub(DOLLARS, "latex", keep)
            text = _inline(text, marks)
            return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)
        if "\\" in text:
            sub(GROUP_CMD, "latex", lambda m: m[1])
            sub(DROP_CMD, "latex", lambda m: f" ({m[1]})" if "footnote" in m[0] else "")
            while KEEP_CMD.search(text):  # from the innermost outwards, before single commands are dropped
                sub(KEEP_CMD, "latex", lambda m: m[1])
            sub(ROW_END, "latex", "\n")
            sub(BARE_CMD, "latex", "")
            sub(ESCAPE, "latex", lambda m: m[1])
        if "[" in text:
            sub(WIKI_FILE, "wiki", "")
            sub(WIKI_LINK, "wiki", lambda m: m[2] if m[2] is not None else m[1])
            sub(EXT_LINK, "wiki", lambda m: m[1] or "")
            sub(IMAGE, "markdown", lambda m: m[1])
            sub(LINK, "markdown", lambda m: m[1])
            sub(REFLINK, "markdown", "")
        if "{{" in text:
            sub(TEMPLATE, "wiki", "")
        if "''" in text:
            sub(APOS, "wiki", lambda m: m[2])
        if "`" in text:
            sub(TICKS, "markdown", lambda m: m[2])
        if "__" in text:
            sub(WORDS_MAGIC, "wiki", "")
            sub(BARS2, "markdown", lambda m: m[2])
        if "*" in text:
            sub(STARS, "markdown", lambda m: m[2])
        if "~~" in text:
            sub(STRIKE, "markdown", lambda m: m[2])
        if "_" in text:
            sub(BARS1, "markdown", lambda m: m[2])
        if "&" in text and ENTITY.search(text):
            known = ENTITY.sub(lambda m: html.unescape(m[0]), text)
            if known != text:
                marks.add("html")
                text = known
        if text == before:
            break
    return text


_HTML_HEAD = re.compile(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", re.S | re.I)
_HTML_CODE = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", re.S | re.I)
_HTML_ITEM = re.compile(r"<li\b[^<>]*>(.*?)(?=</li\s*>|<li\b|</[uo]l\s*>|\Z)(?:</li\s*>)?", re.S | re.I)
_HTML_ROW = re.compile(r"<tr\b[^<>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|(?=</table)|\Z)", re.S | re.I)


def parse(text: str | None) -> list[Node]:
    """The blocks of a text."""
    if not text:
        return []
    if "&lt;" in text and TAG.search(once := html.unescape(text)) and len(TAG.findall(once)) > len(TAG.findall(text)):
        nodes = parse(once)
        for n in nodes[:1]:
            n.marks.add("html")
        return nodes
    whole: set = set()
    if "<" in text:
        if HIDDEN.search(text):
            whole.add("html")
            text = HIDDEN.sub(" ", text)
        # HTML blocks become lines that the line parser below knows; \x01 marks their language
        new = _HTML_CODE.sub(lambda m: "\n\x01code\n" + html.unescape(TAG.sub("", m[1])) + "\n\x01end\n", text)
        new = _HTML_HEAD.sub(lambda m: f"\n\x01head{m[1]} " + m[2].replace("\n", " ") + "\n", new)
        new = _HTML_ITEM.sub(lambda m: "\n\x01item " + m[1].replace("\n", " ") + "\n", new)
        new = _HTML_ROW.sub(lambda m: "\n\x01row " + m[1].replace("\n", " ") + "\n", new)
        if new != text:
            whole.add("html")
        text = new
    nodes: list[Node] = []
    para: list[str] = []

    def close() -> None:
        if para:
            n = Node("para")
            n.text = re.sub(r"[ \t]+", " ", _inline("\n".join(para), n.marks)).strip()
            nodes.append(n)
            para.clear()

    def add(kind: str, raw: str, level: int = 0, marks: tuple = (), inline: bool = True) -> None:
        close()
        n = Node(kind, level=level, marks=set(marks))
        n.text = re.sub(r"[ \t]*\s+", " ", _inline(raw, n.marks)).strip() if inline else raw
        nodes.append(n)

    lines = text.split("\n")
    i, in_table, fence, env = 0, False, None, None
    held: list[str] = []
    while i < len(lines):
        line = lines[i].rstrip("\r")
        i += 1
        if fence:
            if (fence == "\x01" and line == "\x01end") or (fence != "\x01" and line.strip().startswith(fence) and not line.strip().strip("`~")):
                add("code", "\n".join(held), marks=("html",) if fence == "\x01" else ("markdown",), inline=False)
                fence, held = None, []
            else:
                held.append(line)
            continue
        if env:
            m = ENV.search(line)
            if m and m[1] == "end" and m[2] == env:
                held.append(line[: m.start()])
                add("code" if env in CODE_ENVS else "formula", "\n".join(held).strip("\n"), marks=("latex",), inline=False)
                lines_rest = line[m.end() :]
                env, held = None, []
                if lines_rest.strip():
                    i -= 1
                    lines[i] = lines_rest
            else:
                held.append(line)
            continue
        if line == "\x01code":
            close()
            fence, held = "\x01", []
            continue
        if line.startswith("\x01head"):
            add("heading", line[7:], int(line[5]), ("html",))
            continue
        if line.startswith("\x01item "):
            add("item", line[6:], 1, ("html",))
            continue
        if line.startswith("\x01row "):
            add("row", re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", "\t", line[5:]), 0, ("html",))
            continue
        m = FENCE.match(line)
        if m:
            close()
            fence, held = m[1][:3], []
            whole.add("markdown")
            continue
        if "\\" in line:
            m = ENV.search(line)
            if m:
                if line[: m.start()].strip():
                    para.append(line[: m.start()])
                close()
                whole.add("latex")
                rest = line[m.end() :]
                if m[1] == "begin" and (m[2] in CODE_ENVS or m[2] in MATH_ENVS):
                    env, held = m[2], []
                if rest.strip():
                    i -= 1
                    lines[i] = rest
                continue
            m = SECTIONING.match(line)
            if m:
                add("heading", m[2], LEVEL[m[1]], ("latex",))
                if line[m.end() :].strip():
                    para.append(line[m.end() :])
                continue
            m = re.match(r"^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", line)
            if m:
                add("item", line[m.end() :], 1, ("latex",))
                continue
        s = line.strip()
        if s.startswith("{|") or in_table:
            whole.add("wiki")
            close()
            in_table = s != "|}" and not s.startswith("|}")
            if s[:1] in "|!" and s[:2] not in ("|-", "|}", "|+"):
                add("row", re.sub(r"\s*(?:\|\||!!)\s*", "\t", s[1:]), 0, ("wiki",))
            continue
        if s == "|}":
            whole.add("wiki")
            continue
        m = WIKI_HEAD.match(line)
        if m:
            add("heading", m[2], len(m[1]), ("wiki",))
            continue
        m = REDIRECT.match(line)
        if m:
            add("para", line[m.end() :], 0, ("wiki",))
            continue
        m = ATX.match(line)
        if m:
            add("heading", m[2], len(m[1]), ("markdown",))
            continue
        if SETEXT.match(line):
            if len(para) and para[-1].strip() and not BULLET.match(para[-1]):
                title = para.pop()
                add("heading", title, 1 if s[0] == "=" else 2, ("markdown",))
            else:
                close()
                if s[0] == "=":
                    para.append(line)
            continue
        if PIPE_RULE.match(line):
            whole.add("markdown")
            close()
            continue
        if PIPE_ROW.match(line):
            add("row", "\t".join(c.strip() for c in s.strip("|").split("|")), 0, ("markdown",))
            continue
        m = QUOTE.match(line)
        if m:
            add("quote", line[m.end() :], 0, ("markdown",))
            continue
        m = BULLET.match(line)
        if m:
            add("item", line[m.end() :], 1 + len(m[1].expandtabs(4)) // 2)
            continue
        if not s:
            close()
            continue
        para.append(line)
    if fence or env:
        add("code" if fence or env in CODE_ENVS else "formula", "\n".join(held), marks=("html",) if fence == "\x01" else ("markdown",) if fence else ("latex",), inline=False)
    close()
    if whole:
        if not nodes:
            nodes.append(Node("para"))
        nodes[0].marks |= whole
    return nodes


def kinds(text: str | None) -> list[str]:
    return sorted({k for n in parse(text) for k in n.marks})


def render(nodes: list[Node]) -> str:
    """Clean text: headings on lines of their own, items with a dash, code and formulas indented."""
    out = []
    for n in nodes:
        if not n.text:
            continue
        if n.kind == "item":
            out.append("  " * max(0, n.level - 1) + "- " + n.text)
        elif n.kind in ("code", "formula"):
            out.append("\n".join("    " + x for x in n.text.split("\n")))
        else:
            out.append(n.text)
    text, prev = "", None
    for n, t in zip([n for n in nodes if n.text], out):
        tight = prev is not None and prev == n.kind and n.kind in ("item", "row", "quote")
        text += ("" if prev is None else "\n" if tight else "\n\n") + t
        prev = n.kind
    return text


def markup_found(texts: DataFrame) -> DataFrame:
    """(doc_id, sec_no, markup) for texts of columns doc_id, sec_no, text; rows delivered twice count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, k) for d, s, t in zip(b["doc_id"], b["sec_no"], b["text"]) for k in kinds(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "sec_no", "markup"])

    signed = F.col("text").rlike(SIGNS)  # every construct above has one of these signs
    rows = spread(texts.select("doc_id", "sec_no", "text").filter(signed))
    return rows.mapInPandas(run, "doc_id string, sec_no int, markup string").distinct()


Tree = tuple[str, str, list]
_PAIR = 1 << 32


def block_tree(nodes: list[Node]) -> Tree:
    """The blocks of a text as a tree (label, text, children): what follows a heading stands below it."""
    root: Tree = ("page", "", [])
    open_: list[tuple[int, Tree]] = [(0, root)]
    for n in nodes:
        node: Tree = (f"{n.kind}{n.level}" if n.kind == "heading" else n.kind, n.text, [])
        if n.kind == "heading":
            while open_[-1][0] >= n.level:
                open_.pop()
            open_[-1][1][2].append(node)
            open_.append((n.level, node))
        else:
            open_[-1][1][2].append(node)
    return root


def _sibling_match(m: list[Tree], n: list[Tree], trace: bool = False) -> tuple[int, np.ndarray | None]:
    """Worth of the best order-preserving match of two lists of siblings, and, if asked for, the step taken at each cell.

    Worth is the number of pairs times _PAIR and the number of pairs of equal text. One
    row of the table is kept, and of the steps one byte a cell, so that long pages fit.
    """
    labels = {x[0]: i for i, x in enumerate(m)}
    told = {x[1]: i for i, x in enumerate(m)}
    label = np.fromiter((labels.get(y[0], -1) for y in n), "i8", len(n))
    said = np.fromiter((told.get(y[1], -1) for y in n), "i8", len(n))
    inner = [j for j, y in enumerate(n) if y[2]]
    steps = np.empty((len(m), len(n)), "u1") if trace else None
    best = np.zeros(len(n) + 1, "i8")
    for i, x in enumerate(m):
        worth = (label == labels[x[0]]) * (_PAIR + (said == told[x[1]]))
        if x[2]:
            for j in inner:
                if n[j][0] == x[0]:
                    worth[j] += _sibling_match(x[2], n[j][2])[0]
        row = np.zeros(len(n) + 1, "i8")
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + worth), out=row[1:])
        if trace:
            steps[i] = np.where(row[1:] == best[1:], 0, np.where(row[1:] == row[:-1], 1, 2))
        best = row
    return int(best[-1]), steps


def tree_match(a: Tree, b: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    """Simple tree matching: size of the greatest order-preserving match of two trees of equal roots, and its pairs of nodes.

    Of matches of one size that with more equal texts is taken.
    """
    if a[0] != b[0]:
        return 0, []
    m, n = a[2], b[2]
    pairs, i, j = [(a, b)], len(m), len(n)
    steps = _sibling_match(m, n, True)[1] if m and n else None
    while i and j:
        step = steps[i - 1, j - 1]
        if step == 2:
            pairs += tree_match(m[i - 1], n[j - 1])[1]
        i, j = i - (step != 1), j - (step != 0)
    return len(pairs), pairs


def _paths(tree: Tree, above: str = "") -> Iterator[tuple[str, Tree]]:
    for child in tree[2]:
        path = f"{above}/{child[0]}"
        yield path, child
        yield from _paths(child, path)


def _key(path: str, text: str) -> bytes:
    return blake2b(f"{path}\0{text}".encode(), digest_size=16).digest()


def _page_keys(nodes: list[Node]) -> set[bytes]:
    return {_key(path, node[1]) for path, node in _paths(block_tree(nodes)) if node[1]}


def _no_templates(texts: DataFrame, host: str) -> DataFrame:
    return texts.select(F.col(host), F.lit("").alias("path"), F.lit("").alias("text")).limit(0)


def page_templates(texts: DataFrame, host: str, least_pages: int = 5, least_share: float = 0.6, align_pages: int = 2000) -> DataFrame:
    """(host, path, text): the constant nodes of each host's pages.

    All pages of a host count, of any length; hosts with fewer than least_pages have no
    template. Only what stands on least_share of the pages can be constant, so nodes are
    counted first. The page that shares most such nodes with the others is the wrapper,
    the shortest if there are several; a node that it lacks has the best page with that
    node as its wrapper. All pages are aligned with the wrappers of their host by tree
    matching, and a node whose aligned nodes bear its text on least_share of the pages
    is template, the others are slots of content. Columns: host and text.

    A host is no group anywhere: nodes are counted before they are shuffled, and its pages
    are aligned in parts of about align_pages, each beginning with the wrappers.
    """
    h = f"h {texts.schema[host].dataType.simpleString()}"
    pages = texts.select(F.col(host).alias("h"), "text", F.md5("text").alias("page")).filter("h IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for at, t in zip(b["h"], b["text"]):
                if nodes := parse(t):
                    seen.update((at, k) for k in _page_keys(nodes) | {b""})  # the empty key counts pages
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["h", "key", "n"])

    counts = pages.select("h", "text").mapInPandas(count, f"{h}, key binary, n long").groupBy("h", "key").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter(F.col("n") >= least_share * least_pages))
    of_host = counts.filter("key = X''").select("h", F.col("n").alias("pages")).filter(F.col("pages") >= least_pages)
    shared = counts.filter("key <> X''").join(of_host, "h").filter(F.col("n") >= least_share * F.col("pages"))
    hosts = shared.groupBy("h").agg(F.first("pages").alias("pages"), F.collect_list(F.struct("key", "n")).alias("shared"))
    if hosts.isEmpty():
        return _no_templates(texts, host)
    hosts = broadcast_if_small(cut(hosts), 10_000)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for at, page, t, s in zip(b["h"], b["page"], b["text"], b["shared"]):
                nodes, n = parse(t), {x["key"]: x["n"] for x in s}
                here = sorted(_page_keys(nodes) & n.keys())
                rows += [(at, page, k, sum(n[x] for x in here), -len(nodes)) for k in here]
            yield pd.DataFrame(rows, columns=["h", "page", "key", "score", "short"])

    ranked = pages.join(hosts, "h").select("h", "page", "text", "shared").mapInPandas(rank, f"{h}, page string, key binary, score long, short long")
    chosen = ranked.groupBy("h", "key").agg(F.max(F.struct("score", "short", "page")).alias("w")).groupBy("h", F.col("w.page").alias("page")).agg(F.collect_list("key").alias("keys"))
    parts = F.ceil(F.col("pages") / align_pages).cast("long")
    wrappers = pages.join(broadcast_if_small(cut(chosen), 10_000), ["h", "page"]).groupBy("h", "page").agg(F.first("text").alias("text"), F.first("keys").alias("keys"))
    first = wrappers.join(hosts, "h").select("h", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("turn"), "page", "text", "keys")
    then = pages.join(hosts, "h").select("h", F.pmod(F.xxhash64("page"), parts).alias("part"), F.lit(1).alias("turn"), "page", "text", F.lit(None).cast("array<binary>").alias("keys"))
    rows = first.unionByName(then).repartition(tasks(texts), "h", "part").sortWithinPartitions("h", "part", "turn", "page")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known, last, equal = None, [], None, []
        for b in batches:
            constant: Counter = Counter()
            for h_, part, turn, page, t, keys in zip(b["h"], b["part"], b["turn"], b["page"], b["text"], b["keys"]):
                if (h_, part) != at:
                    at, known, last = (h_, part), [], None
                if turn == 0:
                    tree, asked = block_tree(parse(t)), set(keys)
                    nodes = [(path, node) for path, node in _paths(tree) if node[1] and _key(path, node[1]) in asked]
                    known.append((tree, {id(node): (h_, page, i, path, node[1]) for i, (path, node) in enumerate(nodes)}))
                    continue
                if page != last:  # pages of one text follow each other
                    tree = block_tree(parse(t))
                    last, equal = page, [nodes[id(x)] for w, nodes in known for x, y in tree_match(w, tree)[1] if id(x) in nodes and x[1] == y[1]]
                constant.update(equal)
            yield pd.DataFrame([(*k, n) for k, n in constant.items()], columns=["h", "page", "i", "path", "text", "n"])

    aligned = rows.mapInPandas(align, f"{h}, page string, i int, path string, text string, n long").groupBy("h", "page", "i", "path", "text").agg(F.sum("n").alias("n"))
    return cut(aligned.join(hosts, "h").filter(F.col("n") >= least_share * F.col("pages")).select(F.col("h").alias(host), "path", "text").distinct())


def without_template(nodes: list[Node], template: set[tuple[str, str]]) -> list[Node]:
    """The blocks that are no template of their host; a heading goes only if nothing but template stands below it."""
    if not template:
        return nodes
    kept: set[int] = set()
    open_: list[tuple[int, str]] = [(0, "")]
    for i, n in enumerate(nodes):
        if n.kind == "heading":
            while open_[-1][0] >= n.level:
                open_.pop()
        path = f"{open_[-1][1]}/" + (f"{n.kind}{n.level}" if n.kind == "heading" else n.kind)
        if n.kind == "heading":
            open_.append((n.level, path))
        if (path, n.text) not in template:
            kept.add(i)
    for i in range(len(nodes) - 1, -1, -1):
        if i not in kept and nodes[i].kind == "heading":
            below = i + 1
            while below < len(nodes) and not (nodes[below].kind == "heading" and nodes[below].level <= nodes[i].level):
                if below in kept:
                    kept.add(i)
                    break
                below += 1
    return [n for i, n in enumerate(nodes) if i in kept]


def clean_texts(texts: DataFrame, host: str | None = None) -> DataFrame:
    """(doc_id, sec_no, clean, blocks): the clean text and its blocks, one row for each row.

    With a column of hosts, what is constant on the pages of a host is left out.
    """
    rows = texts.select("doc_id", "sec_no", "text", *([F.col(host).alias("h")] if host else []))
    if host:
        template = page_templates(texts, host).groupBy(F.col(host).alias("h")).agg(F.collect_list(F.array("path", "text")).alias("template"))
        rows = rows.join(broadcast_if_small(template, 10_000), "h", "left")
    else:
        rows = rows.withColumn("template", F.lit(None).cast("array<array<string>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [without_template(parse(t), set() if k is None else {tuple(x) for x in k}) for t, k in zip(b["text"], b["template"])]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "sec_no": b["sec_no"],
                "clean": [None if t is None else render(p) for t, p in zip(b["text"], parsed)],
                "blocks": [[{"kind": n.kind, "level": n.level, "text": n.text} for n in p] for p in parsed],
            })

    return spread(rows.select("doc_id", "sec_no", "text", "template")).mapInPandas(
        run, "doc_id string, sec_no int, clean string, blocks array<struct<kind:string,level:int,text:string>>"
    )
