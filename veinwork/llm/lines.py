"""Classifiers of pairs of lines on scanned pages: furniture, and words that go on.

Both are boosted trees fitted on pages made here from texts that were not scanned: the
texts are wrapped at random widths with words broken at their ends, running headers,
page numbers and stray figures are put at the page ends, and some signs are damaged. A
line is judged by its neighbour in the text (would the next word have fitted, is there a
blank between) and by the lines at the same place of the document's other pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np

from veinwork.llm.boosting import Boosted

HYPHENS = "-¬=‐‑­"
# Words after which, or before which, an open prefix is left as it is.
OPEN_PREFIX = {"and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "e", "o", "u"}
STRIP = ".,;:!?\"“”„()[]«»…。，、；：！？'’‘—–"
_STOPS = ".,;!?。！？；，"
_ROMAN = re.compile(r"(?:x{0,3})(?:ix|iv|v?i{0,3})|[xl]{1,4}(?:ix|iv|v?i{0,3})", re.I)
_PAGE_NO = re.compile(r"^\W*(?:(?:page|p\.|pp\.|seite|s\.|página|pág\.|pag\.|第)\s*)?([0-9lIiOoSsBZz]{1,5})(?:\s*(?:/|of|von|de|sur|页)\s*[0-9lIiOoSsBZz]{0,5})?\W*$", re.I)
_DIGIT_LIKE = str.maketrans("lIiOoSsBZz", "1110055822")
_DECIMAL = re.compile(r"^\W*\d+[.,]\d+\W*$")
_EDGE_NO = re.compile(r"(?:^([0-9lIO]{1,4})\s{2,}(?=\S))|(?:(?<=\S)\s{2,}([0-9lIO]{1,4})\s*$)")
_NUMBERS_ONLY = re.compile(r"^[\s\d.,;:%()\[\]+–—-]+$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def number_of(line: str) -> int | None:
    """The number that a line of nothing but a page number holds."""
    t = line.strip()
    if not t or len(t) > 16 or t[0] == "(" or _DECIMAL.match(t):
        return None
    core = re.sub(r"[\W_]+", "", re.sub(r"(?i)^\W*(?:page|seite|página|p|s)\b\.?", "", t))
    m = _PAGE_NO.match(t)
    if m and (any(c.isdigit() for c in m[1]) or (set(m[1]) <= set("lIO") and t != m[1])):
        return int(m[1].translate(_DIGIT_LIKE)) if m[1].translate(_DIGIT_LIKE).isdigit() else None
    if core and _ROMAN.fullmatch(core) and len(core) <= 7:
        value = {"i": 1, "v": 5, "x": 10, "l": 50}
        nums = [value[c] for c in core.lower()]
        return sum(-a if a < b else a for a, b in zip(nums, [*nums[1:], 0]))
    return None


def header_key(line: str) -> str:
    """The letters of a line in lower case."""
    return "".join(re.findall(r"[^\W\d_]", line.lower()))


def similar(a: str, b: str, least: float = 0.8) -> bool:
    if not a or not b or abs(len(a) - len(b)) > 0.3 * max(len(a), len(b)):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


def edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Line numbers of the first two and the last two lines that aren't blank, the outermost first."""
    filled = [i for i, l in enumerate(lines) if l.strip()]
    return filled[:2], [i for i in reversed(filled[-2:]) if i not in filled[:2]]


def edge_rows(text: str) -> list[tuple[str, int | None]]:
    """(header key, page number) of each line at a page's ends; lines with a page number have no key."""
    lines = text.split("\n")
    out = []
    for idx in edges(lines):
        for i in idx:
            n, key = number_of(lines[i]), header_key(lines[i])
            if n is not None:
                out.append(("", n))
            elif len(key) >= 3 and lines[i].strip()[-1] not in _STOPS:
                out.append((key, None))
    return out


def hyphen_at(line: str) -> str | None:
    """The part of a word before a hyphen at the end of a line."""
    t = line.rstrip()
    if len(t) < 2 or t[-1] not in HYPHENS or not t[-2].isalpha():
        return None
    return t.split()[-1][:-1]


def lexical(word: str) -> str:
    return word.strip(STRIP).lower()


def _first_word(line: str) -> str:
    return line.split()[0]


def _of_page(lines: list[str]) -> tuple[int, float]:
    """Widest line, and the share of lines that have less room than a short word."""
    lengths = [len(l.strip()) for l in lines if l.strip()]
    width = max(lengths, default=1)
    return width, sum(n >= width - 8 for n in lengths) / max(1, len(lengths))


def furniture_features(lines: list[str], i: int, pos: int, top: bool, outer: bool, known: bool, in_sequence: bool, numbered: bool, page: tuple[int, float]) -> list[float]:
    """What tells a running header, footer or page number from a line of the text.

    outer: the line further out is furniture; known: equal or similar lines stand at the
    ends of other pages; in_sequence: its number counts along with the pages; numbered:
    such numbers are found in the document.
    """
    t = lines[i].strip()
    width, full = page
    words = t.split()
    letters = [c for c in t if c.isalpha()]
    inner = next((lines[j] for j in (range(i + 1, len(lines)) if top else range(i - 1, -1, -1)) if lines[j].strip()), "")
    beside = lines[i + 1] if top and i + 1 < len(lines) else lines[i - 1] if not top and i else ""
    upper_line, lower_line = (t, inner.strip()) if top else (inner.strip(), t)
    slack = width - len(upper_line) - 1 - len(_first_word(lower_line)) if lower_line else width  # room left for the next word
    n = number_of(t)
    last, first = (words[-1].strip(STRIP + "[]-–—"), words[0].strip(STRIP + "[]-–—")) if words else ("", "")
    caps = sum(c.isupper() for c in letters) / max(1, len(letters))
    title = sum(w[:1].isupper() for w in words) / max(1, len(words))
    return [
        float(pos), float(top), float(outer), float(known), float(n is not None), float(in_sequence), float(numbered),
        float(bool(t) and t[-1] in _STOPS), float(hyphen_at(t) is not None), float(t[:1].isupper()), caps, title,
        len(t) / max(1, width), max(-10, min(40, slack)), float(not beside.strip()), min(len(words), 15), min(len(header_key(t)), 60),
        float(bool(_CJK.search(t))), float(any(s in t for s in (" · ", " | ", " / ", " – ", " /  "))),
        float(last.translate(_DIGIT_LIKE).isdigit() and len(words) > 1), float(first.translate(_DIGIT_LIKE).isdigit() and len(words) > 1),
        float(lower_line[:1].islower()), float(_NUMBERS_ONLY.match(t) is not None), float(bool(inner) and bool(_NUMBERS_ONLY.match(inner.strip()))),
        float(upper_line[-1:] in ".!?:。！？"), full,
        float(n is not None and 1900 <= n <= 2100), min(n, 999) if n is not None else -1.0, float(any(not c.isalnum() for c in t)),
    ]


def join_features(line: str, after: str, whole: bool, dashed: bool, part_known: bool, rest_known: bool, width: int, blanks: bool, next_page: bool) -> list[float]:
    """What tells a word that goes on in the next body line from one that ends with its hyphen."""
    part, rest, sign = lexical(hyphen_at(line) or ""), lexical(after), line.rstrip()[-1:]
    return [
        float(sign == "-"), float(sign in "­‐‑"), float(line != line.rstrip()), float(after[:1].islower()), float(after[:1].isupper()), float(after[:1].isalpha()),
        float(rest in OPEN_PREFIX), float(whole), float(dashed), float(part_known), float(rest_known), min(len(part), 12), min(len(rest), 12),
        len(line.rstrip()) / max(1, width), float(blanks), float(next_page),
    ]


@dataclass
class LineModel:
    """The two classifiers; without training texts both follow the hyphen and the number sequence alone."""

    furniture: Boosted
    joins: Boosted
    words: frozenset

    def goes_on(self, line: str, after: str | None, width: int, blanks: bool, next_page: bool) -> bool:
        part = hyphen_at(line)
        if part is None or not after or not after[0].isalpha():
            return False
        p, w = lexical(part), lexical(after)
        if not self.joins.trees:
            return w not in OPEN_PREFIX
        x = join_features(line, after, p + w in self.words, f"{p}-{w}" in self.words, p in self.words, w in self.words, width, blanks, next_page)
        return self.joins.predict_one(x) >= 0.5

    def kinds(self, text: str, known: list[str], offsets: list[int], numbered: bool, sec_no: int) -> list[str]:
        """Class of each line: blank, header, number, header+number, figures or body.

        known are the keys that recur at the ends of the document's pages, offsets the
        differences of page number and sec_no that do.
        """
        lines = text.split("\n")
        page = _of_page(lines)
        out = ["blank" if not l.strip() else "figures" if _NUMBERS_ONLY.match(l) else "body" for l in lines]
        for top, idx in zip((True, False), edges(lines)):
            outer = False
            for pos, i in enumerate(idx):
                if pos and not outer:
                    break  # the second line counts only beside furniture
                n, key = number_of(lines[i]), header_key(lines[i])
                recurs = n is None and len(key) >= 3 and any(similar(key, k) for k in known)
                sequence = n is not None and n - sec_no in offsets
                if self.furniture.trees:
                    x = furniture_features(lines, i, pos, top, outer, recurs, sequence, numbered, page)
                    outer = self.furniture.predict_one(x) >= 0.5
                else:
                    outer = recurs or sequence
                if outer:
                    out[i] = "number" if n is not None else "header+number" if _EDGE_NO.search(lines[i]) else "header"
        return out


#: Forms in which a page number is printed, {} standing for it.
NUMBER_FORMS = ["{}", "[{}]", "- {} -", "– {} –", "— {} —", "Page {}", "page {}", "p. {}", "{} / 40", "Seite {}", "{}."]
_LOOKS = [("0", "O"), ("1", "l"), ("1", "I"), ("5", "S"), ("a", "o"), ("e", "c"), ("i", "1"), ("l", "1"), ("n", "'"), ("m", "rn"), ("o", "0"), ("s", "5")]


def _roman(n: int) -> str:
    out = ""
    for v, s in ((50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def _spoilt(text: str, rng: np.random.Generator) -> str:
    hits = [(a, b, m.start()) for a, b in _LOOKS for m in re.finditer(re.escape(a), text)]
    if not hits:
        return text
    a, b, at = hits[rng.integers(len(hits))]
    return text[:at] + b + text[at + len(a) :]


def _wrapped(words: list[str], width: int, rng: np.random.Generator) -> list[tuple[str, int]]:
    """(line, 1 where its last word goes on, 0 where a hyphen is left open, else -1)."""
    out: list[tuple[str, int]] = []
    line, queue = "", list(reversed(words))
    sign = "-" if rng.random() < 0.5 else HYPHENS[rng.integers(len(HYPHENS))]
    while queue:
        w = queue.pop()
        if not line:
            line = w
        elif len(line) + 1 + len(w) <= width:
            line += " " + w
        else:
            left = width - len(line) - 2
            at = w.find("-")
            if 0 < at <= left and at + 1 < len(w):
                out.append((line + " " + w[: at + 1], 1))
                line = w[at + 1 :]
            elif left >= 2 and len(w) >= 5 and w.strip(STRIP).isalpha() and rng.random() < 0.6:
                cut = int(rng.integers(2, min(left, len(w) - 2) + 1))
                out.append((line + " " + w[:cut] + sign + (" " if rng.random() < 0.15 else ""), 1))
                line = w[cut:]
            else:
                out.append((line, 0 if hyphen_at(line) is not None else -1))
                line = w
    if line:
        out.append((line, -1))
    return out


def _with_open_prefixes(words: list[str], compounds: list[str], rng: np.random.Generator) -> list[str]:
    """Some places of the text get a pair as in 'short- and long-term'."""
    if len(compounds) < 2:
        return words
    out = []
    for w in words:
        if rng.random() < 0.06:
            a, b = compounds[rng.integers(len(compounds))], compounds[rng.integers(len(compounds))]
            out += [a.split("-")[0] + "-", sorted(OPEN_PREFIX)[rng.integers(len(OPEN_PREFIX))], b]
        out.append(w)
    return out


def _made_head(names: list[str], rng: np.random.Generator) -> str:
    picked = [names[rng.integers(len(names))] for _ in range(int(rng.integers(1, 7)))]
    head, style = " ".join(picked), rng.integers(6)
    if style == 0:
        return head.upper()
    if style == 1:
        return head.title()
    if style == 2:
        return head.capitalize()
    if style == 3:
        return f"{head.title()}, No. {rng.integers(1, 300)}"
    if style == 4:
        return f"{picked[0].upper()} / {head.title()}, No. {rng.integers(1, 300)}"
    return f"{picked[0].title()} · {head.capitalize()}"


def made_documents(texts: list[str], rng: np.random.Generator) -> Iterator[list[tuple[list[str], dict[int, str], dict[int, int]]]]:
    """Documents of pages (lines, furniture by line, whether a hyphenated line goes on) from plain texts."""
    plain = [[w for w in t.split() if any(c.isalnum() for c in w) or w in "—–"] for t in texts]
    compounds = sorted({w.strip(STRIP) for ws in plain for w in ws if re.fullmatch(r"[^\W\d_]{2,}-[^\W\d_]{2,}", w.strip(STRIP))}) or ["short-term", "long-term"]
    names = sorted({w.strip(STRIP) for ws in plain for w in ws if len(w) > 3 and w.strip(STRIP).isalpha()})
    if len(names) < 10:
        return
    at = 0
    while at < len(plain):
        width, n_lines = int(rng.integers(40, 72)), int(rng.integers(14, 34))
        words: list[str] = []
        most = int(rng.choice([100, 200, 350, 600, 1200, 2400]))  # documents of one page and of many
        while at < len(plain) and len(words) < most:
            words += [*plain[at], "\n"]
            at += 1
        if len(words) < 30:
            continue
        paras, para = [], []
        for w in _with_open_prefixes(words, compounds, rng):
            if w == "\n" or (w[-1:] in ".!?" and rng.random() < 0.15):
                if w != "\n":
                    para.append(w)
                if para:
                    paras.append(para)
                para = []
            else:
                para.append(w)
        if para:
            paras.append(para)
        body: list[tuple[str, int]] = []
        for k, p in enumerate(paras):
            body += ([("", -1)] if k else []) + _wrapped(p, width, rng)
        heads = [_made_head(names, rng)]
        heads.append(_made_head(names, rng) if rng.random() < 0.4 else heads[0])  # left and right pages may differ
        with_head, form = rng.random() < 0.8, None if rng.random() < 0.25 else NUMBER_FORMS[rng.integers(len(NUMBER_FORMS))] if rng.random() < 0.6 else "{}"
        roman, start, in_head = rng.random() < 0.2, int(rng.integers(0, 400)) if rng.random() < 0.6 else 0, rng.random() < 0.2
        head_top, no_top, gap_share = rng.random() < 0.75, rng.random() < 0.25, rng.random()
        doc, k, no = [], 0, 0
        while k < len(body) and no < 12:
            chunk, k, no = body[k : k + n_lines], k + n_lines, no + 1
            lines, marks, on = [_spoilt(l, rng) if g < 0 and rng.random() < 0.15 else l for l, g in chunk], {}, {i: g for i, (_, g) in enumerate(chunk) if g >= 0}
            if not any(l.strip() for l in lines):
                continue
            if rng.random() < 0.12:  # the rest of a table at the end of the page
                extra = [str(rng.integers(1900, 2025)) if rng.random() < 0.5 else f"({rng.integers(1, 30)})" for _ in range(int(rng.integers(1, 4)))]
                lines += extra if rng.random() < 0.5 else [*extra, " ".join(names[rng.integers(len(names))] for _ in range(6)).capitalize() + "."]
            number = _roman(max(1, min(80, (start + no) % 80))) if roman else str(start + no)
            furniture: list[tuple[str, bool, str]] = []
            if with_head and rng.random() < 0.85:
                head = heads[no % 2]
                h = f"{number}   {head}" if in_head and no % 2 else f"{head}   {number}" if in_head else head
                furniture.append((_spoilt(h, rng) if rng.random() < 0.2 else h, head_top, "header"))
            if form and not in_head and rng.random() < 0.9:
                f = form.format(number)
                furniture.append((_spoilt(f, rng) if rng.random() < 0.06 else f, no_top, "number"))
            if rng.random() < 0.5:
                furniture.reverse()  # either may stand further out
            for text, top, kind in furniture:
                gap = [""] if rng.random() < gap_share else []
                if top:
                    shift = 1 + len(gap)
                    lines, marks, on = [text, *gap, *lines], {0: kind, **{i + shift: v for i, v in marks.items()}}, {i + shift: v for i, v in on.items()}
                else:
                    lines = [*lines, *gap, text]
                    marks[len(lines) - 1] = kind
            doc.append((lines, marks, on))
        if doc:
            yield doc


def train_lines(texts: list[str], common: list[str], seed: int = 11, layouts: int = 3) -> LineModel:
    """Both classifiers from texts that were not scanned, laid out several times; common are frequent words of the corpus."""
    rng = np.random.default_rng(seed)
    words = frozenset(common)
    fx, fy, jx, jy = [], [], [], []
    for doc in (d for _ in range(layouts) for d in made_documents([texts[k] for k in rng.permutation(len(texts))], rng)):
        keys: Counter = Counter()
        offsets: Counter = Counter()
        for no, (lines, _, _) in enumerate(doc, 1):
            for key, n in edge_rows("\n".join(lines)):
                if n is None:
                    keys[key] += 1
                else:
                    offsets[n - no] += 1
        recurring, numbered = [k for k, n in keys.items() if n >= 2], sum(offsets.values()) >= 2
        for no, (lines, marks, on) in enumerate(doc, 1):
            page = _of_page(lines)
            for top, idx in zip((True, False), edges(lines)):
                outer = False
                for pos, i in enumerate(idx):
                    if pos and not outer:
                        break
                    n, key = number_of(lines[i]), header_key(lines[i])
                    recurs = n is None and len(key) >= 3 and any(similar(key, k) for k in recurring)
                    fx.append(furniture_features(lines, i, pos, top, outer, recurs, n is not None and offsets[n - no] >= 2, numbered, page))
                    outer = i in marks
                    fy.append(float(outer))
            body = [i for i, l in enumerate(lines) if l.strip() and i not in marks]
            for i, goes in on.items():
                at = body.index(i) if i in body else -1
                if at < 0 or hyphen_at(lines[i]) is None:
                    continue
                if at + 1 < len(body):
                    after, blanks, far = lines[body[at + 1]], body[at + 1] > i + 1, False
                elif no < len(doc):
                    rest, own = doc[no][0], doc[no][1]
                    after, blanks, far = next((l for k, l in enumerate(rest) if l.strip() and k not in own), ""), False, True
                else:
                    continue
                if not after.strip() or not after.split()[0][0].isalpha():
                    continue
                w, p = lexical(after.split()[0]), lexical(hyphen_at(lines[i]))
                jx.append(join_features(lines[i], after.split()[0], p + w in words, f"{p}-{w}" in words, p in words, w in words, page[0], blanks, far))
                jy.append(float(goes))
    models = [Boosted(rounds=120).fit(np.array(x), np.array(y)) if len(set(y)) == 2 and len(y) >= 60 else Boosted() for x, y in ((fx, fy), (jx, jy))]
    return LineModel(models[0], models[1], words)
