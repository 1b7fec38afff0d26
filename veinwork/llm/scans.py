"""Noise in text from scanned pages: where it is, and the text without it.

Words are counted over all sections. Each word is matched to its look-alikes by joining
inverted lists of character q-grams, of which only the rarest of each word are needed; a
gradient-boosted ranker, trained on common words damaged by typical recognition errors,
decides whether the word is a misreading and of what, also for words with odd signs or
blanks between their letters. Furniture and broken words are decided by the classifiers
of line pairs in lines.py, trained on pages made from texts that were not scanned.

Defined cases: a page without number counts as scanned if another page of its document
has one; null and blank texts hold no defects; sections delivered twice count once (the
longest text); the first and last page of a document have no neighbour on that side;
texts are read whole; scripts without blanks between words are not looked up; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.boosting import Boosted
from veinwork.llm.lines import STRIP as _STRIP
from veinwork.llm.lines import LineModel, edge_rows, edges, header_key, hyphen_at, lexical, similar, train_lines
from veinwork.session import broadcast_if_small, spread, tasks

# Typical confusions of character recognition, right form then misread form.
CONFUSIONS = [("a", "ɑ"), ("a", "o"), ("b", "6"), ("b", "h"), ("c", "¢"), ("c", "e"), ("d", "cl"), ("e", "c"), ("f", "t"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("g", "9"), ("g", "q"),
              ("h", "li"), ("h", "b"), ("i", "1"), ("i", "l"), ("i", "!"), ("k", "lc"), ("l", "1"), ("l", "I"), ("l", "i"), ("l", "|"), ("li", "h"), ("m", "rn"), ("m", "nn"), ("n", "ri"), ("n", "u"),
              ("o", "0"), ("o", "c"), ("q", "g"), ("r", "r."), ("ri", "n"), ("rn", "m"), ("s", "5"), ("s", "$"), ("t", "f"), ("t", "+"), ("t", "l"), ("ti", "ü"), ("tt", "ü"), ("u", "ii"), ("u", "n"), ("ii", "u"), ("v", "y"),
              ("w", "vv"), ("vv", "w"), ("cl", "d"), ("z", "2"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("é", "e"), ("ó", "o"), ("í", "i"), ("á", "a"), ("ñ", "n"), ("è", "e"), ("ê", "e"), ("ß", "B"), ("y", "v")]
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?=[.,;:!?)]*(?:\s|$))")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def confusion_cost(right: str, seen: str, most: float = 3.0) -> float:
    """Cost of reading right as seen: typical confusions are cheap, other edits cost one each."""
    n, m = len(right), len(seen)
    if abs(n - m) > 4:
        return 9.0
    rows = [[9.0] * (m + 1) for _ in range(n + 1)]
    rows[0][0] = 0.0
    for i in range(n + 1):
        lo, hi = max(0, i - 4), min(m, i + 4)
        for j in range(lo, hi + 1):
            c = rows[i][j]
            if c > most:
                continue
            if i < n and j < m:
                d = c if right[i] == seen[j] else c + 1.0
                if d < rows[i + 1][j + 1]:
                    rows[i + 1][j + 1] = d
            if i < n and c + 1 < rows[i + 1][j]:
                rows[i + 1][j] = c + 1
            if j < m and c + 1 < rows[i][j + 1]:
                rows[i][j + 1] = c + 1
            for x, y, cost in _STARTS.get(right[i] if i < n else "", ()):
                if right.startswith(x, i) and seen.startswith(y, j) and c + cost < rows[i + len(x)][j + len(y)]:
                    rows[i + len(x)][j + len(y)] = c + cost
            if j < m and seen[j] == "." and c + 0.3 < rows[i][j + 1]:
                rows[i][j + 1] = c + 0.3
    return min(9.0, rows[n][m])


_STARTS: dict[str, list[tuple[str, str, float]]] = defaultdict(list)
for _a, _b in CONFUSIONS:
    _STARTS[_a[0].lower()].append((_a.lower(), _b.lower(), 0.1))


def is_odd(word: str) -> bool:
    """Signs in a word that are no letters, letters no language here writes, or blanks between the letters."""
    return any(not c.isalpha() and c not in "'’-" for c in word) or any(ord(c) in (0x251, 0xFB01, 0xFB02) for c in word)


def features(seen: str, right: str, n_seen: int, n_right: int, shared: float) -> list[float]:
    spaced, seen = " " in seen, seen.replace(" ", "")
    cost = confusion_cost(right, seen)
    tail = seen.startswith(right) or right.startswith(seen)
    digits = sum(c.isdigit() for c in seen) / max(1, len(seen))
    return [cost, shared, np.log(n_right + 1.0), np.log((n_right + 1.0) / (n_seen + 1.0)), abs(len(seen) - len(right)), float(is_odd(seen)), float(tail), min(len(seen), 12), float(spaced), digits]


def damaged(word: str, rng: np.random.Generator) -> str | None:
    """The word with one typical recognition error."""
    if len(word) > 3 and rng.random() < 0.06:
        return " ".join(word)
    hits = [(a, b, m.start()) for a, b in CONFUSIONS for m in re.finditer(re.escape(a), word)]
    if not hits:
        return None
    a, b, at = hits[rng.integers(len(hits))]
    if rng.random() < 0.08:  # a sign that is like no letter
        at = int(rng.integers(len(word)))
        return word[:at] + "0123456789$+¢|"[rng.integers(14)] + word[at + 1 :]
    twice = rng.random() < 0.4  # some words are misread in every place where the sign stands
    return (word.replace(a, b) if twice else word[:at] + b + word[at + len(a) :]).lower()


def all_damaged(word: str) -> set[str]:
    """The word with each typical recognition error, in one place or everywhere."""
    out = set()
    for a, b in CONFUSIONS:
        hits = [m.start() for m in re.finditer(re.escape(a), word)]
        out |= {(word[:at] + b + word[at + len(a) :]).lower() for at in hits}
        if len(hits) > 1:
            out.add(word.replace(a, b).lower())
    return out - {word}


def without_lookalikes(common: list[tuple[str, int]], least_ratio: float) -> list[tuple[str, int]]:
    """The words that aren't a typical misreading of a word least_ratio times as frequent."""
    most: dict[str, int] = {}
    for w, n in common:
        for bad in all_damaged(w):
            most[bad] = max(n, most.get(bad, 0))
    return [(w, n) for w, n in common if most.get(w, 0) < least_ratio * n]


def train_ranker(common: list[tuple[str, int]], codes: list[tuple[str, int]], seed: int = 7, least_ratio: float = 8.0, far: float = 20.0) -> Boosted:
    """Ranker from common words: damaged copies are replaced by their source, whole words and codes by nothing.

    How often the rarer word of a pair stands is drawn in proportion to the other, so that
    the ranker is the same for a corpus many times as large.
    """

    def rarer(n: int, ratio: float) -> int:
        return max(1, int(n / ratio ** rng.uniform(1.0, max(1.0, np.log(max(n, 2)) / np.log(ratio)))))

    rng = np.random.default_rng(seed)
    xs, ys = [], []
    grams = {w: set(qgrams(w)) for w, _ in common}
    by_gram: dict[str, list[str]] = defaultdict(list)
    for w, _ in common:
        for g in grams[w]:
            by_gram[g].append(w)
    count = dict(common)

    def nearest(w: str, own: set[str], most: int) -> list[tuple[str, int]]:
        return Counter(v for g in own for v in by_gram[g] if v != w and abs(len(v) - len(w)) <= 3).most_common(most)

    for w, n in common:
        near = nearest(w, grams[w], 6)
        for v, k in near:  # two whole words, whatever their counts
            share = k / max(len(grams[v]), len(grams[w]))
            xs.append(features(w, v, rarer(count[v], least_ratio), count[v], share))
            ys.append(0.0)
        bad = damaged(w, rng)
        if bad and " " not in bad and rng.random() < 0.3:
            bad = damaged(bad, rng) or bad
        if bad and bad not in count and (len(w) > 2 or is_odd(bad)):
            g = set(qgrams(bad.replace(" ", "")))
            n_bad = rarer(n, 3.0 if is_odd(bad) else far)
            xs.append(features(bad, w, n_bad, n, len(g & grams[w]) / max(len(g), len(grams[w]))))
            ys.append(1.0)
            for v, _ in near[:3]:
                xs.append(features(bad, v, n_bad, count[v], len(g & grams[v]) / max(len(g), len(grams[v]))))
                ys.append(0.0)
    for w, n in codes:  # signs of letters and digits that stand for themselves
        g = set(qgrams(w))
        for v, k in nearest(w, g, 4):
            share = k / max(len(grams[v]), len(g))
            xs += [features(w, v, n, count[v], share), features(w, v, rarer(n, 3.0), count[v], share)]
            ys += [0.0, 0.0]
    if len(set(ys)) < 2:
        return Boosted()
    return Boosted(rounds=80).fit(np.array(xs), np.array(ys))


def qgrams(word: str, q: int = 2) -> list[str]:
    w = f"^{word}$"
    return sorted({w[i : i + q] for i in range(len(w) - q + 1)})


def _with_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(grams=[qgrams(w.replace(" ", "")) for w in b["word"]])


def corrections(
    counts: DataFrame, max_common: int = 4000, least_ratio: float = 8.0, least_share: float = 0.3, least_rate: float = 1e-5, far: float = 20.0, max_codes: int = 300, ranked_grams: int = 20_000
) -> tuple[DataFrame, list[str]]:
    """((word, right), common words): misread words with what they should be.

    counts has (word, n) over the whole corpus. The common words that train the ranker are
    a bounded list of words with at least least_rate of the corpus and no look-alike that
    is far more frequent; candidates are searched for every word among all words. The
    right word is least_ratio times as frequent, and far times where chance can't explain
    less; twice is enough for a word with odd signs.

    Two words that share least_share of the q-grams of the longer have one in common among
    the rarest of each (all but least_share of its own, in one order of all q-grams), so only
    these are joined. The order knows the counts of the ranked_grams most frequent q-grams;
    all rarer ones come before them, by themselves, which keeps it exact.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(20.0, least_rate * total)
    frequent = counts.filter((F.col("n") >= least) & F.col("word").rlike(r"^[\p{L}][\p{L}’'-]+$"))
    common = without_lookalikes([(r.word, r.n) for r in frequent.orderBy(F.desc("n"), "word").limit(max_common).collect()], far)
    signs = counts.filter((F.col("n") >= least) & F.col("word").rlike(r"^(?=.*\p{L})(?=.*[0-9])[\p{L}0-9]+$"))
    model = train_ranker(common, [(r.word, r.n) for r in signs.orderBy(F.desc("n"), "word").limit(max_codes).collect()], least_ratio=least_ratio, far=far) if common else Boosted()
    words = counts.filter(F.length("word") >= 2).select("word", "n").mapInPandas(_with_grams, "word string, n bigint, grams array<string>")
    ranked = words.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "gram").limit(ranked_grams).collect()
    order = {r.gram: i for i, r in enumerate(reversed(ranked), 1)}

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = []
            for w, gs in zip(b["word"], b["grams"]):
                g = sorted(gs, key=lambda x: (order.get(x, 0), x))
                kept.append(g[: len(g) - int(np.ceil(least_share * len(g) - 1e-9)) + 1])
            yield pd.DataFrame({"word": b["word"], "n": b["n"], "len": [len(w.replace(" ", "")) for w in b["word"]], "odd": [is_odd(w) for w in b["word"]], "grams": b["grams"], "rare": kept})

    listed = words.mapInPandas(rarest, "word string, n bigint, len int, odd boolean, grams array<string>, rare array<string>").persist(StorageLevel.MEMORY_AND_DISK)
    seen = listed.filter("len >= 3 OR odd").select(F.col("word").alias("seen"), F.col("n").alias("n_seen"), F.col("len").alias("len_seen"), "odd", F.explode("rare").alias("gram"))
    right = listed.filter("n >= 2 AND NOT odd").select(F.col("word").alias("right"), F.col("n").alias("n_right"), F.col("len").alias("len_right"), F.explode("rare").alias("gram"))
    enough = F.when(F.col("odd"), 2 * F.col("n_seen")).otherwise(F.greatest(least_ratio * F.col("n_seen"), far * (F.col("n_seen") - 2 * F.sqrt("n_seen"))))
    pairs = (
        seen.join(right, "gram")
        .filter((F.abs(F.col("len_seen") - F.col("len_right")) <= 3) & (F.col("n_right") >= enough))
        .filter(F.levenshtein(F.translate("seen", " ", ""), F.col("right"), 4) >= 0)
        .select("seen", "right", "n_seen", "n_right").distinct()
    )

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not model.trees:
                continue
            rows = []
            for s, r, ns, nr in zip(b["seen"], b["right"], b["n_seen"], b["n_right"]):
                gs, gr = qgrams(s.replace(" ", "")), qgrams(r)
                share = len(set(gs) & set(gr)) / max(len(gs), len(gr))
                if share >= least_share and (x := features(s, r, ns, nr, share))[0] < 3:
                    rows.append((s, r, x))
            if rows:
                p = model.predict(np.array([x for _, _, x in rows]))
                yield pd.DataFrame({"word": [s for s, _, _ in rows], "right": [r for _, r, _ in rows], "p": p})[p >= 0.5]

    best = (
        pairs.repartition(tasks(counts), "seen", "right").mapInPandas(rank, "word string, right string, p double")
        .groupBy("word").agg(F.max(F.struct("p", "right")).alias("b")).select("word", "b.right")
    )
    return _followed(best), [w for w, _ in common]


def _followed(fixes: DataFrame) -> DataFrame:
    """A right word that is itself a misreading is replaced by its own right word, which is more frequent, to the end."""
    while True:
        fixes = fixes.persist(StorageLevel.MEMORY_AND_DISK)
        again = fixes.select(F.col("word").alias("right"), F.col("right").alias("right2"))
        if fixes.join(again, "right", "left_semi").limit(1).count() == 0:
            return fixes
        fixes = fixes.join(again, "right", "left").select("word", F.coalesce("right2", "right").alias("right"))


def _tokens(line: str) -> tuple[list[str], str]:
    """Words of a line that are printed with blanks between their letters, and the line without them."""
    spaced = [lexical(m[0]) for m in _SPACED.finditer(line) if not _CJK.search(m[0])]
    return spaced, _SPACED.sub(lambda m: m[0] if _CJK.search(m[0]) else " ", line) if spaced else line


def counted_words(text: str) -> Iterator[str]:
    """Words of a text, broken ones joined; the first word may be the end of one and is left out."""
    part, begun = None, False
    for line in text.split("\n"):
        spaced, line = _tokens(line)
        yield from spaced
        toks = line.split()
        if not toks:
            continue
        if part is not None:
            toks[0] = part + toks[0]
        elif not begun:
            toks = toks[1:]
        begun, part = True, hyphen_at(line)
        for t in toks[:-1] if part is not None else toks:
            if w := lexical(t):
                yield w
                if "-" in w:
                    yield from (p for p in w.split("-") if len(p) > 2)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of column text; counted in each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b["text"]:
                c.update(counted_words(t))
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    counted = spread(texts.select("text").filter("text IS NOT NULL")).mapInPandas(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _paged() -> Column:
    return F.col("page").isNotNull() | F.col("heading").rlike(r"(?i)^\W*(?:page|seite|página|p\.|s\.|第)\s*[0-9]+\W*$")


def line_model(sections: DataFrame, common: list[str], max_texts: int = 500, longest: int = 20_000) -> LineModel:
    """Line classifiers fitted on at most max_texts plain texts of documents without scanned pages, chosen by hash."""
    scanned = sections.filter(_paged()).select("doc_id").distinct()
    plain = (
        sections.filter(F.col("text").isNotNull() & F.length("text").between(200, longest) & ~F.col("text").rlike(r"[<{\\|#*\[]"))
        .join(scanned, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", "sec_no"), "doc_id", "sec_no").limit(max_texts).select("text").collect()
    )
    texts = [r.text for r in plain]
    if len(texts) < 30 and len(common) >= 50:  # nothing but scans: sentences of common words
        rng = np.random.default_rng(5)
        texts += [" ".join(" ".join(common[k] for k in rng.integers(0, len(common), 12)).capitalize() + "." for _ in range(8)) for _ in range(60)]
    return train_lines(texts, common)


def scanned_pages(sections: DataFrame) -> DataFrame:
    """Sections that come from scans: those with a page or headed as a page, and sections without page beside them."""
    docs = sections.filter(_paged()).select("doc_id").distinct()
    return sections.join(docs, "doc_id", "left_semi").filter("text IS NOT NULL AND trim(text) <> ''").select("doc_id", "sec_no", "text")


def edge_keys(text: str) -> list[str]:
    """Header keys of the lines at a page's ends that may be running headers."""
    return sorted({k for k, n in edge_rows(text) if n is None})


def _headers_by_page(pages: DataFrame, recurring: DataFrame) -> DataFrame:
    """(doc_id, sec_no, headers): for each page the recurring keys that its edge lines equal or resemble.

    Keys similar by similar() have 0.2 of their joint length, less one, of pairs of signs in
    common, repeated pairs counted; so pairs are joined by these and lose nothing.
    """
    docs = recurring.select("doc_id").distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, s, k) for d, s, t in zip(b["doc_id"], b["sec_no"], b["text"]) for k in edge_keys(t)], columns=["doc_id", "sec_no", "key"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, k in zip(b["doc_id"], b["key"]):
                n: Counter = Counter()
                for i in range(len(k) - 1):
                    g = k[i : i + 2]
                    rows.append((d, k, f"{g}{n[g]}"))
                    n[g] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "key", "gram"])

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[similar(k, h) for k, h in zip(b["key"], b["header"])]][["doc_id", "key", "header"]]

    of_page = pages.join(docs, "doc_id", "left_semi").select("doc_id", "sec_no", "text").mapInPandas(keys, "doc_id string, sec_no int, key string")
    of_page = of_page.persist(StorageLevel.MEMORY_AND_DISK)
    known = recurring.select("doc_id", "key").distinct()
    left = of_page.select("doc_id", "key").distinct().join(known, ["doc_id", "key"], "left_anti").mapInPandas(grams, "doc_id string, key string, gram string")
    right = known.mapInPandas(grams, "doc_id string, key string, gram string").withColumnRenamed("key", "header")
    near = (
        left.join(right, ["doc_id", "gram"]).groupBy("doc_id", "key", "header").agg(F.count("*").alias("shared"))
        .filter(F.col("shared") >= 0.2 * (F.length("key") + F.length("header")) - 1)
        .mapInPandas(alike, "doc_id string, key string, header string")
        .groupBy("doc_id", "key").agg(F.min("header").alias("header"))
    )
    found = known.withColumn("header", F.col("key")).unionByName(near)
    return of_page.join(found, ["doc_id", "key"]).groupBy("doc_id", "sec_no").agg(F.collect_set("header").alias("own"))


def classified_pages(pages: DataFrame, model: LineModel, most_listed: int = 24) -> DataFrame:
    """(doc_id, sec_no, text, kinds): the class of each line of each page.

    A document's recurring edge lines are sent to each of its pages if they are at most
    most_listed; otherwise they are joined to the pages' edge lines.
    """

    def at_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, k, None if n is None else n - s) for d, s, t in zip(b["doc_id"], b["sec_no"], b["text"]) for k, n in edge_rows(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "sec_no", "key", "offset"])
            out["offset"] = out["offset"].astype("Int64")
            yield out

    found = pages.mapInPandas(at_edges, "doc_id string, sec_no int, key string, offset bigint").persist(StorageLevel.MEMORY_AND_DISK)
    recurring = found.filter("key <> ''").groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n >= 2").select("doc_id", "key")
    sizes = recurring.groupBy("doc_id").agg(F.count("*").alias("n"))
    headers = recurring.join(sizes.filter(F.col("n") <= most_listed), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("key").alias("headers"))
    long_docs = recurring.join(sizes.filter(F.col("n") > most_listed), "doc_id", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    # all differences of page number and place that recur in the document, at most four a page
    numbers = found.filter("offset IS NOT NULL").select("doc_id", "sec_no", "offset")
    counted = numbers.groupBy("doc_id", "offset").agg(F.count("*").alias("n"))
    offsets = numbers.join(counted.filter("n >= 2"), ["doc_id", "offset"]).groupBy("doc_id", "sec_no").agg(F.collect_set("offset").alias("offsets"))
    numbered = counted.groupBy("doc_id").agg((F.sum("n") >= 2).alias("numbered"))
    joined = pages.join(headers, "doc_id", "left").join(numbered, "doc_id", "left").join(offsets, ["doc_id", "sec_no"], "left")
    if long_docs.limit(1).count():
        joined = joined.join(_headers_by_page(pages, long_docs), ["doc_id", "sec_no"], "left").withColumn("headers", F.coalesce("headers", "own")).drop("own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = [
                model.kinds(t, [] if h is None else list(h), [] if o is None else list(o), n, s)
                for t, s, h, o, n in zip(b["text"], b["sec_no"], b["headers"], b["offsets"], b["numbered"].eq(True))
            ]
            body = [[i for i, k in enumerate(ks) if k == "body"] for ks in kinds]
            first = [t.split("\n")[x[0]].split()[0] if x else None for t, x in zip(b["text"], body)]
            last = [t.split("\n")[x[-1]] if x else None for t, x in zip(b["text"], body)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "sec_no": b["sec_no"], "text": b["text"], "kinds": kinds, "first_word": first, "last_line": last})

    return joined.mapInPandas(run, "doc_id string, sec_no int, text string, kinds array<string>, first_word string, last_line string")


def with_neighbours(pages: DataFrame) -> DataFrame:
    """Adds next_word and prev_line: the first body word after a page and the last body line before it.

    Only these two strings of each page are sorted by document; the texts join them by
    page, so a document with a large part of all pages makes no large task.
    """
    small = pages.select("doc_id", "sec_no", "first_word", "last_line")
    order = Window.partitionBy("doc_id").orderBy("sec_no")
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    beside = small.select(
        "doc_id", "sec_no",
        F.first("first_word", ignorenulls=True).over(after).alias("next_word"),
        F.last("last_line", ignorenulls=True).over(before).alias("prev_line"),
    )
    return pages.drop("first_word", "last_line").join(beside, ["doc_id", "sec_no"])


def broken_words(lines: list[str], body: list[int], next_word: str | None, model: LineModel) -> dict[int, tuple[str, int]]:
    """For each body line whose last word goes on: the rest of the word and its line, -1 for the next page.

    The rest is the first word of the next body line, or of the next page if lines that
    were put between (a table, a note) don't go on with the word.
    """
    width = max((len(lines[i].strip()) for i in body), default=1)
    out = {}
    for at, i in enumerate(body):
        part = hyphen_at(lines[i])
        if part is None:
            continue
        after = [(lines[body[at + 1]].split()[0], body[at + 1])] if at + 1 < len(body) else []
        if next_word:
            after.append((next_word, -1))
        fit = [(w, j) for w, j in after if model.goes_on(lines[i], w, width, j > i + 1, j < 0)]
        # the next page counts only if the word is known there and not here, or nothing follows here
        if len(after) == 2:
            known = [(w, j) for w, j in fit if lexical(part + w) in model.words or f"{lexical(part)}-{lexical(w)}" in model.words]
            fit = known or [x for x in fit if x[1] >= 0]
        if fit:
            out[i] = fit[0]
    return out


def page_defects(text: str, kinds: list[str], next_word: str | None, model: LineModel, skip: set[str]) -> tuple[list[tuple[int, str]], list[tuple]]:
    """((line, defect)), ((line, word to look up, length of its first part, line of the rest, its form with the hyphen)); lines from 1.

    Words of skip need no look-up.
    """
    lines = text.split("\n")
    body = [i for i, k in enumerate(kinds) if k == "body"]
    defects, asked = [], []
    for i, k in enumerate(kinds):
        if k in ("header", "header+number"):
            defects.append((i + 1, "running_header"))
        if k in ("number", "header+number"):
            defects.append((i + 1, "page_number"))
    broken = broken_words(lines, body, next_word, model)
    ends = {j for _, j in broken.values()}
    for i in body:
        spaced, line = _tokens(lines[i])
        asked += [(i + 1, w, 0, 0, None) for w in spaced]
        toks = line.split()
        part = hyphen_at(line)
        if i in broken:
            w, j = broken[i]
            defects.append((i + 1, "line_hyphen"))
            whole, dashed = lexical(part + w), f"{lexical(part)}-{lexical(w)}"
            asked.append((i + 1, whole, len(part.lstrip(_STRIP)), j + 1 if j >= 0 else 0, dashed))
        if part is not None:
            toks = toks[:-1]
        if i in ends:
            toks = toks[1:]
        for t in toks:
            w = lexical(t)
            if not w or w in skip or not any(c.isalpha() for c in w) or _CJK.search(w):
                continue
            asked.append((i + 1, w, 0, 0, None))
            pieces = w.split("-")
            if len(pieces) > 1:
                asked += [(i + 1, p, 0, 0, None) for p in pieces if len(p) > 2 and p not in skip]
    return defects, asked


def _found(pages: DataFrame, model: LineModel, common: list[str], fixes: DataFrame) -> DataFrame:
    """Defects that a page shows by itself, and the words to look up (defect is null).

    Common words are looked up too if they have an entry in fixes.
    """
    spark = pages.sparkSession
    held = spark.createDataFrame([(w,) for w in common], "word string").join(fixes, "word", "left_semi").collect() if common else []
    skip = set(common) - {r.word for r in held}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, s, t, k, nw in zip(b["doc_id"], b["sec_no"], b["text"], b["kinds"], b["next_word"]):
                defects, asked = page_defects(t, list(k), nw, model, skip)
                out += [(d, s, n, x, None, 0, 0, None) for n, x in defects]
                out += [(d, s, n, None, *a) for n, *a in dict.fromkeys(asked)]
            yield pd.DataFrame(out, columns=["doc_id", "sec_no", "line_no", "defect", "word", "cut", "rest", "dashed"])

    return pages.mapInPandas(run, "doc_id string, sec_no int, line_no int, defect string, word string, cut int, rest int, dashed string")


def _prepared(sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, LineModel]:
    sections = sections.select("doc_id", "sec_no", "heading", "text", "page").persist(StorageLevel.MEMORY_AND_DISK)  # texts were shuffled once to drop rows delivered twice
    counts = word_counts(sections).persist(StorageLevel.MEMORY_AND_DISK)
    fixes, common = corrections(counts)
    model = line_model(sections, common)
    pages = with_neighbours(classified_pages(spread(scanned_pages(sections)), model).persist(StorageLevel.MEMORY_AND_DISK))
    found = _found(pages, model, common, fixes).persist(StorageLevel.MEMORY_AND_DISK)
    return pages, found, broadcast_if_small(fixes, 50_000), counts, model


def scan_defects(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_no, line_no, defect): one row for each defect and line of scanned pages."""
    _, found, fixes, _, _ = _prepared(sections)
    sure = found.filter("defect IS NOT NULL").select("doc_id", "sec_no", "line_no", "defect")
    # a broken word was misread after the break if its first part agrees with the right word
    agrees = F.substring(F.col("word"), F.lit(1), F.col("cut")) == F.substring(F.col("right"), F.lit(1), F.col("cut"))
    misread = (
        found.filter("word IS NOT NULL").join(fixes, "word")
        .withColumn("line_no", F.when((F.col("cut") > 0) & agrees & (F.col("rest") > 0), F.col("rest")).otherwise(F.col("line_no")))
        .select("doc_id", "sec_no", "line_no", F.lit("misread_chars").alias("defect"))
    )
    return sure.unionByName(misread).distinct()


def repaired_pages(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_no, text, goes_on): paragraphs of each scanned page without furniture, breaks and misreadings.

    A word broken at the end of a page is completed there and left out on the next page;
    its hyphen stays if the corpus writes the word with it more often than without.
    goes_on says that the first paragraph continues the page before.
    """
    pages, found, fixes, counts, model = _prepared(sections)
    of_page = (
        found.filter("word IS NOT NULL").select("doc_id", "sec_no", "word").distinct().join(fixes, "word")
        .groupBy("doc_id", "sec_no").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("fixes"))
    )
    breaks = found.filter("dashed IS NOT NULL").select("doc_id", "sec_no", "line_no", "word", "dashed")
    dashed = breaks.join(counts.select(F.col("word").alias("dashed"), F.col("n").alias("n_dashed")), "dashed")
    kept = (
        dashed.join(counts, "word", "left").filter(F.col("n_dashed") > F.coalesce("n", F.lit(0)))
        .groupBy("doc_id", "sec_no").agg(F.collect_set("line_no").alias("dashes"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, s, *repair(t, list(k), nw, pl, {} if f is None else dict(f), set() if ds is None else set(ds), model)) for d, s, t, k, nw, pl, f, ds in
                   zip(b["doc_id"], b["sec_no"], b["text"], b["kinds"], b["next_word"], b["prev_line"], b["fixes"], b["dashes"])]
            yield pd.DataFrame(out, columns=["doc_id", "sec_no", "text", "goes_on"])

    joined = pages.join(of_page, ["doc_id", "sec_no"], "left").join(kept, ["doc_id", "sec_no"], "left").withColumn("fixes", F.map_entries("fixes"))
    joined = joined.withColumn("fixes", F.transform("fixes", lambda e: F.array(e.key, e.value)))
    return joined.mapInPandas(run, "doc_id string, sec_no int, text string, goes_on boolean")


def _fixed(token: str, fixes: dict[str, str]) -> str:
    core = token.strip(_STRIP)
    right = fixes.get(core.lower())
    if right is None or not core:
        return token
    if core.isupper() and len(core) > 1:
        right = right.upper()
    elif core[0].isupper():
        right = right[0].upper() + right[1:]
    at = token.index(core)
    return token[:at] + right + token[at + len(core) :]


def repair(text: str, kinds: list[str], next_word: str | None, prev_line: str | None, fixes: dict[str, str], dashes: set[int], model: LineModel) -> tuple[str, bool]:
    """Continuous paragraphs of one page, and whether the first goes on from the page before.

    dashes are the lines, from 1, whose broken word keeps its hyphen.
    """
    lines = text.split("\n")
    body = [i for i, k in enumerate(kinds) if k == "body"]
    width = max((len(lines[i].strip()) for i in body), default=1)
    broken = broken_words(lines, body, next_word, model)
    paras: list[list[str]] = []
    fresh, first = True, True
    pending: dict[int, str] = {}
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind == "blank":
            fresh = fresh or not pending
            continue
        if kind == "figures":
            paras.append([line.strip()])
            fresh = True
            continue
        if kind != "body":
            continue
        line = _SPACED.sub(lambda m: _fixed(m[0], fixes).replace(" ", "") if _CJK.search(m[0]) is None else m[0], line)
        toks = line.split()
        if first and prev_line and toks and model.goes_on(prev_line, toks[0], width, False, True):
            toks = toks[1:]  # completed on the page before
        first_of_line, first = first, False
        if (not pending and (fresh or (line[:3] == "   " and not first_of_line))) or not paras:
            paras.append([])
        fresh = False
        if i in pending and toks:
            toks[0] = _fixed(pending.pop(i) + toks[0], fixes)
        last = None
        if i in broken and toks:
            rest, j = broken[i]
            part = toks.pop()[:-1] + ("-" if i + 1 in dashes else "")
            if j >= 0:
                pending[j] = part
            else:
                last = _fixed(part + rest, fixes)
        paras[-1] += [_fixed(t, fixes) for t in toks]
        if last:
            paras[-1].append(last)
    goes = bool(prev_line) and prev_line.rstrip()[-1:] not in ".!?。！？:"
    return "\n\n".join(" ".join(p) for p in paras if p), goes
