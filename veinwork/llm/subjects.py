"""Subject areas of documents.

Terms get their subjects from hand-labelled documents and from the company they keep in
all others: sentences that the terms known so far assign clearly teach the terms beside
them, over the whole corpus and in every language. A document's features are the shares
of its text by subject, its structure and its source. A chain of calibrated logistic
classifiers, one for each subject and each fed with the decisions before it, models which
subjects go together; beam search finds the most probable set of subjects, which decides.

Each text is split into terms once; what follows works on hashes of terms in arrays. The
classifiers are fitted on at most max_labels labelled documents, chosen by hash, and on
documents made of their sentences in known shares, since few hand labels lie near the
least share; a part of the labelled documents is held out and calibrates the chain. The
term statistics cover all documents. The model holds at most terms_per_subject terms for
each subject, which bounds what is sent to the workers.

Defined cases: null and blank texts and texts of no known subject give no row; label rows
without subject or without a document are left out; equal documents get equal subjects;
texts are read whole; other columns are not read; more than max_subjects subjects are a
ValueError.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.session import bounded, spread

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[一-鿿]+")
_TOKEN = re.compile(_WORD.pattern + "|\x00")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


_hashes: dict[str, int] = {}


def term_hash(term: str) -> int:
    """A term as a number other than 0; frequent terms are kept at hand."""
    h = _hashes.get(term)
    if h is None:
        h = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63) or 1
        if len(_hashes) < 200_000:
            _hashes[term] = h
    return h


@dataclass
class Sentences:
    """The sentences of a batch of texts: their documents, lengths and terms, all in flat arrays."""

    n_docs: int
    doc: np.ndarray
    length: np.ndarray
    term: np.ndarray
    of: np.ndarray

    @staticmethod
    def split(text: str) -> tuple[list[int], list[int], list[int]]:
        """(length of each sentence, number of its terms, hashes of all terms) of one text.

        Terms are words in lower case; of scripts without blanks the pairs of neighbouring signs.
        """
        found = sentences(text.replace("\x00", " "))
        hashed: list[int] = []
        sizes, begun, known = [], 0, _hashes.get
        for w in _TOKEN.findall("\x00".join(found).lower()):  # one search for all sentences
            if w == "\x00":
                sizes.append(len(hashed) - begun)
                begun = len(hashed)
            elif w[0] >= "\u3000":
                hashed += [term_hash(run[i : i + 2]) for run in _CJK.findall(w) for i in range(len(run) - 1)]
            else:
                hashed.append(known(w) or term_hash(w))
        sizes.append(len(hashed) - begun)
        return [len(x) for x in found], sizes[: len(found)], hashed

    @classmethod
    def of_rows(cls, lengths, sizes, hashed) -> Sentences:
        n = [len(x) for x in lengths]
        flat = [np.concatenate([np.asarray(x, dtype=np.int64) for x in col]) if len(col) else np.zeros(0, np.int64) for col in (lengths, sizes, hashed)]
        return cls(len(n), np.repeat(np.arange(len(n)), n), flat[0], flat[2], np.repeat(np.arange(len(flat[1])), flat[1]))


@dataclass
class Lexicon:
    """Scores of term hashes by subject; unknown terms say nothing."""

    subjects: list[str]
    keys: np.ndarray
    matrix: np.ndarray
    margin: float = 2.0

    def subjects_of(self, s: Sentences) -> np.ndarray:
        """Number of the subject of each sentence, or -1."""
        n, k = len(s.doc), len(self.subjects)
        if not len(self.keys) or k < 2 or not n:
            return np.full(n, -1)
        at = np.searchsorted(self.keys, s.term)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == s.term
        at, of = at[known], s.of[known]
        total = np.stack([np.bincount(of, weights=self.matrix[at, j], minlength=n) for j in range(k)], axis=1)
        any_known = np.bincount(of, minlength=n) > 0
        best = total.argmax(1)
        two = np.partition(total, k - 2, axis=1)[:, k - 2 :]
        return np.where(any_known & (two[:, 1] - two[:, 0] >= self.margin), best, -1)

    def shares(self, s: Sentences, subject: np.ndarray | None = None) -> np.ndarray:
        """Share of each text's characters that each subject holds, then the share of none."""
        k = len(self.subjects)
        of = self.subjects_of(s) if subject is None else subject
        out = np.bincount(s.doc * (k + 1) + np.where(of < 0, k, of), weights=s.length, minlength=s.n_docs * (k + 1)).reshape(s.n_docs, k + 1)
        return out / np.maximum(1.0, out.sum(1, keepdims=True))


def lexicon_from_counts(keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, subjects: list[str], per_subject: int, least: float = 2.0) -> Lexicon:
    """Terms that one subject holds clearly, with log odds against the mean of all subjects."""
    n = counts.sum(1)
    rate0 = (totals + 1.0) / (totals.sum() + len(subjects))
    logs = np.log((counts + 0.2) / (totals + 2.0))
    score = np.clip(logs - logs.mean(1, keepdims=True), -4, 4)
    order = np.sort(score, axis=1)
    clear = (n >= least) & (order[:, -1] - order[:, -2] >= 0.7) if len(subjects) > 1 else n >= least
    s = score.argmax(1)
    own = counts[np.arange(len(keys)), s] if len(keys) else np.zeros(0)
    gain = own * np.log((own + 0.5) / (n * rate0[s] + 0.5) + 1e-9)
    keep: list[int] = []
    for k in range(len(subjects)):
        mine = np.flatnonzero(clear & (s == k))
        keep += mine[np.lexsort((keys[mine], -gain[mine]))[:per_subject]].tolist()
    rows = np.array(sorted(keep, key=lambda i: keys[i]), dtype=int)
    return Lexicon(subjects, keys[rows], score[rows])


def seed_lexicon(split: Sentences, names: list[list[str]], subjects: list[str], per_subject: int) -> Lexicon:
    """The lexicon of labelled documents: each term counts once a document, for each of its labels alike."""
    k = len(subjects)
    weight = np.zeros((len(names), k))
    for i, own in enumerate(names):
        weight[i, [subjects.index(n) for n in own]] = 1 / len(own)
    doc_term = np.unique(np.stack([s for s in (split.doc[split.of], split.term)], axis=1), axis=0) if len(split.term) else np.zeros((0, 2), np.int64)
    keys, at = np.unique(doc_term[:, 1], return_inverse=True)
    counts = np.stack([np.bincount(at, weights=weight[doc_term[:, 0], j], minlength=len(keys)) for j in range(k)], axis=1) if len(keys) else np.zeros((0, k))
    return lexicon_from_counts(keys, counts, weight.sum(0), subjects, per_subject, least=1.5)


def _grown(split: DataFrame, lex: Lexicon, per_subject: int) -> Lexicon:
    """The lexicon that all sentences teach which lex assigns clearly."""
    n = len(lex.subjects)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = Sentences.of_rows(b["lengths"], b["sizes"], b["hashed"])
            ks = lex.subjects_of(s)
            by_doc = np.bincount(s.doc[ks >= 0] * n + ks[ks >= 0], minlength=s.n_docs * n).reshape(s.n_docs, n)
            top = by_doc.argmax(1)
            # what a sentence says of itself would only confirm itself; its document says it if it is clear
            clear = by_doc.max(1, initial=0) >= np.maximum(1, 0.6 * np.bincount(s.doc, minlength=s.n_docs))
            ks = np.where(clear[s.doc], top[s.doc], ks)
            total = np.bincount(ks[ks >= 0], minlength=n)
            at = s.of[ks[s.of] >= 0]
            pair = np.unique(np.stack([at, s.term[ks[s.of] >= 0]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            keys, inv = np.unique(pair[:, 1], return_inverse=True)
            c = np.bincount(inv * n + ks[pair[:, 0]], minlength=len(keys) * n).reshape(len(keys), n)
            yield pd.DataFrame({"term": np.append(keys, 0), **{f"c{j}": np.append(c[:, j], total[j]) for j in range(n)}})

    cols = [f"c{i}" for i in range(n)]
    counted = (
        split.select("lengths", "sizes", "hashed").mapInPandas(count, "term bigint, " + ", ".join(f"{c} bigint" for c in cols))
        .groupBy("term").agg(*[F.sum(c).alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    )
    total_row = counted.filter("term = 0").select(*cols).collect()
    totals = np.array([float(x or 0) for x in total_row[0]]) if total_row else np.zeros(n)
    # for each subject the terms with the most sentences beyond their share: a bounded list
    both = sum((F.col(c) for c in cols), F.lit(0))
    picked = None
    for i, c in enumerate(cols):
        share = totals[i] / max(1.0, totals.sum())
        gain = F.col(c) * F.log((F.col(c) + 0.5) / (both * F.lit(float(share)) + 0.5))
        top = counted.filter((F.col("term") != 0) & (both >= 3) & (F.col(c) > 0.5 * both)).orderBy(gain.desc(), "term").limit(per_subject)
        picked = top if picked is None else picked.unionByName(top)
    rows = {r.term: [float(r[c]) for c in cols] for r in picked.collect()} if picked is not None else {}
    counted.unpersist()
    keys = np.array(list(rows), dtype=np.int64)
    return lexicon_from_counts(keys, np.array(list(rows.values())).reshape(len(rows), n), totals, lex.subjects, per_subject, least=3)


def _features(shares: np.ndarray, n_chars: np.ndarray, n_paragraphs: np.ndarray, source: list, sources: list[str], least_share: float) -> np.ndarray:
    """Shares by subject, their places around the least share, structure and source of each text."""
    shape = np.stack([np.log1p(n_chars) / 10, np.log1p(n_paragraphs) / 3, shares[:, :-1].max(1, initial=0.0), shares[:, -1]], axis=1)
    return np.hstack([shares[:, :-1], np.tanh(15 * (shares[:, :-1] - least_share)), shape, np.array([[float(x == s) for s in sources] for x in source]).reshape(len(source), len(sources))])


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.002, steps: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    pen = np.full(x1.shape[1], l2 * len(x) / 10)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + pen * w
        h = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(pen + 1e-6)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


class Chain:
    """Classifier chain over subjects in order of frequency, with decoding by beam search."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n_share: int):
        self.order = [int(k) for k in np.argsort(-y.sum(0), kind="stable")]
        self.n_share = n_share
        self.weights = [_fit_logistic(self._input(x, y, pos, k), y[:, k]) for pos, k in enumerate(self.order)]

    def _input(self, x: np.ndarray, y: np.ndarray, pos: int, k: int) -> np.ndarray:
        n = self.n_share
        others = np.delete(x[:, :n], k, axis=1).max(axis=1, initial=0.0)
        before = y[:, self.order[:pos]]
        return np.hstack([10 * x[:, [k]], 5 * x[:, [n + k]], 5 * others[:, None], x[:, 2 * n :], before, before.sum(1, keepdims=True)])

    def _logits(self, x: np.ndarray, y: np.ndarray, pos: int) -> np.ndarray:
        return np.hstack([self._input(x, y, pos, self.order[pos]), np.ones((len(x), 1))]) @ self.weights[pos]

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 60) -> Chain:
        """Scale all decision values by one factor, so that they are right as probabilities on labels not used before."""
        z = np.concatenate([self._logits(x, y, pos) for pos in range(len(self.order))])
        t = np.concatenate([y[:, k] for k in self.order])
        a = 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * z, -30, 30)))
            a -= (z @ (p - t) + (a - 1.0)) / ((z * z) @ (p * (1 - p)) + 1.0)
            a = min(3.0, max(0.05, a))
        self.weights = [a * w for w in self.weights]
        return self

    def decode_all(self, x: np.ndarray, width: int = 4) -> np.ndarray:
        """The most probable set of subjects of each row of features, as zeros and ones."""
        n, k = len(x), len(self.order)
        none = np.zeros((n, k))
        logp = np.full((n, width), -np.inf)
        logp[:, 0] = 0.0
        chosen = np.zeros((n, width, k))  # in chain order
        for pos in range(k):
            w = self.weights[pos]
            before, count = w[len(w) - 2 - pos : len(w) - 2], w[-2]
            z = np.clip(self._logits(x, none, pos)[:, None] + chosen[:, :, :pos] @ before + count * chosen.sum(2), -30, 30)
            lost = np.log1p(np.exp(-z))
            both = np.hstack([logp - lost, logp - lost - z])
            top = np.argsort(-both, axis=1, kind="stable")[:, :width]
            logp = np.take_along_axis(both, top, axis=1)
            chosen = np.take_along_axis(chosen, (top % width)[:, :, None], axis=1)
            chosen[:, :, pos] = top < width
        out = np.zeros((n, k))
        out[:, self.order] = chosen[:, 0]
        return out


def made_shares(split: Sentences, subject: np.ndarray, y: np.ndarray, n_made: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, characters, paragraphs) of documents made of the labelled documents' sentences.

    A made document takes the subjects of one labelled document and sentences of them, of
    one other subject and of none, in random numbers.
    """
    k = y.shape[1]
    pools = [split.length[subject == j] for j in range(k)] + [split.length[subject < 0]]
    shares, chars = np.zeros((n_made, k + 1)), np.zeros(n_made)
    for i in range(n_made):
        own = np.flatnonzero(y[rng.integers(len(y))]).tolist()
        for j in {*own, int(rng.integers(k)), k}:
            if len(pools[j]):
                shares[i, j] = pools[j][rng.integers(len(pools[j]), size=int(rng.integers(0, 12)))].sum()
        chars[i] = shares[i].sum()
    return shares / np.maximum(1.0, chars[:, None]), chars, rng.integers(1, 9, n_made).astype(float)


def fit_chain(lex: Lexicon, split: Sentences, text: list[str], source: list, y: np.ndarray, sources: list[str], least_share: float, n_made: int = 4000, held_out: float = 0.2, seed: int = 3) -> Chain:
    """The chain from labelled and made documents, calibrated on the held-out part of the labelled ones."""
    rng = np.random.default_rng(seed)
    subject = lex.subjects_of(split)
    shares = lex.shares(split, subject)
    x = _features(shares, np.array([len(t) for t in text]), np.array([t.count("\n\n") + 1 for t in text]), source, sources, least_share)
    held = rng.random(len(y)) < held_out if len(y) >= 50 else np.zeros(len(y), bool)
    made, chars, pars = made_shares(split, subject, y[~held], n_made, rng)
    mx = _features(made, chars, pars, [source[i] for i in rng.integers(0, len(source), n_made)], sources, least_share)
    my = (made[:, :-1] >= least_share).astype(float)
    chain = Chain(np.vstack([x[~held], mx]), np.vstack([y[~held], my]), len(lex.subjects))
    return chain.calibrate(x[held], y[held]) if held.any() else chain


def split_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, n_paragraphs, lengths, sizes, hashed): each text as its sentences and hashes of their terms."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [Sentences.split(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "source": b["source"], "n_chars": [len(t) for t in b["text"]], "n_paragraphs": [t.count("\n\n") + 1 for t in b["text"]],
                "lengths": [p[0] for p in parts], "sizes": [p[1] for p in parts], "hashed": [p[2] for p in parts],
            })

    rows = spread(docs.select("doc_id", "text", "source").filter(F.col("text").isNotNull() & (F.trim("text") != "")))
    return rows.mapInPandas(run, f"doc_id {id_type}, source string, n_chars int, n_paragraphs int, lengths array<int>, sizes array<int>, hashed array<bigint>")


def document_subjects(
    docs: DataFrame, labels: DataFrame, subjects: DataFrame, max_labels: int = 8_000, terms_per_subject: int = 3000, rounds: int = 2, least_share: float = 1 / 3, beam: int = 4, max_subjects: int = 1000
) -> DataFrame:
    """(doc_id, subject): subjects that at least least_share of a document's text is about, by the decoded chain."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fits, rows = bounded(subjects.select("subject").filter("subject IS NOT NULL").distinct(), max_subjects)
    if not fits:
        raise ValueError(f"more than {max_subjects} subjects")
    names = sorted(r.subject for r in rows)
    empty = docs.sparkSession.createDataFrame([], f"doc_id {id_type}, subject string")
    if not names:
        return empty
    given = labels.filter(F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("names"))
    chosen = given.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    sample = (
        docs.select("doc_id", "text", "source").filter(F.col("text").isNotNull() & (F.trim("text") != ""))
        .join(F.broadcast(chosen), "doc_id").select("text", "source", "names").collect()
    )
    if not sample:
        return empty
    sample.sort(key=lambda r: (r.text, r.source or "", r.names))
    split = split_texts(docs).persist(StorageLevel.MEMORY_AND_DISK)
    known = Sentences.of_rows(*zip(*[Sentences.split(r.text) for r in sample]))
    lex = seed_lexicon(known, [list(r.names) for r in sample], names, terms_per_subject)
    for _ in range(rounds):
        lex = _grown(split, lex, terms_per_subject)
    sources = [s for s, _ in Counter(r.source for r in sample if r.source).most_common(30)]
    y = np.array([[float(n in r.names) for n in names] for r in sample])
    chain = fit_chain(lex, known, [r.text for r in sample], [r.source for r in sample], y, sources, least_share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            shares = lex.shares(Sentences.of_rows(b["lengths"], b["sizes"], b["hashed"]))
            x = _features(shares, b["n_chars"].to_numpy(), b["n_paragraphs"].to_numpy(), list(b["source"]), sources, least_share)
            row, k = np.nonzero(chain.decode_all(x, beam) * (shares[:, :-1] > 0))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[row], "subject": [names[j] for j in k]})

    return split.mapInPandas(run, f"doc_id {id_type}, subject string").distinct()
