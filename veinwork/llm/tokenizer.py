"""Encoding of whole corpora with a public byte-level BPE tokenizer.

The merges are compiled into a deterministic tokenization automaton. Its states are the
tokens (plus a start), and an arc from token a to token b exists exactly if a run of a
followed by b is what the merges leave: each merge adds a gadget that forbids the pairs
it would have joined. A pre-split word is encoded by table-driven transitions: at each
byte offset exactly one token can end an accepted path, so the table of ending tokens is
filled from left to right and the arc labels are read back.

Defined cases: a null, empty text gives an empty list; special-token strings in a text
are ordinary text; words of any length are encoded in time proportional to their length
times the longest token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.session import spread

DEFAULT_DIR = "/opt/tokenizers"
#: Words whose ids a worker keeps; beyond it the table starts anew. It bounds memory only.
WORD_TABLE = 200_000
# Fixed value: the splitting pattern of the vocabulary files.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic tokenization automaton of a merge list."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocab
        self.max_len = max(map(len, vocab))
        self.born = {}  # token -> (rank of its merge, left part, right part)
        for rank, (a, b) in enumerate(merges):
            self.born.setdefault(a + b, (rank, a, b))
        self.joined = {}
        for rank, pair in enumerate(merges):
            self.joined.setdefault(pair, rank)
        self.arcs: dict[tuple[bytes, bytes], bool] = {}
        self.table: dict[str, list[int]] = {}
        self.by_len: dict[bytes, None] = {}
        # lengths of the tokens that end with a given pair of bytes: the rows of the transition table
        ends: dict[bytes, set[int]] = {}
        for t in vocab:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: sorted(v) for k, v in ends.items()}

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> Automaton:
        model = json.loads((Path(folder) / f"{name}.json").read_text("utf-8"))["model"]
        of = byte_letters()

        def raw(s: str) -> bytes:
            return bytes(of[c] for c in s)

        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(vocab, [(raw(a), raw(b)) for a, b in pairs])

    def accepts(self, a: bytes, b: bytes) -> bool:
        """Whether the automaton has an arc labelled b after token a.

        The gadgets that made a and b are undone from the latest to the earliest. The arc
        is missing if some merge joins what then touches before a or b was complete.
        """
        known = self.arcs.get((a, b))
        if known is not None:
            return known
        left, right, bound = a, b, 1 << 60
        ok = True
        while True:
            rank = self.joined.get((left, right))
            if rank is not None and rank < bound:
                ok = False
                break
            lr = self.born[left][0] if left in self.born else -1
            rr = self.born[right][0] if right in self.born else -1
            if lr < 0 and rr < 0:
                break
            # of equal merges the one further left is made first, so it wins over an overlap on
            # its right, while one on its left would have come first
            if rr >= lr:
                bound, right = rr + 1, self.born[right][1]
            else:
                bound, left = lr, self.born[left][2]
        if len(self.arcs) > 4_000_000:
            self.arcs.clear()
        self.arcs[(a, b)] = ok
        return ok

    def word(self, w: bytes) -> list[int]:
        """Ids of one pre-split word."""
        if w in self.ids and (w in self.born or len(w) == 1):
            return [self.ids[w]]
        n, ids, ends = len(w), self.ids, self.ends
        ending: list[bytes | None] = [None] * (n + 1)
        for i in range(1, n + 1):
            for size in ends.get(w[max(0, i - 2) : i], ()) if i > 1 else (1,):
                t = w[i - size : i] if size <= i else b""
                if t not in ids:
                    continue
                if size == i or (ending[i - size] is not None and self.accepts(ending[i - size], t)):
                    ending[i] = t
                    break
            else:
                t = w[i - 1 : i]
                ending[i] = t if i == 1 or (ending[i - 1] is not None and self.accepts(ending[i - 1], t)) else None
        out, i = [], n
        while i > 0:
            t = ending[i]
            out.append(ids[t])
            i -= len(t)
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids: the labels of its arcs."""
        if not self.by_len:
            self.by_len = {i: t for t, i in self.ids.items()}
        return b"".join(self.by_len[i] for i in ids).decode("utf-8", errors="replace")

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        table = self.table
        for w in _words(text):
            got = table.get(w)
            if got is None:
                got = self.word(w.encode("utf-8", errors="replace"))
                if len(table) >= WORD_TABLE:
                    table.clear()
                if len(w) <= 64:
                    table[w] = got
            out += got
        return out


_words = regex.compile(WORD).findall
_loaded: dict[tuple[str, str], Automaton] = {}


def automaton(name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> Automaton:
    """The automaton of a vocabulary, compiled once in each worker."""
    if (name, folder) not in _loaded:
        _loaded[name, folder] = Automaton.load(name, folder)
    return _loaded[name, folder]


def encode_column(texts: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> DataFrame:
    """(key, ids) for every row, in one pass without a shuffle."""
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = automaton(name, folder)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "ids": [auto.encode(t) for t in b["t"]]})

    rows = spread(texts.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInPandas(run, f"k {key_type}, ids array<int>").withColumnRenamed("k", key)


def token_counts(texts: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> DataFrame:
    """(key, n_tokens) for every row."""
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = automaton(name, folder)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n_tokens": [len(auto.encode(t)) for t in b["t"]]})

    rows = spread(texts.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInPandas(run, f"k {key_type}, n_tokens bigint").withColumnRenamed("k", key)
