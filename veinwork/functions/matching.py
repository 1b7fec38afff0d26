"""Similarity of names by their matching blocks, and its bounds, for many pairs at once."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_ratio(a: str, b: str) -> float:
    """Twice the matched characters over all; not the same for (b, a)."""
    return SequenceMatcher(None, a, b).ratio()


#: Longest name that is compared in arrays; longer ones are compared one by one.
LONGEST = 100


def code_points(names: list[str]) -> np.ndarray:
    """(names, longest): code points, 0 beyond the end."""
    longest = max([1, *map(len, names)])
    return np.array(names, dtype=f"U{longest}").view(np.uint32).reshape(len(names), longest)


def sequence_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """sequence_ratio of each a and b. The matcher's recursion runs level by level, for all pairs at once."""
    out = np.zeros(len(a))
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=int)
    for k in np.flatnonzero(size > LONGEST):
        out[k] = sequence_ratio(a[k], b[k])
    order = np.flatnonzero(size <= LONGEST)
    order = order[np.argsort(size[order], kind="stable")]
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        out[part] = _ratios([a[k] for k in part], [b[k] for k in part])
    return out


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    ca, cb = code_points(a), code_points(b)
    la, lb = (np.array([len(x) for x in s]) for s in (a, b))
    matched = np.zeros(len(a), dtype=int)
    # ranges still to be searched: pair, ends in a, ends in b
    todo = np.stack([np.arange(len(a)), np.zeros_like(la), la, np.zeros_like(lb), lb])[:, (la > 0) & (lb > 0)]
    while todo.shape[1]:
        p, a0, a1, b0, b1 = todo
        na, nb = (a1 - a0).max(), (b1 - b0).max()
        row, col = np.arange(na), np.arange(nb)
        # signs beyond a range equal nothing
        xa = np.where(row[:, None] < a1 - a0, ca[p, np.minimum(a0 + row[:, None], ca.shape[1] - 1)], np.uint32(0xFFFFFFFE))
        xb = np.where(col[:, None] < b1 - b0, cb[p, np.minimum(b0 + col[:, None], cb.shape[1] - 1)], np.uint32(0xFFFFFFFF))
        run = np.zeros((nb + 1, len(p)), dtype=np.uint16)  # run[j + 1]: length of the common run that ends at j
        ends = (127 - col).astype(np.uint16)[:, None]
        best, end_a = np.zeros(len(p), dtype=np.uint16), np.zeros(len(p), dtype=int)
        for i in range(na):
            run[1:] = (run[:-1] + 1) * (xb == xa[i])
            top = (run[1:] * 128 + ends).max(axis=0)  # the longest run, the first of equals
            longer = top // 128 > best // 128
            best[longer] = top[longer]
            end_a[longer] = i
        k, end_b = (best // 128).astype(int), 127 - (best % 128).astype(int)
        np.add.at(matched, p, k)
        i, j = a0 + end_a - k + 1, b0 + end_b - k + 1
        found = k > 0
        todo = np.concatenate([np.stack([p, a0, i, b0, j])[:, found & (a0 < i) & (b0 < j)], np.stack([p, i + k, a1, j + k, b1])[:, found & (i + k < a1) & (j + k < b1)]], axis=1)
    both = la + lb
    return np.where(both > 0, 2.0 * matched / np.maximum(both, 1), 1.0)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of rows of code points of at most 64 signs; rows of one array have one length."""
    v = np.full(len(a), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    wide = np.zeros((len(a), 64), dtype=bool)
    for q in range(b.shape[1]):
        np.equal(a, b[:, q : q + 1], out=wide[:, : a.shape[1]])
        u = v & np.packbits(wide, axis=1, bitorder="little").view(np.uint64)[:, 0]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(int)


def count_bits(codes: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """(words, names): bit (c, k) of steps is set where a name has the sign c at least k times. Bits that differ never outnumber the signs that aren't shared."""
    words = np.zeros((max(1, -(-len(steps) // 64)), len(codes)), dtype=np.uint64)
    counts = {c: (codes == c).sum(axis=1) for c in {c for c, _ in steps}}
    for n, (c, k) in enumerate(steps):
        words[n // 64] |= (counts[c] >= k).astype(np.uint64) << np.uint64(n % 64)
    return words


def bigram_bits(codes: np.ndarray) -> np.ndarray:
    """(2, names): bits of the neighbouring signs. A sign that isn't shared changes at most three of them."""
    words = np.zeros((2, len(codes)), dtype=np.uint64)
    for q in range(codes.shape[1] - 1):
        h = (codes[:, q].astype(np.uint64) * np.uint64(2654435761) + codes[:, q + 1].astype(np.uint64) * np.uint64(40503)) >> np.uint64(5)
        bit = np.uint64(1) << (h & np.uint64(63))
        upper = (h >> np.uint64(6)) & np.uint64(1) == 1
        words[0] |= np.where(upper, np.uint64(0), bit)
        words[1] |= np.where(upper, bit, np.uint64(0))
    return words


def close_pairs(a: tuple, b: tuple, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of two blocks that may share all but apart of their signs, and of others that can't be told from them.

    A block is (code points, count bits, bigram bits) of names of one length.
    """
    rows, cols = [], []
    for at in range(0, len(a[0]), 16):
        y, x = np.nonzero(np.bitwise_count(a[1][0][at : at + 16, None] ^ b[1][0][None, :]) <= apart)
        rows.append(y + at)
        cols.append(x)
    y, x = np.concatenate(rows), np.concatenate(cols)
    for words, most in ((1, apart), (2, 3 * apart)):
        differ = np.zeros(len(y), dtype=int)
        for u, v in zip(a[words], b[words]):
            differ += np.bitwise_count(u[y] ^ v[x])
        y, x = y[differ <= most], x[differ <= most]
    la, lb = a[0].shape[1], b[0].shape[1]
    if max(la, lb) <= 64:
        keep = [np.zeros(0, dtype=bool)]
        for at in range(0, len(y), 8192):
            keep.append(la + lb - 2 * common_subsequence(a[0][y[at : at + 8192]], b[0][x[at : at + 8192]]) <= apart)
        y, x = y[(keep := np.concatenate(keep))], x[keep]
    return y, x


def length_bound(a: Column, b: Column, threshold: float) -> Column:
    """No pair of such lengths can pass the threshold where this is false."""
    la, lb = F.length(a), F.length(b)
    return 2 * F.least(la, lb) >= threshold * (la + lb)
