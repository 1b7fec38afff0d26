"""Splitting oversized texts at natural boundaries.

A text is cut into ranges of a fixed size. Each worker sees one range with a halo on
both sides, finds the boundaries in it and cuts its own stretch, which runs from the
first natural boundary after its range's start to the first one after the next range's
start; neighbours find the same point, as both see the text behind it. What goes over
range ends is stitched from one small row a range: piece counts are summed up to number
the pieces, runs without boundary are joined, and the first piece of a range learns where
the piece before it began. Texts of one range never leave their task. Files are read by
seeking to a range, never as a whole.

Defined cases: null texts and texts within the limit come out of split_texts as nothing
(they need no cut) unless keep_short is set; lengths are code points in columns and bytes
in files; a cut never falls inside a UTF-8 sequence; equal rows give equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP, RANGE = 2500, 500, 262_144
# What ends a sentence, for cuts and for the search for runs without any boundary.
STOPS = ".!?。！？"
_PARA = re.compile(r"\n[ \t\r]*\n\s*")
_SENT = re.compile(r"[.!?][\"'”’)\]]*\s+|[。！？][”’」』]*\s*")
_LINE = re.compile(r"\n+")
_SPACE = re.compile(r"\s+")
_BREAK = re.compile(rf"[\s{re.escape(STOPS)}]+")
_KINDS = (_PARA, _SENT, _LINE, _SPACE)


def _first_boundary(text: str, lo: int, hi: int) -> int:
    """End of the first boundary that begins in text[lo:hi], the stronger kinds first; lo if there is none."""
    for kind in _KINDS:
        m = kind.search(text, lo, hi)
        if m:
            return m.end()
    return lo


def _last_boundary(text: str, lo: int, hi: int) -> int | None:
    """The last cut in (lo, hi], the stronger kinds first; weak cuts near lo are not taken over strong ones."""
    for kind, least in ((_PARA, lo + (hi - lo) // 2), (_SENT, lo + (hi - lo) // 3), (_LINE, lo + (hi - lo) // 2), (_SENT, lo), (_SPACE, lo)):
        best = None
        for m in kind.finditer(text, least, hi):
            if m.end() > lo:
                best = m.end()
        if best is not None and lo < best <= hi:
            return best
    return None


def _overlap_start(text: str, lo: int, pos: int) -> int:
    """Where the overlap before pos begins, not before lo: a sentence start, else a word start, else lo."""
    for kind in (_SENT, _SPACE):
        m = kind.search(text, lo, pos)
        if m and m.end() < pos:
            return m.end()
    return lo


def cut_range(text: str, lo: int, hi: int, is_first: bool, is_last: bool, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, body, end, kind) for the pieces of the range text[lo:hi]; offsets within text.

    The piece's own body begins at body; text[start:body] repeats the piece before it.
    """
    body_limit = limit - overlap
    pos = lo if is_first else _first_boundary(text, lo, min(len(text), lo + limit))
    stop = len(text) if is_last else _first_boundary(text, hi, min(len(text), hi + limit))
    out, before = [], None
    while pos < stop:
        room = limit if is_first and not out else body_limit
        if stop - pos <= room:
            end, kind = stop, "end"
        else:
            found = _last_boundary(text, pos, pos + room)
            end, kind = (found, "natural") if found else (pos + room, "forced")
        if is_first and not out:
            start = pos
        else:
            start = _overlap_start(text, max(0, pos - overlap, before or 0), pos)
        out.append((start, pos, end, kind))
        before, pos = pos, end
    return out


class Stretch(NamedTuple):
    """One range of a text with its halo: back characters of it stand before the range."""

    range_no: int
    n: int
    base: int
    back: int
    chunk: str


def stretches(text: str, size: int, limit: int, overlap: int) -> Iterator[Stretch]:
    """The ranges of a text; each is a slice of it, so all together take time linear in the text."""
    n = len(text)
    for no in range(max(1, -(-n // size))):
        lo = no * size
        back = min(lo, overlap)
        yield Stretch(no, n, lo - back, back, text[lo - back : lo + size + limit])


def _mapped(df: DataFrame, keys: list[str], schema: str, one, most: int = 10_000) -> DataFrame:
    """Rows that one(row) yields, with the keys kept; handed on after every most rows."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, row in zip(b[keys].itertuples(index=False, name=None), b.itertuples(index=False)):
                for r in one(row):
                    out.append((*k, *r))
                    if len(out) >= most:
                        yield pd.DataFrame(out, columns=[*keys, *names])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names])

    return df.mapInPandas(run, f"{types}, {schema}")


def boundary_runs(rows: DataFrame, keys: list[str], text: str, size: int = RANGE) -> DataFrame:
    """(keys, longest_run): the longest stretch without white space or sentence end in each text.

    Rows of equal keys must have equal texts. Ranges report their first, longest and last
    run; runs that go on over a range end are joined when the ranges are stitched.
    """

    def one(row):
        for r in stretches(row[-1], size, 0, 0):
            parts = [len(p) for p in _BREAK.split(r.chunk)]
            yield r.range_no, r.n <= size, parts[0], max(parts), parts[-1], len(parts) == 1

    table = _mapped(rows.select(*keys, text), keys, "range_no int, alone boolean, head int, longest int, tail int, whole boolean", one)
    alone = table.filter("alone").select(*keys, "longest")
    fold = F.aggregate(
        F.array_sort(F.collect_set(F.struct("range_no", "head", "longest", "tail", "whole"))),
        F.struct(F.lit(0).alias("best"), F.lit(0).alias("open")),
        lambda s, r: F.struct(
            F.greatest(s.best, r.longest, s.open + r["head"]).alias("best"),
            F.when(r.whole, s.open + r["head"]).otherwise(r.tail).alias("open"),
        ),
        lambda s: s.best,
    )
    return alone.unionByName(table.filter("NOT alone").groupBy(*keys).agg(fold.alias("longest"))).withColumnRenamed("longest", "longest_run")


def oversized(rows: DataFrame, keys: list[str], text: str, limit: int = LIMIT) -> DataFrame:
    """(keys, cut): texts longer than limit; 'forced' if a run longer than limit has no boundary, else 'natural'."""
    long = rows.filter(F.length(text) > limit).withColumn("_text_hash", F.xxhash64(text))
    runs = boundary_runs(long, [*keys, "_text_hash"], text)
    return runs.select(*keys, F.when(F.col("longest_run") > limit, "forced").otherwise("natural").alias("cut")).distinct()


def split_texts(rows: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, keep_short: bool = False) -> DataFrame:
    """(keys, piece_no, start, body_start, end, kind, piece) in order; keys must be unique in rows."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    todo = rows.filter(F.col(text).isNotNull() if keep_short else F.length(text) > limit)

    def one_text(row):
        for r in stretches(row[-1], size, limit, overlap):
            is_last = (r.range_no + 1) * size >= r.n
            for i, (s, b, e, kind) in enumerate(cut_range(r.chunk, r.back, r.back + size, r.range_no == 0, is_last, limit, overlap)):
                yield r.range_no, r.n <= size, i, r.base + s, r.base + b, r.base + e, kind, r.chunk[s:e]

    schema = "range_no int, alone boolean, i int, start bigint, body_start bigint, end bigint, kind string, piece string"
    pieces = _mapped(todo.select(*keys, text), keys, schema, one_text)
    done = pieces.filter("alone").select(*keys, (F.col("i") + 1).alias("piece_no"), "start", "body_start", "end", "kind", "piece")
    return done.unionByName(_stitched(pieces.filter("NOT alone"), keys, False))


def _stitched(pieces: DataFrame, keys: list[str], in_bytes: bool) -> DataFrame:
    """Numbers the pieces of texts of several ranges and bounds overlaps that reach over a range start."""
    per_range = pieces.groupBy(*keys, "range_no").agg(F.count("*").alias("n_pieces"), F.max("body_start").alias("last_body"))
    order = Window.partitionBy(*keys).orderBy("range_no")
    table = per_range.select(
        *keys, "range_no",
        F.coalesce(F.sum("n_pieces").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("last_body").over(order).alias("least"),
    )
    joined = pieces.join(table, [*keys, "range_no"])
    start = F.when(F.col("i") == 0, F.greatest("start", F.coalesce("least", F.lit(0)))).otherwise(F.col("start"))
    skip = (start - F.col("start") + 1).cast("int")
    piece = F.decode(F.substring(F.encode("piece", "UTF-8"), skip, F.octet_length("piece")), "UTF-8") if in_bytes else F.substring(F.col("piece"), skip, F.length("piece"))
    return joined.select(*keys, (F.col("before") + F.col("i") + 1).cast("int").alias("piece_no"), start.alias("start"), "body_start", "end", "kind", piece.alias("piece"))


def split_files(spark: SparkSession, paths: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = 64 << 20, with_text: bool = True) -> DataFrame:
    """Pieces of UTF-8 files in a folder that all workers share, by byte range.

    paths has columns path and n_bytes. Each task opens one file, seeks to its range and
    reads it with a halo; limit and overlap are in bytes here.
    """
    n = F.col("n_bytes")
    ranges = paths.filter(n > 0).select("path", n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("range_no"))
    ranges = ranges.repartition(F.col("path"), F.col("range_no"))

    def one(row):
        lo = row.range_no * size
        back = min(lo, overlap)
        with open(row.path, "rb") as f:
            f.seek(lo - back)
            raw = f.read(back + size + limit)
        text = by_bytes(raw)
        is_last = lo + size >= row.n
        for i, (s, b, e, kind) in enumerate(cut_range(text, back, back + size, row.range_no == 0, is_last, limit, overlap)):
            s, b, e = (_char_start(raw, x) for x in (s, b, e))
            yield row.range_no, row.n <= size, i, lo - back + s, lo - back + b, lo - back + e, kind, raw[s:e].decode("utf-8", errors="replace") if with_text else ""

    schema = "range_no int, alone boolean, i int, start bigint, body_start bigint, end bigint, kind string, piece string"
    pieces = _mapped(ranges, ["path"], schema, one)
    done = pieces.filter("alone").select("path", (F.col("i") + 1).alias("piece_no"), "start", "body_start", "end", "kind", "piece")
    return done.unionByName(_stitched(pieces.filter("NOT alone"), ["path"], True))


def by_bytes(raw: bytes) -> str:
    """UTF-8 as a string in which every character takes as many places as it has bytes, so that offsets are bytes.

    White space fills its places with blanks; any other character stands at its last place.
    Bytes that are no UTF-8, as at the ends of a range, take one place each.
    """

    def placed(m: re.Match) -> str:
        c = m[0]
        n = len(c.encode("utf-8", "surrogateescape"))
        return " " * n if c.isspace() else "\x7f" * (n - 1) + ("\x7f" if "\udc80" <= c <= "\udcff" else c)

    return re.sub(r"[^\x00-\x7f]", placed, raw.decode("utf-8", "surrogateescape"))


def _char_start(raw: bytes, at: int) -> int:
    """The nearest offset at or before at that does not split a UTF-8 sequence."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at
