"""Passage dedup over overlapping word windows, wherever a passage starts and however its lines are broken.

Any run of PASSAGE words that stands more than once is found, exactly. A window of words a place would be many times
the text, so a window's anchor is looked at first: the least of its ANCHOR-word hashes, a choice by content alone, so
equal windows have equal anchors. Consecutive windows with one anchor are a block. Windows whose anchor stands in one
block only are unique. Blocks that come again are compared whole, and each but the first covers its words; only where an
anchor has blocks that differ are the windows of the first of each grouped one by one, by 128-bit hashes. Every
occurrence but the first covers its words, and covered words are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Work, at, columns_but, map_batches, packed, pinned, process_cache, spread_join, unpacked, unused
from .line_dedup import BROADCAST_POSITIONS, _row_key
from .shingles import mix, word_hashes

#: Words of a passage and of an anchor.
PASSAGE, ANCHOR = 50, 16
#: Rows of one batch that a worker gives back, or those of one text.
_FLUSH = 1 << 18
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _hashes(text: str | None) -> np.ndarray:
    return word_hashes(text.encode().split()) if text else np.zeros(0, np.uint64)


def _stretches(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """The hash of the words from each start to before its end: a difference of sums of powers, brought to place 0."""
    power, back = _powers(which, len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h) * power[: len(h)])])
    return mix((sums[end] - sums[start]) * back[start])


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the words of every run of a size."""
    at = np.arange(len(h) - size + 1)
    return _stretches(h, at, at + size, 0)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a factor from 0 to n at least, and of its inverse, kept in a worker."""
    cache = process_cache()
    held = cache.get(("passages", which))
    if held is None or len(held[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        factors = _FACTORS[which], pow(_FACTORS[which], -1, 1 << 64)
        held = cache["passages", which] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, f, np.uint64)])) for f in factors)
    return held


def anchors(h: np.ndarray, passage: int, anchor: int, g: np.ndarray | None = None) -> np.ndarray:
    """The anchor of every window of a passage's words; g: the hashes of all runs that may be anchors, if they are there."""
    if len(h) < passage:
        return np.zeros(0, np.uint64)
    g, runs = _runs(h, anchor) if g is None else g, passage - anchor + 1
    low, width = g, 1
    while 2 * width <= runs:  # windows of one, two, four ... places
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    return np.minimum(low[: len(g) - runs + 1], low[runs - width :]) if width < runs else low


def blocks(h: np.ndarray, passage: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the words, odd, first window, windows) of every block; odd: windows of it may be equal."""
    g = _runs(h, anchor) if len(h) >= passage else h
    low = anchors(h, passage, anchor, g)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(low)), bool), low[1:] != low[:-1]]))
    n = np.diff(np.append(at, len(low)))
    if not len(at):
        return low, low, np.zeros(0, bool), at, n
    # Equal windows of one block have its anchor at two places of the runs that the block spans.
    own, spans = low[at], n + passage - anchor
    ends = np.cumsum(spans)
    runs = np.repeat(at - ends + spans, spans) + np.arange(ends[-1])
    times = np.add.reduceat(g[runs] == np.repeat(own, spans), ends - spans, dtype=np.int32)
    return own, _stretches(h, at, at + n - 1 + passage, 0), times > 1, at, n


def _rows(batch: pa.RecordBatch, names: tuple[str, ...], places) -> Iterator[pa.RecordBatch]:
    """One row for each place found in each text, with what names the text; places gives arrays for a text's number."""
    begun, size, found = 0, 0, []
    for i in range(batch.num_rows):
        found.append(places(i))
        size += len(found[-1][0])
        if size >= _FLUSH or i + 1 == batch.num_rows:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            texts = pa.array(np.repeat(np.arange(begun, i + 1), [len(f[0]) for f in found]))
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(texts) for c in ("id", "__k1"))], names=[*names, "id", "__k1"])
            begun, size, found = i + 1, 0, []


def _block_rows(passage: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:

            def places(i: int, b=b) -> tuple[np.ndarray, ...]:
                g, whole, odd, at, n = blocks(_hashes(b.column("t")[i].as_py()), passage, anchor)
                return g.view(np.int64), whole.view(np.int64), odd, at.astype(np.int32), n.astype(np.int32)

            yield from _rows(b, ("g", "whole", "odd", "pos", "n"), places)

    return run


def _window_rows(passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:

            def places(i: int, b=b) -> tuple[np.ndarray, ...]:
                held = np.array(b.column("__at")[i].as_py(), np.int64)
                first, n = held >> 32, held & 0xFFFFFFFF
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                h = _hashes(b.column("t")[i].as_py())
                return *(_stretches(h, at, at + passage, w).view(np.int64) for w in (0, 1)), at.astype(np.int32)

            yield from _rows(b, ("h1", "h2", "pos"), places)

    return run


def _cut(text: str, covered: list[int], passage: int) -> tuple[str, int]:
    """The text without its covered words and the white space between two of them; how many they are.

    Covered are a passage from each of some windows: the first in the upper, their number in the lower 32 bits.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    step = np.zeros(len(spans) + 1, np.int64)
    held = np.array(covered, np.int64)
    np.add.at(step, held >> 32, 1)
    np.add.at(step, (held >> 32) + (held & 0xFFFFFFFF) - 1 + passage, -1)
    gone = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    out, end = [], 0
    for run in np.split(gone, np.flatnonzero(np.diff(gone) > 1) + 1):
        out.append(text[end : spans[run[0]][0]])
        end = spans[run[-1]][1]
    return "".join(out) + text[end:], len(gone)


def _merged(spans: DataFrame, passage: int) -> DataFrame:
    """Spans of a text in order, none of which share a window, as few as cover the same words."""
    first = lambda i: F.shiftright(F.get("s", i), 32)
    end = lambda i: first(i) + F.get("s", i).bitwiseAND(F.lit(0xFFFFFFFF))
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (first(i) > end(i - 1) - 1 + passage))
    d = pinned(spans, "id", "__k1", "s", begins.alias("b"))
    last = lambda k: F.coalesce(F.get("b", k + 1), F.size("s")) - 1
    return d.select("id", "__k1", F.transform("b", lambda i, k: F.shiftleft(first(i), 32) + end(last(k)) - first(i)).alias("__pos"))


def dedup_passages(df: DataFrame, id: str = "doc_id", text: str = "text", passage: int = PASSAGE, anchor: int = ANCHOR) -> DataFrame:
    """The rows with repeated passages removed from text; adds n_words and n_cut (bigint).

    Words stand between white space (space, tab to carriage return) and are compared as they are, so a passage is found
    whatever line breaks it has and wherever in a line it starts. All columns are kept; columns of the added names are
    replaced.

    Edge cases: texts of fewer words than a passage stay. A null text stays null and has no words. Rows with the same
    id and text are one document; a null id counts as the least. The first occurrence is that of the least id, then
    place; within a text a window that overlaps its own earlier occurrence is a later one too.
    """
    if not 0 < anchor <= passage:
        raise ValueError("an anchor has from one word to a passage's")
    work = Work(df.sparkSession, "passages")
    kind = df.schema[id].dataType.simpleString()
    keyed = df.select(at(id).alias("id"), _row_key(id, text)[0], at(text).alias("t"))
    place, span = F.struct("id", "__k1", "pos"), lambda n: F.shiftleft(F.col("pos").cast("bigint"), 32) + n
    found = work.table(keyed.mapInArrow(_block_rows(passage, anchor), f"g long, whole long, odd boolean, pos int, n int, id {kind}, __k1 long"), "blocks")
    # Sums of plain numbers first, which are hashed and not sorted; firsts are sought where an anchor comes again only.
    twice = found.groupBy("g").agg(F.count("*").alias("times"), (F.max("odd") | (F.min("whole") != F.max("whole"))).alias("mixed"))
    twice = work.table(twice.where("times > 1 OR mixed").select("g", "mixed"), "twice")
    few = twice.count() <= BROADCAST_IDS
    held = found.join(F.broadcast(twice), "g") if few else spread_join(found, twice, "g", "inner")
    held = work.table(held.select("g", "whole", "mixed", "id", "__k1", "pos", "n"), "held")
    work.drop("blocks")
    equal = held.groupBy("g", "whole").agg(F.min(place).alias("first")).select("whole", F.col("g").alias("__g"), "first")
    held = spread_join(held, equal, "whole", "inner").where(F.col("g") == F.col("__g"))
    again = ~place.eqNullSafe(F.col("first"))
    held = work.table(held.where(again | F.col("mixed")).select(again.alias("again"), "id", "__k1", span(F.col("n")).alias("span")), "places")

    def joined(left: DataFrame, key: str, right: DataFrame, column: str, how: str) -> DataFrame:
        total = right.agg(F.coalesce(F.sum(F.size(column) + 4), F.lit(0))).first()[0]
        right = right.select(F.col("id").alias("__id"), F.col("__k1").alias("__k"), column)
        return left.join(F.broadcast(right) if total <= BROADCAST_POSITIONS else right, (F.col("__k1") == F.col("__k")) & F.col(key).eqNullSafe(F.col("__id")), how)

    some = work.table(held.where("NOT again").groupBy("id", "__k1").agg(F.collect_set("span").alias("__at")), "mixed")
    some = joined(keyed, "id", some, "__at", "inner").select("id", "__k1", "t", "__at")
    rows = work.table(some.mapInArrow(_window_rows(passage), f"h1 long, h2 long, pos int, id {kind}, __k1 long"), "windows")
    repeats = rows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").select("h1", F.col("h2").alias("__h2"), "first")
    later = spread_join(rows, repeats, "h1", "inner").where((F.col("h2") == F.col("__h2")) & ~place.eqNullSafe(F.col("first")))
    spans = held.where("again").select("id", "__k1", "span").unionByName(later.select("id", "__k1", span(F.lit(1)).alias("span")))
    covered = work.table(_merged(spans.groupBy("id", "__k1").agg(F.sort_array(F.collect_set("span")).alias("s")), passage), "covered")
    for name in ("twice", "held", "places", "mixed", "windows"):
        work.drop(name)

    kept = columns_but(df, ("n_words", "n_cut"))
    docs = joined(df.select(packed(kept), at(id).alias("id"), _row_key(id, text)[0]), "id", covered, "__pos", "left")
    pos = unused(df, "__pos")
    docs = docs.select(*unpacked(kept), F.col("__pos").alias(pos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, words, cut = b.column(text).to_pylist(), [], []
            for i, (t, held) in enumerate(zip(texts, b.column(pos).to_pylist(), strict=True)):
                words.append(len(t.encode().split()) if t else 0)
                if held:
                    texts[i], n = _cut(t, held, passage)
                cut.append(n if held else 0)
            columns = [pa.array(texts, b.column(text).type) if c == text else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, b.column(pos), pa.array(words, pa.int64()), pa.array(cut, pa.int64())], names=[*kept, pos, "n_words", "n_cut"])

    return map_batches(docs, [*kept, pos], run, ("n_words", "bigint"), ("n_cut", "bigint")).drop(pos)
