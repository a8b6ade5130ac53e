"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A benchmark item is short and a document long, so the two sets' own minima rarely meet. Containment is estimated from
the item's side: under each universal hash function the minimum of an item is one of its shingles, and lies in a
document's set with a chance equal to the share of the item that the document contains.

Documents are partitioned by size, in powers of two, and each partition has settings of its own, derived from its bound
(settings): how many minima of an item are looked up, and how many must be seen. Longer documents hold more shingles by
chance, so they are asked for more. An item that the bound shows to be too large for a partition's documents isn't
looked for there. The least number seen keeps the chance to miss an item at the threshold below MISS in every partition.
Candidates are verified by exact containment of the item's whole shingle set.

The benchmark is held in blocks of bounded size; all blocks are looked up in one pass over the documents, one block in
memory at a time. There is no shuffle, so common passages gather in no task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import at, columns_but, map_batches, share, shared
from .shingles import universal, windows, word_hashes

#: Words of a shingle, least containment in percent, chance to miss an item at the threshold.
SHINGLE, PERCENT, MISS = 5, 80, 1e-9
#: Minima of an item that are kept, at most.
MINIMA = 48
#: Characters of benchmark texts in a block, and what an item counts besides its own: some three bytes are held for each.
BLOCK_CHARS, ITEM_CHARS = 16_000_000, 400
#: All ASCII but letters and digits parts words.
_CUT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    return text.encode().lower().translate(_CUT).split() if text else []


def settings(part: int, percent: int) -> tuple[int, int]:
    """Minima looked up and least number seen in documents of fewer than 2**part shingles.

    A minimum is in a document with the chance of the item's containment, so the number seen is binomial. Two minima
    more for every doubling of the size; as few seen as keep the chance of a miss below MISS.
    """
    share = percent / 100
    n = MINIMA if share < 0.5 else min(MINIMA, math.ceil(math.log(MISS) / math.log1p(-share)) if share < 1 else 1)
    n = min(MINIMA, n + 2 * max(0, part - 6))
    seen, below = 0, 0.0
    while seen < n and (below := below + math.comb(n, seen) * share**seen * (1 - share) ** (n - seen)) <= MISS:
        seen += 1
    return n, max(1, seen)


class Index:
    """The items of one block, and the inverted index of their minima, in which each has its rank."""

    def __init__(self, items: list[tuple[object, str]], k: int, percent: int):
        a, b = universal(MINIMA, seed=11)
        self.k, self.percent, self.ids, self.sets, width = k, percent, [], [], []
        low = np.zeros((len(items), MINIMA), np.uint64)
        for item, text in items:
            h = word_hashes(plain_words(text))
            if len(h):
                s = np.unique(windows(h, k))
                low[len(self.ids)] = s[np.concatenate([(s[None, :] * a[j : j + 8, None] + b[j : j + 8, None]).argmin(axis=1) for j in range(0, MINIMA, 8)])]
                self.ids.append(item)
                self.sets.append(s)
                width.append(min(k, len(h)))
        self.low, self.width, self.size = low[: len(self.ids)], np.array(width, int), np.array([len(s) for s in self.sets], int)
        self.asks = [settings(part, percent) for part in range(64)]
        self.parts = {w: self._part(np.flatnonzero(self.width == w)) for w in np.unique(self.width).tolist()}

    def _part(self, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """The sorted minima of some items, where the owners of each begin and end, the owners, the ranks that the
        minima have with them, and which minima there may be, by their first bits."""
        flat = self.low[own].ravel()
        order = np.argsort(flat, kind="stable")
        keys, start = np.unique(flat[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[keys >> np.uint64(44)] = True
        return keys, np.append(start, len(flat)), np.repeat(own, MINIMA)[order].astype(np.int32), np.tile(np.arange(MINIMA, dtype=np.int8), len(own))[order], bits

    def _seen(self, s: np.ndarray, width: int) -> np.ndarray:
        """The items of which a set of shingles holds as many minima as its size partition asks for."""
        keys, start, owner, rank, bits = self.parts[width]
        part = len(s).bit_length()
        looked, least = self.asks[part]
        if len(s) > 8 * len(keys):  # a document far larger than the index
            s = np.sort(s)
            hit = np.flatnonzero(s[np.minimum(np.searchsorted(s, keys), len(s) - 1)] == keys)
        else:
            s = s[bits[s >> np.uint64(44)]]
            place = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            hit = np.unique(place[keys[place] == s])
        if not len(hit):
            return hit
        at = np.concatenate([np.arange(start[x], start[x + 1]) for x in hit.tolist()])
        at = at[(rank[at] < looked) & (self.percent * self.size[owner[at]] <= 100 * ((1 << part) - 1))]
        found, times = np.unique(owner[at], return_counts=True)
        return found[times >= least]

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items that a document's words may contain, with its set of shingles of their width."""
        for width in self.parts:
            if len(h) >= width:
                s = windows(h, width)
                if len(likely := self._seen(s, width)):
                    s = np.unique(s)
                    for x in likely.tolist():
                        yield x, s

    def search(self, hashes: list[np.ndarray]) -> list[list[dict]]:
        """For each document, given as word hashes, the items that it contains."""
        out: list[list[dict]] = [[] for _ in hashes]
        for found, h in zip(out, hashes, strict=True):
            for x, s in self.candidates(h):
                own = self.sets[x]
                place = np.minimum(np.searchsorted(s, own), len(s) - 1)
                if 100 * (n := int((s[place] == own).sum())) >= self.percent * len(own):
                    found.append({"item_id": self.ids[x], "n_shingles": len(own), "n_shared": n})
        return out


def _blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of bounded size, one at a time; an item is never cut."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.where(at(text).isNotNull()).select(at(id).alias("i"), at(text).alias("t")).distinct().toLocalIterator():
        if size and size + len(row.t) + ITEM_CHARS > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t) + ITEM_CHARS
    if block:
        yield block


def find_benchmark(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Add items: the benchmark items of which a text contains at least the given percentage of shingles.

    A struct of an item has item_id (of the benchmark's type), n_shingles and n_shared. A column items in the input is
    replaced, all others are kept.

    Edge cases: a null or empty text contains nothing; null or wordless items are contained in nothing; an item with
    fewer than five words is one shingle, its whole sequence. Repeated rows get the same items; repeated items (same
    id and text) count once, items with a null id are reported with a null. Items are in order of their ids' text,
    nulls last. Empty tables on either side are fine.
    """
    spark = df.sparkSession
    kept = columns_but(df, ("items",))
    kind = benchmark.schema[item_id].dataType.simpleString()
    held = [share(spark, Index(block, width, percent)) for block in _blocks(benchmark, item_id, item_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [word_hashes(plain_words(t.as_py())) for t in batch.column(text)]
            found: list[list[dict]] = [[] for _ in hashes]
            for block in held:
                for mine, new in zip(found, shared(block).search(hashes), strict=True):
                    mine += new
            for mine in found:
                mine.sort(key=lambda x: (x["item_id"] is None, str(x["item_id"]).rjust(20)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(item))], names=[*kept, "items"])

    from pyspark.sql.pandas.types import to_arrow_type

    item = pa.struct([("item_id", to_arrow_type(benchmark.schema[item_id].dataType)), ("n_shingles", pa.int64()), ("n_shared", pa.int64())])
    return map_batches(df, kept, run, ("items", f"array<struct<item_id:{kind},n_shingles:bigint,n_shared:bigint>>"))
