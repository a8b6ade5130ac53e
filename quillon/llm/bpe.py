"""Byte-level BPE encoding and decoding.

Texts of one chunk are encoded where they are read. Longer texts are cut into overlapping chunks, one row each, which
are pre-tokenised in parallel; the chunks of a text are then stitched where the pre-token boundaries of neighbours
agree again: the pattern never looks back, so from a common boundary on both see the same pre-tokens. The stitched
text is cut at such boundaries into pieces, which are encoded in parallel and put together in order. Decoding
concatenates the bytes of the ids.

Token ids are kept packed, four bytes each, lowest byte first: a binary column needs no boxing on either side.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, at, columns_but, freeing, inside, map_batches, packed, process_cache, unpacked

#: Code points of a chunk, and how far it reaches into the next.
CHUNK, OVERLAP = 65_536, 2_048
#: A match is certain if at least so many characters follow it in the chunk: the public pattern looks no further ahead.
#: WHOLE is for patterns that may look ahead without a bound.
LOOKAHEAD, WHOLE = 3, -1
#: Pre-tokens of more bytes are merged with a heap, whose time doesn't grow with the square.
LONG_PIECE = 4_096
#: Rank files are broadcast; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20
_ROWS = 256


class Coder:
    """The ranks and pattern of one vocabulary, in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, lookahead: int = LOOKAHEAD):
        import tiktoken

        self.lookahead = lookahead

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("quillon", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.long_run = regex.compile(rf"\S{{{LONG_PIECE // 4},}}|\s{{{LONG_PIECE // 4},}}")

    def boundaries(self, text: str, start: int = 0) -> list[int]:
        """Where the pre-tokens of a text end."""
        return [m.end() for m in self.pattern.finditer(text, start)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges as the library's: the lowest rank first, of equal ranks the leftmost."""
        n = len(piece)
        ends, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\x01" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            alive[j] = 0
            ends[i], nxt[i] = ends[j], nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := self.ranks.get(piece[i : ends[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := self.ranks.get(piece[p : ends[i]])) is not None:
                heapq.heappush(heap, (r, p, ends[i]))
        return [self.ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text that starts and ends at a pre-token boundary."""
        if self.long_run.search(text) is None:
            return np.asarray(self.library.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        ids: list[int] = []
        start = 0
        for end in self.boundaries(text):
            piece = text[start:end]
            ids += self._merge_long(b) if len(b := piece.encode()) > LONG_PIECE else self.library.encode_ordinary(piece)
            start = end
        return np.array(ids, dtype="<u4")

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def stitch(coder: Coder, text: str, starts: list[int], ends: list[list[int]], size: int, overlap: int) -> list[int]:
    """The pre-token ends of a whole text from those of its chunks, which are given relative to the chunks' starts.

    Where no boundary of the next chunk agrees within the overlap, the text is matched on until one does.
    """
    out: list[int] = []
    at = 0
    for k, (start, own) in enumerate(zip(starts, ends, strict=True)):
        chunk_end = min(len(text), start + size + overlap)
        sure = [start + e for e in own if chunk_end == len(text) or start + e <= chunk_end - coder.lookahead]
        known = {start, *sure}
        stop = len(text) if k + 1 == len(starts) else starts[k + 1]
        if at >= stop:
            continue
        while at not in known and at < stop:  # not yet in step with this chunk
            at = coder.pattern.match(text, at).end()
            out.append(at)
        if at >= stop:
            continue
        follow = set(ends[k + 1]) if k + 1 < len(ends) else set()
        for e in sure:
            if e <= at:
                continue
            out.append(e)
            at = e
            if at >= stop and (at - stop in follow or at == stop):
                break
    return out


def load_coder(shared: Broadcast) -> Coder:
    raw, pattern, lookahead = shared.value
    cache, key = process_cache(), ("bpe", raw, pattern, lookahead)
    if key not in cache:
        cache[key] = Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}, pattern, lookahead)
    return cache[key]


def share_vocabulary(spark: SparkSession, path: str, pattern: str, lookahead: int | None = None) -> Broadcast:
    """Broadcast a rank file that the driver can read, with its pattern.

    lookahead: the characters behind its end that may decide on a match. The public pattern's is known; others must
    state theirs, or WHOLE where a run of any length may decide (as in `\\s*[\\r\\n]+`): then no text is cut into chunks.
    """
    if lookahead is None:
        import public_tokenizers

        if pattern != public_tokenizers.PATTERN:
            raise ValueError("say how far the pattern looks ahead, or WHOLE")
        lookahead = LOOKAHEAD
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY_BYTES} bytes is not broadcast")
    return spark.sparkContext.broadcast((raw, pattern, lookahead))


def _replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in columns]
    names = [n for n, _ in kept] + list(columns)
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=names)


def encode(df: DataFrame, vocabulary: Broadcast, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """Add tokens (packed ids, binary) and n_tokens (bigint); columns of these names in the input are replaced.

    With decoded, add the column decoded too, as decode does, from the ids where they are made: one pass of workers.

    Edge cases: a null or empty text has no tokens (empty, not null). Texts of any length are encoded whole; the pieces
    of one text are stitched, and its ids joined, by one task. Repeated rows are each encoded. An empty table gives an
    empty result.
    """
    fields = [("tokens", "binary"), ("n_tokens", "bigint"), *([("decoded", "binary")] if decoded else [])]
    kept = columns_but(df, [n for n, _ in fields])
    size = F.char_length(F.coalesce(at(text), F.lit("")))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_coder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                packed = [coder.encode(t).tobytes() if t else b"" for t in batch.column(text).to_pylist()]
                made = {"tokens": pa.array(packed, pa.binary()), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}
                if decoded:
                    made["decoded"] = pa.array(map(coder.decode, packed), pa.binary())
                yield _replaced(batch, made)

    rows = df.select(*map(at, kept))
    if vocabulary.value[2] == WHOLE:
        return map_batches(rows, kept, short, *fields)
    near = map_batches(rows.where(size <= chunk), kept, short, *fields)
    return near.unionByName(_encode_long(rows.where(size > chunk), vocabulary, text, chunk, overlap, [n for n, _ in fields]))


def _encode_long(df: DataFrame, vocabulary: Broadcast, text: str, chunk: int, overlap: int, fields: list[str]) -> DataFrame:
    """Texts of more than one chunk: pre-tokenise chunks, stitch by text, encode pieces, join in order.

    A text and its chunks are one row's cell and never meet those of other rows. The long texts are written out with
    unique row numbers first, so that every later plan sees the same numbers.
    """
    kept = df.columns
    numbered = df.select(packed(kept), F.monotonically_increasing_id().alias("__row"))
    rows = Work(df.sparkSession, "bpe").table(numbered, "long")
    starts = F.sequence(F.lit(0), F.char_length(inside(text)) - 1, F.lit(chunk))
    cut = rows.select("__row", inside(text).alias("__t"), F.posexplode(starts).alias("__k", "__start"))
    cut = cut.select("__row", "__k", F.expr(f"substring(__t, __start + 1, {chunk + overlap})").alias("__part"))

    def pre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_coder(vocabulary)
        for b in batches:
            for i in range(b.num_rows):
                part = b.column("__part")[i].as_py()
                ends = np.array(coder.boundaries(part), dtype="<u4").tobytes()
                yield pa.RecordBatch.from_arrays([b.column("__row").slice(i, 1), b.column("__k").slice(i, 1), b.column("__part").slice(i, 1), pa.array([ends], pa.binary())], names=["__row", "__k", "__part", "__ends"])

    parts = cut.repartition("__row", "__k").mapInArrow(freeing(pre), "__row bigint, __k int, __part string, __ends binary")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        coder = load_coder(vocabulary)
        table = table.sort_by("__k")
        texts = table.column("__part").to_pylist()
        whole = "".join(t if k + 1 == len(texts) else t[:chunk] for k, t in enumerate(texts))
        ends = stitch(coder, whole, [k * chunk for k in range(len(texts))], [np.frombuffer(e, "<u4").tolist() for e in table.column("__ends").to_pylist()], chunk, overlap)
        pieces, start = [], 0
        for i, e in enumerate(ends):
            if e - start >= chunk or i + 1 == len(ends):
                pieces.append(whole[start:e])
                start = e
        n = len(pieces)
        return pa.table({"__row": pa.array([key[0].as_py()] * n, pa.int64()), "__i": pa.array(range(n), pa.int32()), "__piece": pa.array(pieces, pa.string())})

    pieces = parts.groupBy("__row").applyInArrow(join, "__row bigint, __i int, __piece string")

    def enc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_coder(vocabulary)
        for b in batches:
            for i in range(b.num_rows):
                packed = coder.encode(b.column("__piece")[i].as_py()).tobytes()
                plain = coder.decode(packed) if "decoded" in fields else None
                yield pa.RecordBatch.from_arrays([b.column("__row").slice(i, 1), b.column("__i").slice(i, 1), pa.array([packed], pa.binary()), pa.array([plain], pa.binary())], names=["__row", "__i", "__ids", "__plain"])

    coded = pieces.repartition("__row", "__i").mapInArrow(freeing(enc), "__row bigint, __i int, __ids binary, __plain binary")

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        packed = b"".join(table.column("__ids").to_pylist())
        plain = b"".join(table.column("__plain").to_pylist()) if "decoded" in fields else None
        return pa.table({"__row": pa.array([key[0].as_py()], pa.int64()), "tokens": pa.array([packed], pa.binary()), "n_tokens": pa.array([len(packed) // 4], pa.int64()), "decoded": pa.array([plain], pa.binary())})

    joined = coded.groupBy("__row").applyInArrow(whole, "__row bigint, tokens binary, n_tokens bigint, decoded binary")
    return rows.join(joined, "__row").select(*unpacked(kept), *fields)


def decode(df: DataFrame, vocabulary: Broadcast, tokens: str = "tokens") -> DataFrame:
    """Add decoded (binary): the bytes of the packed ids. A null gives a null; an id outside the vocabulary fails.

    A column decoded in the input is replaced. The bytes need not be valid UTF-8 where ids were cut or made up.
    """
    kept = columns_but(df, ("decoded",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_coder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                raw = [None if p is None else coder.decode(p) for p in batch.column(tokens).to_pylist()]
                yield _replaced(batch, {"decoded": pa.array(raw, pa.binary())})

    return map_batches(df, kept, run, ("decoded", "binary"))
