"""Near-duplicates by MinHash: many universal hash minima, banding, signature verification, connected components.

1. Sketch (one pass over the texts): the number of shingles, a 128-bit key of the whole set, and the keys of all bands.
   Texts with equal sets are one class; its least id represents it. Only classes go on.
2. Buckets: classes that share a band key. The leader of a bucket is its member with the largest buckets in sum, which
   in a group of edited copies is close to the unedited text.
3. Every class is held against the leader that it shares most buckets with, then against its other leaders, where they
   are not yet in one component: signatures first, then the full sets.
4. Buckets that still hold more than one component are worked through whole, whatever their size, in blocks of bounded
   size: signatures find the members that may be linked with another component; those members meet again with their
   full sets. A pair counts in the lowest band that it shares only, and a link is written out only if it joins two
   components that the task hasn't joined, so a bucket gives fewer rows than it has members. No pair is written out.

The number of bands is chosen for a chance below MISS to lose a pair at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, at, freeing, join_ids, spread_join, unused
from .components import components
from .shingles import minima, mix, overlap, shingle_set, universal

#: Minima of a band, and the chance to lose a pair at the threshold.
ROWS, MISS = 5, 1e-8
#: Signatures of a bucket are compared in blocks of so many members, which grow beyond so many blocks: each block is
#: copied once for each other one. Full sets are compared in blocks of so many shingles, of members that may be linked.
BLOCK_MEMBERS, MAX_BLOCKS, BLOCK_SHINGLES = 1_024, 32, 2_000_000
_OUT, _CHUNK = 256, 1 << 16


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def least_agreement(n: int, threshold: float) -> int:
    """Minima that two signatures share at the threshold, less 6.5 standard deviations."""
    return max(1, math.floor(n * threshold - 6.5 * math.sqrt(n * threshold * (1 - threshold))))


class _Plan:
    """The numbers that all steps share."""

    def __init__(self, k: int, percent: int, rows: int):
        self.k, self.percent, self.rows = k, percent, rows
        self.bands = n_bands(percent / 100, rows)
        self.a, self.b = universal(self.bands * rows)
        self.agree = least_agreement(self.bands * rows, percent / 100)

    def linked(self, common, n, m):
        return 100 * common >= self.percent * (n + m - common)


    def band_keys(self, low: np.ndarray) -> np.ndarray:
        """The keys of all bands, given the minima; no two bands have a key in common."""
        m = low.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
        return key.view(np.int64)


def _binary(xs: list) -> pa.Array:
    return pa.array(xs, pa.binary())


def _sketch(docs: DataFrame, plan: _Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _OUT):
                batch = whole.slice(at, _OUT)
                n, keys, bands = [], [], []
                for text in batch.column("text"):
                    s = shingle_set(text.as_py(), plan.k)
                    n.append(len(s))
                    if not len(s):
                        keys.append(None)
                        bands.append(None)
                        continue
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(plan.band_keys(minima(s, plan.a, plan.b)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), _binary(keys), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "key", "bands"])

    return docs.mapInArrow(freeing(run), "id bigint, n bigint, key binary, bands array<bigint>")


def _sets(docs: DataFrame, plan: _Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _OUT):
                batch = whole.slice(at, _OUT)
                ids, n, sig, bands, sets = [], [], [], [], []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                    s = shingle_set(text.as_py(), plan.k)
                    if len(s):
                        ids.append(i)
                        n.append(len(s))
                        low = minima(s, plan.a, plan.b)
                        sig.append((low >> np.uint64(40)).astype(np.uint8).tobytes())
                        bands.append(plan.band_keys(low).tobytes())
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), _binary(sig), _binary(bands), _binary(sets)], names=["id", "n", "sig", "bands", "set"])

    return docs.mapInArrow(freeing(run), "id bigint, n bigint, sig binary, bands binary, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, plan: _Plan) -> DataFrame:
    """The links (u, v) among pairs (hub, id), by signatures and then by full sets."""
    mine = sets.select("id", F.col("sig").alias("sig1"), F.col("set").alias("set1"))
    hubs = sets.select(F.col("id").alias("hub"), F.col("sig").alias("sig2"), F.col("set").alias("set2"))
    both = spread_join(spread_join(pairs, mine, "id", "inner"), hubs, "hub", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for i in range(b.num_rows):
                if (np.frombuffer(b["sig1"][i].as_buffer(), np.uint8) == np.frombuffer(b["sig2"][i].as_buffer(), np.uint8)).sum() < plan.agree:
                    continue
                x, y = np.frombuffer(b["set1"][i].as_buffer(), np.uint64), np.frombuffer(b["set2"][i].as_buffer(), np.uint64)
                if plan.linked(overlap(x, y), len(x), len(y)):
                    u.append(b["id"][i].as_py())
                    v.append(b["hub"][i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.select("id", "sig1", "set1", "hub", "sig2", "set2").mapInArrow(freeing(run), "u bigint, v bigint")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that part no group of equal keys, and for each row where its group ends."""

    def made(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows + 1, bool)
        new[-1] = True
        for k in keys:
            c = t[k].to_numpy()
            new[1:-1] |= c[1:] != c[:-1]
        ends = np.flatnonzero(new)
        return t, np.repeat(ends, np.diff(ends, prepend=0))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
        cut = int(other[-1]) + 1 if len(other) else 0  # where the last group begins
        if cut:
            yield made([*held, b.slice(0, cut)])
            held = []
        elif held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield made(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield made(held)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _likely(t: pa.Table, ends: np.ndarray, plan: _Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, of different components, whose signatures agree; each pair of blocks has its own."""
    comp, block, same = t["comp"].to_numpy(), t["block"].to_numpy(), t["i"].to_numpy() == t["j"].to_numpy()
    sig = _matrix(t["sig"], np.uint8)
    x, d = np.arange(t.num_rows), 1
    while len(x := x[x + d < ends[x]]):
        y = x + d
        ok = (comp[x] != comp[y]) & (same[x] | (block[x] != block[y]))
        u, v = x[ok], y[ok]
        for k in range(0, len(u), _CHUNK):
            p, q = u[k : k + _CHUNK], v[k : k + _CHUNK]
            hit = (sig[p] == sig[q]).sum(axis=1) >= plan.agree
            if hit.any():
                yield p[hit], q[hit]
        d += 1


def _blocks(members: DataFrame, parts: Column, sets: DataFrame) -> DataFrame:
    """Members of each band key with columns of sets, dealt by pairs of blocks; members has band, id, comp.

    The sets are fetched once for each id rather than for each bucket; an id has no more buckets than there are bands.
    """
    b = members.withColumn("parts", parts.cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    by_id = b.groupBy("id", "comp").agg(F.collect_list(F.struct("band", "block", "parts")).alias("places"))
    rows = spread_join(by_id, sets, "id", "inner").withColumn("place", F.explode("places")).drop("places").select("*", "place.band", "place.block", "place.parts")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp"]
    return rows.select(*keys, *sets.columns).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _partners(blocks: DataFrame, plan: _Plan) -> DataFrame:
    """(band, id, comp) of the members that may be linked with a member of another component, by signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in _whole_groups(batches, ["band", "i", "j"]):
            hit = np.zeros(t.num_rows, bool)
            for x, y in _likely(t, ends, plan):
                hit[x] = hit[y] = True
            if hit.any():
                yield from t.select(["band", "id", "comp"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return blocks.mapInArrow(freeing(run), "band bigint, id bigint, comp bigint")


def _joining(blocks: DataFrame, plan: _Plan) -> DataFrame:
    """Links (u, v), verified on the full sets, that join components; blocks has sig, bands and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for t, ends in _whole_groups(batches, ["band", "i", "j"]):
            band, comp, ids, bands = t["band"].to_numpy(), t["comp"].to_numpy(), t["id"].to_numpy(), _matrix(t["bands"], np.int64)
            sets = t["set"].combine_chunks()
            of = lambda i, sets=sets: np.frombuffer(sets[i].as_buffer(), np.uint64)
            u, v = [], []
            for x, y in _likely(t, ends, plan):
                lowest = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == band[x]
                for i, j in zip(x[lowest].tolist(), y[lowest].tolist(), strict=True):
                    if (p := find(int(comp[i]))) == (q := find(int(comp[j]))):
                        continue
                    a, b = of(i), of(j)
                    if plan.linked(overlap(a, b), len(a), len(b)):
                        root[max(p, q)] = min(p, q)
                        u.append(int(ids[i]))
                        v.append(int(ids[j]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return blocks.mapInArrow(freeing(run), "u bigint, v bigint")


def _labelled(df: DataFrame, labels: DataFrame, key: str, out: str) -> DataFrame:
    """Add the component of a class; a class without a label is its own."""
    names = labels.select(F.col("u").alias(key), F.col("v").alias("__c"))
    return spread_join(df, names, key, "left").withColumn(out, F.coalesce("__c", key)).drop("__c")


def _merged(labels: DataFrame, links: DataFrame, work: Work, name: str) -> DataFrame:
    """Labels after more links: only components are linked anew, then all labels follow."""
    ends = _labelled(_labelled(links, labels, "u", "cu"), labels, "v", "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    more = components(ends, work, f"{name}-links")
    moved = _labelled(labels.select("u", F.col("v").alias("old")), more, "old", "v").select("u", "v")
    return work.table(moved.unionByName(more).distinct(), name)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row a document: the id, n_shingles, component_id and kept.

    Words are lower-cased (A-Z) and cut at white space; a document's set has its distinct k-word shingles, with fewer
    words the whole sequence. Documents are linked if 100 * intersection >= percent * union.

    Edge cases: a document without words (or a null text) has an empty set and is linked with nothing. A null id takes
    no part: its component is null and it is kept. Rows that share an id are one document: they share a component,
    and each is returned. An empty table gives an empty result. Other columns are left out. Texts are used whole.
    Ids may be of any type that sorts; those that aren't whole numbers are numbered in order first, which shuffles the
    texts once. Sets are compared by 128-bit and shingles by 64-bit hashes.
    """
    spark = df.sparkSession
    work, plan = Work(spark, "minhash"), _Plan(k, percent, rows)
    docs = df.select(at(id).alias("id"), at(text).alias("text"))
    names = None
    if not isinstance(df.schema[id].dataType, T.IntegralType):
        order = docs.where("id IS NOT NULL").select("id").distinct().orderBy("id")
        names = work.table(order.select(F.monotonically_increasing_id().alias("__n"), "id"), "names")
        docs = spread_join(docs, names, "id", "left").select(F.col("__n").alias("id"), "text")
    docs = docs.select(F.col("id").cast("bigint").alias("id"), "text")
    sketch = work.table(_sketch(docs, plan), "sketch")
    taking = sketch.where("n > 0 AND id IS NOT NULL")
    classes = work.table(taking.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    repeated = bool(taking.groupBy("id").count().where("count > 1").limit(1).count())

    bands = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = work.table(spread_join(bands, sizes, "band", "inner").select("band", "id", "size"), "members")
    central = work.table(members.groupBy("id").agg(F.sum("size").alias("weight")), "central")
    n_members = central.count()
    leaders = members.join(central, "id").groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("l"))
    leaders = leaders.select("band", (-F.col("l.id")).alias("hub"))
    pairs = spread_join(members.select("band", "id"), leaders, "band", "inner").where("id <> hub")
    pairs = work.table(pairs.groupBy("id", "hub").agg(F.count("*").alias("shared")), "pairs")

    wanted = join_ids(docs.where("id IS NOT NULL"), central.select("id"), "id", "left_semi", n_members)
    sets = _sets(wanted.dropDuplicates(["id", "text"]) if repeated else wanted, plan)
    sets = work.table(sets, "sets")

    best = pairs.groupBy("id").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"))).alias("b")).select("id", (-F.col("b.hub")).alias("hub"))
    links = _verified(best, sets, plan)
    if repeated:
        same = spread_join(taking.select("key", "id"), classes.select("key", "rep"), "key", "inner")
        firsts = same.groupBy("id").agg(F.min("rep").alias("u"))
        links = links.unionByName(same.join(firsts, "id").select("u", F.col("rep").alias("v")))
    labels = components(links, work, "first")

    rest = _labelled(_labelled(pairs.select("id", "hub"), labels, "id", "c1"), labels, "hub", "c2").where("c1 <> c2").select("id", "hub")
    labels = _merged(labels, work.table(_verified(rest, sets, plan), "links-2"), work, "second")

    # What is left: buckets with more than one component.
    known = _labelled(members, labels, "id", "comp")
    mixed = known.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    mixed = work.table(spread_join(known, mixed, "band", "inner").select("band", "id", "size", "comp"), "mixed")
    parts = F.least(F.ceil(F.col("size") / BLOCK_MEMBERS), F.lit(MAX_BLOCKS))
    close = work.table(_partners(_blocks(mixed, parts, sets.select("id", "sig")), plan).distinct(), "close")
    sizes = spread_join(close.select("id", "band"), sets.select("id", "n"), "id", "inner").groupBy("band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    close = spread_join(close, sizes, "band", "inner")
    links = _joining(_blocks(close, F.col("parts"), sets.select("id", "sig", "bands", "set")), plan)
    labels = _merged(labels, work.table(links, "links-3"), work, "third")

    named = _labelled(classes.select("key", F.col("rep")), labels, "rep", "component_id").select("key", "component_id")
    linked = spread_join(taking.select("id", "n", "key"), named, "key", "inner")
    alone = sketch.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    done = linked.select("id", "n", "component_id").unionByName(alone).select("id", "n", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    if names is not None:
        for c in ("id", "component_id"):
            done = spread_join(done.withColumnRenamed(c, "__n"), names.withColumnRenamed("id", c), "__n", "left").drop("__n")
    return done.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose document stays: the least id of each component, and all rows with a null id.

    All columns are kept. Rows that share an id are linked with other ids, and go, together. If their id stays, so does
    one row of each group of near-duplicates among them, that of the least text hash: texts that aren't alike all stay.
    """
    spark = df.sparkSession
    work = Work(spark, "minhash-drop")
    found = work.table(near_duplicates(df, id, text, k, percent), "found")
    gone = found.where(~F.col("kept")).select(at(id)).distinct()
    left = join_ids(df, gone, id, "left_anti", gone.count())
    many = found.where(F.col("kept") & at(id).isNotNull()).groupBy(at(id)).agg(F.count("*").alias("__n")).where("__n > 1").select(at(id))
    many = work.table(many, "repeated")
    if not (n := many.count()):
        return left
    pair = unused(df, "pair")
    each = F.struct(at(id).alias("id"), F.xxhash64(at(text)).alias("h1"), F.xxhash64(F.lit(1), at(text)).alias("h2"))
    again = work.table(join_ids(left, many, id, "left_semi", n).withColumn(pair, each).dropDuplicates([pair]), "again")
    near = near_duplicates(again, pair, text, k, percent).where(~F.col("kept")).select(at(pair))
    near = work.table(near, "near")
    stay = join_ids(again, near, pair, "left_anti", near.count()).drop(pair)
    return join_ids(left, many, id, "left_anti", n).unionByName(stay)
