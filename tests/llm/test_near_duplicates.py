import itertools

import pytest
from pyspark.sql import functions as F

from quillon.llm import components, line_dedup, minhash
from quillon.llm.common import Work
from util import docs, edited, prose, rng


def shingles(text, k):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, percent):
    """Least reachable id of every id, by all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def corpus(seed, n=50):
    r = rng(seed)
    base = prose(r, 160, 5000)
    out = [None, "", " \n", "one", "one", "One", "two words", "two  words", base, base, base.upper()]
    out += [edited(r, base, r.randrange(1, 14)) for _ in range(n)]
    out += [prose(r, 160, 5000) for _ in range(10)]
    for _ in range(4):
        b = prose(r, 80, 5000)
        out += [b, edited(r, b, 1), edited(r, b, 4), edited(r, b, 3)]
    return out


@pytest.mark.parametrize("k,percent,block,sets,seed", [(3, 85, 1024, 2_000_000, 277), (5, 80, 1024, 2_000_000, 272), (3, 85, 16, 2_000_000, 89), (5, 80, 4, 900, 91)])
def test_components_against_all_pairs(spark, monkeypatch, k, percent, block, sets, seed):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", sets)
    texts = corpus(seed)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts, ["kept", "component_id", "key"]), k=k, percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute(list(enumerate(texts)), k, percent)
    for i, t in enumerate(texts):
        assert got[i].n_shingles == len(shingles(t, k)) and got[i].kept == (got[i].component_id == i)


def test_text_ids(spark):
    r = rng(31)
    a, b = prose(r, 90), prose(r, 90)
    rows = [("d-2", a), ("d-10", edited(r, a, 1)), ("é", a), (None, a), ("d-7", b), ("", "")]
    got = {x.doc_id: (x.component_id, x.kept) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"d-2": ("d-10", False), "d-10": ("d-10", True), "é": ("d-10", False), None: (None, True), "d-7": ("d-7", True), "": ("", True)}
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").withColumn("rank", F.lit(1)))
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["", "None", "d-10", "d-7"]


def test_groups_that_batches_cut():
    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(1)
    keys = np.sort(g.integers(0, 30, 200))
    for size in (1, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size])], names=["k"]) for i in range(0, 200, size)]
        seen = [(t["k"].to_pylist(), e.tolist()) for t, e in minhash._whole_groups(iter(batches), ["k"])]
        assert sum((k for k, _ in seen), []) == keys.tolist()
        assert all(not set(a) & set(b) for (a, _), (b, _) in itertools.combinations(seen, 2))
        for ks, ends in seen:
            assert [ks[e - 1] for e in ends] == ks and all(e == len(ks) or ks[e] != k for k, e in zip(ks, ends, strict=True))


def test_a_group_just_under_the_threshold_writes_few_links(spark, monkeypatch):
    """Copies of one text, each with so many edits that hardly any two are linked: links stay below the members."""
    r = rng(33)
    base = prose(r, 200, 50_000)
    texts = [edited(r, base, 7) for _ in range(150)]
    made, whole = [], minhash._joining
    monkeypatch.setattr(minhash, "_joining", lambda *a: made.append(whole(*a)) or made[0])
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)), 5, 80)
    assert made[0].count() < len(texts)


def test_null_and_repeated_ids(spark):
    r = rng(9)
    a, b = prose(r, 60), prose(r, 60)
    df = spark.createDataFrame([(5, a), (5, a), (7, a), (None, a), (9, b), (7, b), (None, None)], "doc_id long, text string")
    got = sorted(((str(x.doc_id), str(x.component_id), x.kept) for x in minhash.near_duplicates(df).collect()))
    assert got == sorted([("5", "5", True), ("5", "5", True), ("7", "5", False), ("7", "5", False), ("9", "5", False), ("None", "None", True), ("None", "None", True)])
    left = minhash.drop_near_duplicates(df)
    assert sorted(str(x.doc_id) for x in left.collect()) == ["5", "None", "None"]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_unlike_texts_of_one_id_stay(spark):
    r = rng(10)
    a, b, c, d = (prose(r, 90, 10**6) for _ in range(4))
    rows = [(1, a), (1, b), (1, edited(r, b, 1)), (1, a), (1, None), (1, ""), (2, a), (2, c), (3, d), (3, d), (4, edited(r, d, 1)), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit(1))
    got = [(x.doc_id, x.text) for x in minhash.drop_near_duplicates(df).collect()]
    assert len(got) == 6 and set(got) - {(1, rows[2][1])} <= {(1, a), (1, b), (1, None), (1, ""), (3, d), (None, a)}
    assert sum(t in (b, rows[2][1]) for _, t in got) == 1 and minhash.drop_near_duplicates(df.limit(0)).collect() == []


def test_connected_components(spark):
    r = rng(4)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    loose = [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    edges = [*chain, *star, *loose, (5, 5), (141, 140), (141, 140)]
    got = {x.u: x.v for x in components.components(spark.createDataFrame(edges, "u long, v long"), Work(spark, "t"), "c").collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def slow_lines(rows, window=3):
    """(id, text) in order of id: the text without covered lines."""
    seen, out = {}, {}
    places = []
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [n for n, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        for p in range(len(full) - window + 1):
            key = tuple(lines[n].strip(" \t\x0b\x0c\r") for n in full[p : p + window])
            places.append((i, full[p : p + window], key))
    gone = {}
    for i, nums, key in places:
        if key in seen:
            gone.setdefault(i, set()).update(nums)
        seen[key] = True
    for i, t in rows:
        out[i] = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))
    return out, {i: len(g) for i, g in gone.items()}


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_lines_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_POSITIONS", limit)
    r = rng(6)
    lines = [prose(r, 6) for _ in range(14)]
    texts = [None, "", "\n\n", "a\nb", "a\nb", "x\n" * 40, "\n".join(lines), "\n\n  ".join(lines[2:7]), " \t".join(lines)]
    texts += ["\n".join(r.choice(lines + ["", " "]) for _ in range(r.randrange(1, 30))) for _ in range(40)]
    texts += ["\n".join(lines[:3]), "\n".join(["new", *lines[:3], "new"]), "a\r\nb\r\nc", "a\nb\nc"]
    want, gone = slow_lines(list(enumerate(texts)))
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs(spark, texts, ["n_removed", "pos", "h1"])).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == want[i], i
        assert got[i].n_removed == gone.get(i, 0) and got[i].n_lines == (0 if t is None else len(t.split("\n")))


def test_lines_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "q\nr\ns"), (3, "q\nr\ns")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.text) for x in line_dedup.dedup_lines(df).collect())
    assert got == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("2", ""), ("3", ""), ("None", "q\nr\ns")]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
    assert line_dedup.dedup_lines(df.where(F.col("doc_id") == 99)).count() == 0
