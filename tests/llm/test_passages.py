"""Passage dedup against brute force, on passages that the three-line windows can't see."""

import re

import numpy as np
import pytest

from quillon.llm import line_dedup, passages, queries
from util import docs, prose, rng


def slow(rows, size):
    """{id: (text, words removed)} for rows in order of id."""
    seen, out = set(), {}
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        ws = [t[a:b] for a, b in spans]
        gone = set()
        for p in range(len(ws) - size + 1):
            key = tuple(ws[p : p + size])
            if key in seen:
                gone.update(range(p, p + size))
            seen.add(key)
        kept, end = [], 0
        for n in sorted(gone):
            if n - 1 not in gone:
                kept.append(t[end : spans[n][0]])
            end = spans[n][1]
        out[i] = (None if t is None else "".join(kept) + t[end:], len(gone))
    return out


@pytest.mark.parametrize("size,anchor,limit", [(50, 16, 2_000_000), (6, 2, 0), (5, 5, 2_000_000)])
def test_passages_against_brute_force(spark, monkeypatch, size, anchor, limit):
    monkeypatch.setattr(passages, "BROADCAST_POSITIONS", limit)
    monkeypatch.setattr(passages, "BROADCAST_IDS", limit)
    monkeypatch.setattr(passages, "_FLUSH", max(1, limit // 100_000))
    r = rng(21)
    base = prose(r, 4 * size, 5000)
    ws = base.split(" ")
    texts = [None, "", " \n", base, base, " ".join(ws[:size]), " ".join(ws[: size - 1]), "x " * 3 * size, " ".join(ws).replace(" ", "\n"), "é — " + base]
    for _ in range(25):
        a = r.randrange(3 * size)
        n = r.randrange(size - 2, size + 30)
        texts.append(f"{prose(r, r.randrange(1, 40), 5000)} {' '.join(ws[a : a + n])}{r.choice([' ', chr(10), '  '])}{prose(r, 9, 5000)}")
    texts += [prose(r, 400, 2) for _ in range(3)]
    want = slow(list(enumerate(texts)), size)
    got = {x.doc_id: x for x in passages.dedup_passages(docs(spark, texts, ["n_cut", "pos", "h1"]), passage=size, anchor=anchor).collect()}
    for i, t in enumerate(texts):
        assert (got[i].text, got[i].n_cut) == want[i], i
        assert got[i].n_words == len((t or "").encode().split())
    assert passages.dedup_passages(docs(spark, [])).collect() == []


def test_op7_finds_a_passage_inside_a_line(spark, tmp_path):
    """Over 50 words on one line, begun within it: lines keep it, words don't."""
    r = rng(22)
    shared = prose(r, 60, 10**6)
    texts = [f"{prose(r, 5, 10**6)} {shared} {prose(r, 4, 10**6)}", f"one\n{prose(r, 8, 10**6)} {shared}\nend"]
    path = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    lines = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    assert shared in lines[0] and shared in lines[1]
    got = {x.doc_id: x for x in queries.queries()["op7_passage_dedup"](spark, str(path)).collect()}
    assert got[0].text == texts[0] and shared not in got[1].text and got[1].n_cut == 60


def test_equal_windows_have_equal_anchors():
    h = np.random.default_rng(5).integers(0, 2, 600, dtype=np.uint64)
    low, seen = passages.anchors(h, 9, 4), {}
    assert len(low) == len(h) - 8 and not len(passages.anchors(h[:8], 9, 4))
    for p, a in enumerate(low):
        assert seen.setdefault(tuple(h[p : p + 9]), a) == a
    own, _, odd, at, n = passages.blocks(h, 9, 4)
    assert n.sum() == len(low)
    for a, o, p, k in zip(own, odd, at, n, strict=True):
        assert (low[p : p + k] == a).all() and (o or len({tuple(h[q : q + 9]) for q in range(p, p + k)}) == k)
