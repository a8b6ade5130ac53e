"""Every template with seeded replacements, insertions and deletions up to the threshold, against full alignment."""

import random

import numpy as np
import pytest

from quillon.llm import licenses
from quillon.llm.decontam import plain_words
from quillon.llm.shingles import word_hashes
from util import docs

INDEX = licenses.Templates(licenses.TEMPLATES)


def slow(template, words):
    """Best local score and the most matched words among alignments of that score: the plain recurrence."""
    m, n = len(template), len(words)
    row, best = [(0, 0)] * (m + 1), (0, 0)
    for j in range(n):
        new = [(0, 0)]
        for i in range(m):
            s, c = row[i]
            cell = max((s + 2, c + 1) if template[i] == words[j] else (s - 1, c), (row[i + 1][0] - 1, row[i + 1][1]), (new[i][0] - 1, new[i][1]))
            new.append(cell if cell[0] > 0 else (0, 0))
        row = new
        best = max(best, *row)
    return best


def test_align_against_the_plain_recurrence():
    r = random.Random(4)
    for _ in range(300):
        a = [r.randrange(4) for _ in range(r.randrange(1, 9))]
        b = [r.randrange(4) for _ in range(r.randrange(0, 25))]
        n, start, end = licenses.align(np.array(a, np.uint64), np.array(b, np.uint64), 0, None)
        score, matched = slow(a, b)
        assert n == matched and (score == 0 or slow(a, b[start:end]) == (score, matched))


def changed(r, ws, replaced, dropped, put):
    """That many words replaced, left out, and places with one to six words put in."""
    out = list(ws)
    places = r.sample(range(len(ws)), replaced + dropped)
    for k, p in enumerate(places):
        out[p] = f"x{r.randrange(10**6)}" if k < replaced else ""
    for p in r.sample(range(len(ws)), min(put, len(ws))):
        out[p] = " ".join([f"y{r.randrange(10**6)}" for _ in range(r.choice([1, 1, 2, 6]))]) + " " + out[p]
    return " ".join(w for w in out if w)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_recall_at_the_threshold(name):
    """1.00 of what full alignment finds, with as many changed words as the threshold allows and as many places."""
    r = random.Random(name)
    ws = [w.decode() for w in plain_words(licenses.TEMPLATES[name])]
    own = word_hashes(plain_words(licenses.TEMPLATES[name]))
    spare = len(ws) - licenses.needed(len(ws), licenses.PERCENT)
    around = ["before it", "the license under the terms of this", "and all of the software is"]
    counted = 0
    for k in range(200):
        replaced = r.randrange(spare + 1) if k % 2 else spare
        dropped = r.randrange(spare - replaced + 1)
        text = f"{r.choice(around)} {changed(r, ws, replaced, dropped, r.randrange(spare + 1) if k % 3 else 0)} {r.choice(around)}"
        n, *_ = licenses.align(own, word_hashes(plain_words(text)), 0, None)
        got = [x["n_matched"] for x in INDEX.scan(text, licenses.PERCENT) if x["license"] == name]
        assert got == ([n] if n >= licenses.needed(len(own), licenses.PERCENT) else []), text
        counted += bool(got)
    assert counted > 20


def test_words_in_the_middle_and_places_side_by_side():
    gpl = licenses.TEMPLATES["GPL-3.0-header"].split(" ")
    text = " ".join(gpl[:40] + [f"z{i}" for i in range(25)] + gpl[40:])
    assert [(x["n_matched"], x["n_words"]) for x in INDEX.scan(text, 80) if x["license"] == "GPL-3.0-header"] == [(80, 80)]
    mit = "Released under the MIT License. "
    assert [x["start"] for x in INDEX.scan(mit * 3, 80)] == [0, len(mit), 2 * len(mit)]
    assert INDEX.scan("under the " * 500, 80) == []


def test_columns_with_odd_names(spark):
    from pyspark.sql import functions as F

    df = docs(spark, ["All rights reserved.", None]).withColumn("a.b", F.struct(F.lit(1).alias("x y"), F.lit("q").alias("`")))
    rows = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert rows[0].licenses[0].license == "All-rights-reserved" and rows[0]["a.b"]["x y"] == 1 and rows[1].licenses == []


def test_winnowing_keeps_one_of_each_window():
    g = np.random.default_rng(3).integers(0, 50, 80, dtype=np.uint64)
    for w in (1, 2, 5):
        at = licenses.winnow(g, w)
        assert all(any(i <= p < i + w for p in at) for i in range(len(g) - w + 1))
        assert len(at) <= len(g)


def test_templates_from_a_folder(spark, tmp_path):
    for name, text in (("Mine-1.0.txt", "You may do as you like with all of this."), ("Other", "Ask me first, please, and then do it.")):
        (tmp_path / name).write_text(text)
    made = licenses.read_templates(spark, f"file://{tmp_path}")
    assert sorted(made) == ["Mine-1.0", "Other"]
    rows = licenses.scan_licenses(docs(spark, ["so you may do as you like with most of this", None]), templates=made).collect()
    assert [[(x.license, x.n_matched) for x in r.licenses] for r in sorted(rows, key=lambda r: r.doc_id)] == [[("Mine-1.0", 9)], []]
