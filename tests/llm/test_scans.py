"""Decontamination, license scans and language identification."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontam, langid, licenses
from quillon.llm.shingles import word_hashes
from util import docs, edited, prose, rng

SF = "/root/testdata/sf0.1"


def grams(text, k):
    ws = decontam.plain_words(text)
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def contained(text, item):
    ws = decontam.plain_words(item)
    k = min(5, len(ws))
    if not k:
        return None
    own = grams(item, k)
    shared = len(own & grams(text, k))
    return (len(own), shared) if 100 * shared >= 80 * len(own) else None


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 300])
def test_containment_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    r = rng(8)
    items = [prose(r, n, 3000) for n in (60, 30, 30, 14, 5, 200)] + ["just three words", "", None, "Odd—case, IT's ok"]
    bench = [(i if i != 3 else None, t) for i, t in enumerate(items)] + [(0, items[0])]
    texts = [None, "", "just three", "it is JUST  three,words here"]
    for t in items[:6]:
        for n in (0, 1, 2, 4, 8):
            texts.append(prose(r, 900, 3000) + "\n" + edited(r, t, n).upper() + ". " + prose(r, 50, 3000))
    texts += [items[5][:200], "x " * 5000 + items[4], prose(r, 60_000, 3000) + " " + items[1], "odd—case it s ok"]
    df = spark.createDataFrame(bench, "item_id long, text string")
    got = {x.doc_id: {(i.item_id, i.n_shingles, i.n_shared) for i in x["items"]} for x in decontam.find_benchmark(docs(spark, texts, ["items", "x"]), df).collect()}
    for d, t in enumerate(texts):
        want = {(i, *c) for i, item in set(bench) if (c := contained(t, item))}
        assert got[d] == want, d
    assert all(len(x["items"]) == 0 for x in decontam.find_benchmark(docs(spark, texts), df.limit(0)).collect())
    assert decontam.find_benchmark(docs(spark, []), df).collect() == []


def test_licenses_against_full_alignment(spark):
    r = rng(3)
    mit, apache, cc = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-notice"], licenses.TEMPLATES["CC-BY-NC-4.0-notice"]
    cut = mit.split(" ")
    texts = [None, "", "nothing here", apache, f"{prose(r, 300)}\n{cc}\n{prose(r, 20)}\n{cc}", f"é {edited(r, mit, 9)} {prose(r, 9)}", f"# {' '.join(cut[:60])} # extra words here # {' '.join(cut[60:])}", " ".join(cut[: len(cut) // 2]), "all RIGHTS   reserved", f"{prose(r, 5000)} {apache.upper()}"]
    got = {x.doc_id: [tuple(y) for y in x.licenses] for x in licenses.scan_licenses(docs(spark, texts, ["licenses"])).collect()}
    for i, t in enumerate(texts):
        words = word_hashes(decontam.plain_words(t))
        spans = [(m.start(), m.end()) for m in licenses._WORD.finditer(t or "")]
        for name, body in licenses.TEMPLATES.items():
            own = word_hashes(decontam.plain_words(body))
            if len(words) > 2000:
                continue
            n, a, e = licenses.align(own, words, 0, None)
            mine = [x for x in got[i] if x[0] == name]
            assert bool(mine) == (100 * n >= licenses.PERCENT * len(own)), (i, name)
            if mine:
                best = max(mine, key=lambda x: x[2])
                assert best[1:3] == (len(own), n)
                assert (best[3], best[4]) in [(spans[a][0], spans[e - 1][1]), *[(x[3], x[4]) for x in mine if x[2] == n]]
    assert [x[0] for x in got[4]] == ["CC-BY-NC-4.0-notice"] * 2 and got[9][0][0] == "Apache-2.0-notice"
    assert texts[4][got[4][0][3] : got[4][0][4]] == cc.rstrip(".")
    assert licenses.scan_licenses(docs(spark, [])).collect() == []


def slow_marginals(scores, trans):
    """Sum of posteriors by one pass forward and one back, a word at a time."""
    t = np.exp(trans - trans.max())
    t /= t.sum(axis=1, keepdims=True)
    n = scores.shape[1]
    a, out = np.full(n, 1 / n), []
    for s in scores:
        a = (a @ t) * np.exp(s)
        a /= a.sum()
        out.append(a)
    b, total = np.ones(n), np.zeros(n)
    for s, f in zip(scores[::-1], out[::-1], strict=True):
        p = f * b
        total += p / p.sum()
        b = t @ (np.exp(s) * b)
        b /= b.sum()
    return total


def test_blocks_give_the_marginals_of_the_whole():
    g = np.random.default_rng(2)
    lengths = np.array([1, 63, 64, 65, 200, 5])
    scores, trans = g.normal(size=(lengths.sum(), 3)) * 2, g.normal(size=(3, 3))
    got = langid.marginals(scores, lengths, trans)
    at = 0
    for row, n in zip(got, lengths, strict=True):
        assert np.allclose(row, slow_marginals(scores[at : at + n], trans))
        at += n


def test_language_on_held_out_rows(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet").iloc[:3000]
    df = spark.createDataFrame(d[["doc_id", "text", "lang"]])
    model = langid.fit(df)
    got = langid.predict(df.drop("lang"), model).select("doc_id", langid.held_out("doc_id").alias("held"), "lang_pred", "score").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    assert (got.held == held).all() and got.score.between(0, 1).all()
    lang = dict(zip(d.doc_id, d.lang, strict=True))
    right = [p == lang[i] for i, p, h in zip(got.doc_id, got.lang_pred, held, strict=True) if h]
    assert np.mean(right) > 0.98


def test_language_edges_and_switches(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("the cat and the dog are in the house", "en"), ("le chat et le chien sont dans la maison", "fr")] * 30)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["en", "fr"]
    given = [None, "", "123 --- !", "漢", "THE dog!", "le chien", "the cat and the dog le chat et le chien sont dans la maison"]
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(docs(spark, given, ["score"]).drop("lang"), model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] in ("en", "fr") and got[4][0] == "en" and got[5][0] == "fr"
    assert got[6][0] == "fr" and 0.4 < got[6][1] < 0.95
    nothing = langid.fit(df.limit(0))
    assert {x.lang_pred for x in langid.predict(docs(spark, ["a b"]), nothing).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model).collect() == []


def test_words_of_a_text_that_switches_are_labelled(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("the cat and the dog are in the house", "en"), ("le chat et le chien sont dans la maison", "fr")] * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    given = ["The cat and the dog, le chat et le chien; the house is in the house", None, "12", "le chat"]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumn("lang_spans", F.lit("clash")).withColumn("x.y", F.lit(1))
    got = {r.doc_id: r for r in langid.predict(df, model, spans=True).collect()}
    assert [tuple(s) for s in got[0].lang_spans] == [("en", 0, 5), ("fr", 5, 5), ("en", 10, 6)]
    assert got[1].lang_spans == got[2].lang_spans == [] and [tuple(s) for s in got[3].lang_spans] == [("fr", 0, 2)]
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert plain == {i: (r.lang_pred, r.score) for i, r in got.items()} and got[0]["x.y"] == 1


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has room for, one whose texts are all long, and an id that repeats very often."""
    r = rng(41)
    word = lambda k: f"q{k}w"
    rows = [(i, f"{word(i % 230)} " * 12 + str(i), f"l{i % 230:03d}") for i in range(690)]
    rows += [(10_000, " ".join(word(0) for _ in range(9)), "l000")] * 3000
    rows += [(20_000 + i, "zulu ngiyabonga " * 2000 + f"{r.randrange(99)}", "zu") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 200)
    picked = langid.sample(df, "doc_id", "text", "lang")
    assert {y for _, y in picked} == {y for _, _, y in rows} and len(picked) == 231
    assert max(len(t) for t, _ in picked) == langid.SAMPLE_CHARS
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 4000)
    some = [y for _, y in langid.sample(df, "doc_id", "text", "lang")]
    assert all(some.count(f"l{k:03d}") == (4 if k == 0 else 3) for k in range(230)) and some.count("zu") == 3
    assert langid.n_weights(5) == langid.n_weights(200) == langid.WEIGHTS and langid.n_weights(2000) * 2000 <= langid.ALL_WEIGHTS
    assert len(langid.train([("a b", f"l{k}") for k in range(3)]).weights) == langid.WEIGHTS
    monkeypatch.setattr(langid, "ALL_WEIGHTS", 1 << 17)
    assert len(langid.train([("a b", f"l{k}") for k in range(3)]).weights) == 1 << 15


def test_partitions_have_their_own_settings():
    """More minima for longer documents, and a miss less likely than stated at the threshold, by the binomial's tail."""
    import math

    made = [decontam.settings(p, 80) for p in range(1, 30)]
    assert made == sorted(made) and len(set(made)) > 5
    for n, seen in made:
        tail = lambda k: sum(math.comb(n, x) * 0.8**x * 0.2 ** (n - x) for x in range(k))
        assert tail(seen) <= decontam.MISS and (seen == 1 or tail(seen + 1) > decontam.MISS)
    items = [(1, prose(rng(1), 60, 10**6)), (2, prose(rng(2), 12, 10**6))]
    index = decontam.Index(items, 5, 80)
    whole = np.unique(np.concatenate(index.sets))
    assert index._seen(whole[:0], 5).tolist() == []
    assert index._seen(np.resize(whole, 31), 5).tolist() in ([], [1]) and set(index._seen(whole, 5).tolist()) == {0, 1}


def test_recall_at_and_above_the_threshold():
    """Candidates among documents of 30 to 30,000 words that contain 80 % or more of an item: 1.00 of 3,000."""
    r = rng(51)
    items = [(k, prose(r, r.choice([8, 14, 30, 60, 200]), 10**6)) for k in range(100)]
    index = decontam.Index(items, 5, 80)
    counted = 0
    for _ in range(3000):
        k = r.randrange(len(items))
        ws = items[k][1].split(" ")
        own = len(ws) - 4
        keep = r.randrange(-(-own * 80 // 100), own + 1)  # shingles of the item that stay
        start = r.randrange(own - keep + 1)
        around = [f"d{r.randrange(10**6)}" for _ in range(r.choice([5, 50, 500, 500, 5000]))]
        text = " ".join([*around, *ws[start : start + keep + 4], *around])
        counted += k in [x for x, _ in index.candidates(word_hashes(decontam.plain_words(text)))]
    assert counted == 3000


def test_text_ids_of_items_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 40)
    r = rng(52)
    items = [("b", prose(r, 12, 900)), ("a", prose(r, 12, 900)), (None, prose(r, 12, 900))]
    bench = spark.createDataFrame(items, "`the id` string, text string")
    df = docs(spark, [f"{items[0][1]} x {items[1][1]} y {items[2][1]}", None]).withColumn("c d", F.lit(2))
    got = {x.doc_id: x for x in decontam.find_benchmark(df, bench, item_id="the id").collect()}
    assert [x.item_id for x in got[0]["items"]] == ["a", "b", None] and got[1]["items"] == [] and got[0]["c d"] == 2
