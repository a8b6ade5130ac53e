"""Queries that SQL can't express, run over small folders of tables and held against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import tiktoken

from quillon.llm import langid, licenses, queries
from quillon.llm.decontam import plain_words
from quillon.llm.shingles import word_hashes
from test_scans import slow_marginals
from util import edited, prose, rng

SF = "/root/testdata/sf0.001"


def folder(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op5_gives_the_ids_of_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_byte_bpe(spark, SF).collect()}
    assert set(got) == set(d.doc_id) and len(got) == len(d)
    for i, t in zip(d.doc_id, d.text, strict=True):
        ids = np.array(library.encode_ordinary(t), dtype="<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op2_finds_what_full_alignment_finds(spark, tmp_path):
    r = rng(12)
    names = [n for n in licenses.TEMPLATES if n != "MIT"]
    texts = [None, "", prose(r, 100)]
    for n in names:
        body = licenses.TEMPLATES[n]
        texts += [f"{prose(r, 30)}\n{body}\n{prose(r, 30)}", edited(r, body, max(1, len(body.split()) // 12)), edited(r, body, len(body.split()))]
    rows = queries.op2_license_scans(spark, folder(spark, tmp_path / "sf", [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    got = {}
    for x in rows:
        got.setdefault((x.doc_id, x.license), []).append((x.n_words, x.n_matched))
    for i, t in enumerate(texts):
        words = word_hashes(plain_words(t))
        for n in licenses.TEMPLATES:
            own = word_hashes(plain_words(licenses.TEMPLATES[n]))
            matched = licenses.align(own, words, 0, None)[0]
            if 100 * matched >= licenses.PERCENT * len(own):
                assert (len(own), matched) in got.pop((i, n)), (i, n)
    assert not got


def test_op9_sums_the_marginals_of_all_words(spark, tmp_path):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [(int(i), t, y, "s", 1) for i, t, y in zip(d.doc_id, d.text, d.lang, strict=True)] + [(9001, None, "en", "s", 1), (9002, "12 - !", None, "s", 1), (9003, "Ü", None, "s", 1)]
    sf = folder(spark, tmp_path / "sf", rows)
    got = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    for i, t, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not langid.has_letter(t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        ws = langid.letter_words(t)
        sums = slow_marginals(model.emissions(ws), model.trans)
        assert got[i].lang_pred == model.languages[sums.argmax()]
        assert abs(got[i].score - sums.max() / len(ws)) < 1e-6
