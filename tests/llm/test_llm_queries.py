"""The operators' queries against their SQL, and the pipeline against a plain version, at sf0.001."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(x)] for x in sorted(names)) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[x] for x in sorted(names)) for r in df.collect()), key=str) == want


def plain_pipeline(docs, bench):
    from test_near_duplicates import brute, slow_lines
    from test_quality_sharding_chat import base
    from test_scans import contained

    from quillon.llm.quality import BOILERPLATE, MAX_LOST_PERCENT

    ws = r"[\x20\x09-\x0D]"
    solid = lambda t: len(re.sub(f"{ws}+", "", t))

    def good(line):
        if not re.search(r"[^\x20\x09-\x0D]", line):
            return True
        cuts = len(re.findall(rf"(?:^|{ws})(?:[|»›•·→]|::|>>)(?={ws}|$)", line))
        signs = sum(c in "#*$%&|<>" for c in line)
        return bool(re.search(rf"[.!?…。！？:;][\"'”’»)\]]*{ws}*$", line)) and not any(b in line.lower() for b in BOILERPLATE) and cuts < 2 and signs * 10 <= len(line)

    rows = []
    for i, t in docs:
        clean = "\n".join(x for x in (t or "").split("\n") if good(x))
        lost = (solid(t or "") - solid(clean)) * 100 / max(1, solid(t or ""))
        if not base(t)[-1] and lost <= MAX_LOST_PERCENT:
            rows.append((i, clean))
    texts, gone = slow_lines(sorted(rows))
    rows = [(i, t) for i, t in sorted(texts.items()) if not gone.get(i) or solid(t)]
    comp = brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if comp[i] == i]
    return {i: t for i, t in rows if not any(contained(t, b) for b in bench)}


def test_pipeline_against_a_plain_version(spark):
    import public_tokenizers as P
    from quillon.llm import bpe

    import corpus_pipeline

    d = pd.read_parquet(f"{SF}/documents.parquet")
    want = plain_pipeline(list(zip(d.doc_id, d.text, strict=True)), list(pd.read_parquet(f"{SF}/benchmark.parquet").text))
    coder = bpe.Coder({__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, P.PATTERN)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert coder.decode(bytes(r.tokens)).decode() == want[i] and r.round_trip
        assert r.n_tokens == len(np.frombuffer(r.tokens, "<u4")) and r.n_chars == len(want[i])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
