import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quillon.llm import bpe
from util import docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    letters = [*"abc  \n\n\t'lrevs12é漢.,-\x1c\u200b", "'ll", "'re"]
    out = [None, "", "a", "<|endoftext|>"]
    out += ["".join(r.choice(letters) for _ in range(r.choice([5, 63, 64, 65, 300, 1000]))) for _ in range(60)]
    return [*out, " " * 900, "x" * 9000, "ab " * 300 + "y" * 700 + " z" * 50, "\n" * 333 + "a", "".join(r.choice("abcdefgh") for _ in range(20_000)), "a" * 62 + "'ll" * 30, *out[4:6]]


def test_round_trip_and_ids(spark, library):
    given = texts()
    v = bpe.share_vocabulary(spark, PATH, P.PATTERN)
    coded = bpe.decode(bpe.encode(docs(spark, given, ["tokens", "decoded"]), v, chunk=64, overlap=16), v)
    rows = {r.doc_id: r for r in coded.collect()}
    assert len(rows) == len(given)
    for i, t in enumerate(given):
        assert np.frombuffer(rows[i].tokens, "<u4").tolist() == library.encode_ordinary(t or ""), i
        assert bytes(rows[i].decoded) == (t or "").encode()
        assert rows[i].n_tokens == len(rows[i].tokens) // 4 and rows[i].text == t
    once = bpe.encode(docs(spark, given, ["tokens", "decoded"]), v, chunk=64, overlap=16, decoded=True).collect()
    assert {(r.doc_id, bytes(r.tokens), bytes(r.decoded), r.text) for r in once} == {(i, bytes(r.tokens), bytes(r.decoded), r.text) for i, r in rows.items()}
    assert bpe.encode(docs(spark, []), v).collect() == []


@pytest.mark.parametrize("size,overlap", [(8, 4), (16, 8), (64, 16), (100, 1)])
def test_stitching_gives_the_boundaries_of_the_whole(library, size, overlap):
    coder = bpe.Coder(library._mergeable_ranks, P.PATTERN)
    for t in filter(None, texts()):
        t = t[:3000]
        starts = list(range(0, len(t), size))
        ends = [coder.boundaries(t[s : s + size + overlap]) for s in starts]
        assert bpe.stitch(coder, t, starts, ends, size, overlap) == coder.boundaries(t)


def test_long_pieces_merge_as_the_library(library):
    coder = bpe.Coder(library._mergeable_ranks, P.PATTERN)
    r = random.Random(1)
    for n in (1, 2, 3, 50, 700):
        piece = "".join(r.choice("aenrst") for _ in range(n)).encode()
        assert coder._merge_long(piece) == library.encode_ordinary(piece.decode())


def test_patterns_that_look_far_ahead(spark, library):
    pattern = r"\s*[\r\n]+|\s+|\S+"
    with pytest.raises(ValueError, match="looks ahead"):
        bpe.share_vocabulary(spark, PATH, pattern)
    given = ["a" + " " * 500 + "\n" + "b " * 90, " " * 300, "x\n\n y"]
    own = tiktoken.Encoding("o", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    v = bpe.share_vocabulary(spark, PATH, pattern, bpe.WHOLE)
    rows = bpe.encode(docs(spark, given), v, chunk=64, overlap=16).collect()
    assert {r.doc_id: np.frombuffer(r.tokens, "<u4").tolist() for r in rows} == {i: own.encode_ordinary(t) for i, t in enumerate(given)}
