import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, quality, sharding
from util import docs, prose, rng

WS = r"[\x20\x09-\x0D]"


def base(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered), failed


def test_quality_numbers(spark):
    r = rng()
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "x x x x x", "a b\na b\n\n \na b", "€ 𝒳 é\x0b# * $", "\n".join([prose(r, 30, 5) + "."] * 4), prose(r, 3000, 40), prose(r, 60, 10**6) + ".", "a\x85b\u3000c \x1c d", "a b c d a b c e a b c"]
    df = docs(spark, texts, ["kept", "n_words", "__x"])
    got = {x.doc_id: x for x in quality.apply_quality(df).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(t), i
        assert not (x.base_failed and x.kept)
    assert got[0].clean_text is None and got[10].kept


def test_quality_lines(spark):
    r = rng(2)
    good = [prose(r, 40, 10**6) + "." for _ in range(4)]
    bad = ["Home | About | Contact | Login.", "All rights reserved.", "x### y*** z$$$.", "no sentence mark here"]
    rows = {x.doc_id: x for x in quality.apply_quality(docs(spark, ["\n".join(good + bad[:3]), "\n".join(good[:2] + [prose(r, 90, 10**6)]), "\n\n".join(good)])).collect()}
    assert rows[0].clean_text == "\n".join(good) and rows[0].kept
    assert not rows[1].kept and rows[1].lost_percent > 50
    assert rows[2].clean_text == "\n\n".join(good) and rows[2].kept
    assert quality.apply_quality(docs(spark, [])).collect() == []


def slow_table(shards, slots):
    """Each shard's permutation written out, then turn by turn."""
    d = lambda s, salt: int.from_bytes(hashlib.md5(f"{salt}:{s}".encode()).digest()[:8], "big")
    perms = [[(d(s, "offset") % slots + j * (d(s, "step") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    table = [-1] * slots
    turn = 0
    while -1 in table:
        p = perms[turn % len(shards)]
        table[next(x for x in p if table[x] < 0)] = turn % len(shards)
        turn += 1
    return table


def test_table_against_brute_force():
    for names, slots in ((["a"], 7), (["a", "b", "c"], 13), ([f"s{i}" for i in range(10)], 101)):
        assert sharding.fill_table(names, slots) == slow_table(names, slots)
    counts = Counter(sharding.fill_table())
    assert max(counts.values()) - min(counts.values()) <= 1
    few, more = sharding.fill_table([f"s{i}" for i in range(20)], 5003), sharding.fill_table([f"s{i}" for i in range(21)], 5003)
    assert sum(x != y for x, y in zip(few, more, strict=True)) / 5003 < 0.2
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_placement(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (-5,)], "doc_id long").withColumn("slot", F.lit("clash")).withColumn("shard", F.lit("x"))
    table = sharding.fill_table()
    for r in sharding.assign_shards(df).collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.assign_shards(df.limit(0)).collect() == []


NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> [\\INST]", "[INST][/INST]", "", None, "<", "[INST", "]<s>", "tail<", "é𝒳[/INST]", "</s></s>", "a\nb"]


def test_chat_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "system", None, "[INST]x</s>")[i % 5], t) for i, t in enumerate(NASTY * 2)]
    rows += [(2, 0, "user", "a"), (2, 1, "user", "b"), (2, 1, "user", "b"), (2, 2, "assistant", "c"), (2, 3, "assistant", "d"), (None, None, None, None)]
    rows += [(3, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash"))
    done = chat.format_chats(df)
    got = {r.conv_id: r for r in done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted([(t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv], key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(x.role, x.text) for x in got[conv].turns] == [(r, x) for _, _, r, x in mine]
        assert got[conv].loss == "".join(x for _, _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].n_blocks == sum(i == 0 or mine[i][2] != mine[i - 1][2] for i in range(len(mine)))
    assert got[2].formatted == "<s>[INST]user[/INST]a[INST][/INST]b[INST][/INST]b</s><s>[INST]assistant[/INST]c[INST][/INST]d</s>"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_a_conversation_of_32_000_turns(spark):
    """Linear in its turns: seconds, with characters of one to four bytes and roles that change and don't."""
    import time

    said = ["é𝒳 [INST] ok", "plain words of a turn", "</s>", "", "漢字 " * 20]
    n = 32_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 5 < 2, 'user', 'assistant') AS role").withColumn("text", F.get(F.array(*map(F.lit, said)), F.col("turn") % len(said)))
    began = time.time()
    done = chat.format_chats(turns)
    r = done.select("n_turns", "n_blocks", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert time.time() - began < 60
    roles = ["user" if i % 5 < 2 else "assistant" for i in range(n)]
    texts = [said[i % len(said)] for i in range(n)]
    assert [(x.role, x.text) for x in r.t] == list(zip(roles, texts, strict=True)) and r.n_turns == n
    assert r.loss == "".join(x for y, x in zip(roles, texts, strict=True) if y == "assistant")
    assert r.n_blocks == 1 + sum(a != b for a, b in zip(roles, roles[1:]))
