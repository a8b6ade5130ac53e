"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of the same role become one block;
blocks are concatenated. Control strings of the template that stand in a text are escaped by a backslash after their
first character (one more if there are some), which is undone exactly on reading back.

    <s>[INST]role[/INST]text</s>            one block
    <s>[INST]role[/INST]text[INST][/INST]text</s>   a block of two merged turns

The loss mask is a list of (start, length) spans in code points of the formatted text, one for each trained turn.
Adjacent turns of a role are merged by array aggregation: a block is the slice of turns between two changes of role.

A conversation is one row, so its text is held by one task; work on it is linear in its length but for the running sums
of the lengths of its turns, which copy some hundred numbers a turn in a conversation of a million. What several
expressions or lambdas use is computed once a row (pinned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, pinned

OPEN, CLOSE, END, NEXT = "<s>[INST]", "[/INST]", "</s>", "[INST][/INST]"
#: A first character, backslashes, and the rest of a control string.
_RAW = r"(?:(<)(\\*)(/?s>))|(?:(\[)(\\*)(/?INST\]))"
_ESCAPED = r"(?:(<)\\(\\*)(/?s>))|(?:(\[)\\(\\*)(/?INST\]))"
#: Roles whose text is trained on.
TRAINED = ("assistant",)
#: Code points of a piece of formatted text when spans are read from it.
PIECE = 1_024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$4$2$5$3$6")


def _sums(lengths: Column, block: int = 128) -> Column:
    """Sums of all elements before each one: exact within blocks, then shifted by the sums of the blocks before."""
    zero, none = F.lit(0).cast("bigint"), F.expr("cast(array() as array<bigint>)")

    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(zero.alias("at"), none.alias("all")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))

    n = F.size(lengths)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(block))).otherwise(F.expr("cast(array() as array<int>)"))
    parts = F.transform(starts, lambda s: running(F.slice(lengths, s + 1, block)))
    before = running(F.transform(parts, lambda p: p["at"]))["all"]
    return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["all"], lambda x: x + b)))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row a conversation: conv_id, n_turns, n_blocks, formatted, loss_spans array<struct<start,length>>.

    Edge cases: a null text or role is empty. Turns sort by turn number (null first), then role, then text, so ties
    and repeated rows have one order and all are kept. Rows with a null conversation form one conversation. An empty
    table gives an empty result. Other columns are left out.
    """
    said = lambda c: F.coalesce(at(c).cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct(at(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))))
    d = pinned(df.groupBy(at(conv).alias("conv")).agg(turns.alias("t")), "conv", "t")
    t, size = F.col("t"), F.size("t")
    # The numbers of the turns that change the role, and from them the blocks: merged turns of one role.
    first = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["role"] != x["role"]), i)), lambda i: i.isNotNull())
    d = pinned(d, "conv", "t", first.alias("first"))
    ends = F.concat(F.slice("first", 2, F.size("first")), F.array(size))
    block = lambda a, b: F.struct(F.get(t, a)["role"].alias("role"), F.transform(F.slice(t, a + 1, b - a), lambda x: escape(x["text"])).alias("texts"))
    d = pinned(d, "conv", size.alias("n"), F.zip_with("first", ends, block).alias("blocks"))
    # The parts of a block: its head, its texts with a mark between two, its end; the spans are those of the texts.
    head = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(CLOSE))
    shown = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(END)))
    parts = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda x, i: F.struct(
        F.when(i == 0, F.length(head(b))).otherwise(len(NEXT)).alias("before"), F.length(x).alias("length"), F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("after"), b["role"].isin(*trained).alias("train")))))
    d = pinned(d, "conv", "n", F.size("blocks").alias("n_blocks"), F.array_join(shown, "").alias("formatted"), parts.alias("p"))
    d = pinned(d, "conv", "n", "n_blocks", "formatted", "p", _sums(F.transform("p", lambda x: (x["before"] + x["length"] + x["after"]).cast("bigint"))).alias("at"))
    spans = F.zip_with("p", "at", lambda x, a: F.when(x["train"], F.struct((a + x["before"]).cast("bigint").alias("start"), x["length"].cast("bigint").alias("length"))))
    return pinned(d, F.col("conv").alias(conv), F.col("n").cast("bigint").alias("n_turns"), F.col("n_blocks").cast("bigint").alias("n_blocks"), "formatted", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role,text>>, one for each input turn."""
    blocks = F.filter(F.split(formatted, r"</s>", -1), lambda b, i: b.startswith(OPEN))

    def turns(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(OPEN) + 1)), r"\[/INST\]", -1)
        role = unescape(F.get(parts, F.lit(0)))
        texts = F.slice(parts, F.lit(2), F.size(parts))
        # All but the last text of a block end with the first half of the continuation mark.
        return F.transform(texts, lambda x, i: F.struct(role.alias("role"), unescape(F.when(i < F.size(texts) - 1, F.regexp_replace(x, r"\[INST\]$", "")).otherwise(x)).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    The text is cut into pieces once; a span is read from the pieces that it touches, so no span is counted out from
    the start of the text.
    """

    def read(pieces: Column) -> Column:
        def one(s: Column) -> Column:
            a, skip = F.floor(s["start"] / PIECE).cast("int"), (s["start"] % PIECE).cast("int")
            n = F.floor((skip + s["length"] + PIECE - 1) / PIECE).cast("int")
            return unescape(F.substr(F.array_join(F.slice(pieces, a + 1, n), ""), skip + 1, s["length"].cast("int")))

        return F.array_join(F.transform(spans, one), "")

    # The pieces are bound once, as the only element of an array.
    return F.get(F.transform(F.array(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))), read), F.lit(0))
