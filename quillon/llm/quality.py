"""Quality rules, line first.

Every line is judged by itself: a line of prose ends with a sentence mark, a navigation line is cut up by separators,
a boilerplate line holds a stock phrase, a symbol line is mostly signs. Failing lines are removed; then a document is
rejected if it lost too much of its text, or fails the base rules on its words.

All of it is one projection over the scan: no shuffle, no Python. Repeated three-word windows are found by sorting the
64-bit hashes of a document's windows, so the cost is n log n in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, at, columns_but, inside, packed, pinned, unpacked

#: Fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document is rejected if more than this percentage of its word characters stood in failing lines.
MAX_LOST_PERCENT = 50
#: Fixed phrases of boilerplate lines, lower case.
BOILERPLATE = ("all rights reserved", "accept cookies", "cookie policy", "click here", "enable javascript", "lorem ipsum", "privacy policy", "sign in to", "subscribe to our newsletter", "terms of service", "terms of use")
_WORD, _GAP, _SIGN = rf"[^{SPACE_CLASS}]", rf"[{SPACE_CLASS}]+", r"[#*$%&|<>]"
_ENDS = rf"[.!?…。！？:;][\"'”’»)\]]*[{SPACE_CLASS}]*$"
_SEPARATOR = rf"(?:^|[{SPACE_CLASS}])(?:[|»›•·→]|::|>>)(?=[{SPACE_CLASS}]|$)"


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def _signs(text: Column) -> Column:
    """How many signs a text has."""
    return F.size(F.split(text, _SIGN, -1)) - 1


def _covered(hashes: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more, given the windows' hashes in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def at(xs: Column) -> Column:
        same = F.transform(xs, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(xs, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(xs, k + 1)["h"] == x["h"]).eqNullSafe(True)).alias("twice")))
        return F.sort_array(F.transform(F.filter(same, lambda x: x["twice"]), lambda x: x["i"]))

    def total(ps: Column) -> Column:
        gaps = F.transform(ps, lambda p, k: F.least(F.coalesce(F.get(ps, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    # Each intermediate list is bound once, as the only element of an array.
    lists = F.transform(F.array(pairs), at)
    return F.coalesce(F.get(F.transform(lists, total), F.lit(0)), F.lit(0).cast("bigint"))


def _good_line(line: Column) -> Column:
    """Whether a line with words passes the line rules."""
    low = F.lower(line)
    stock = low.rlike("(?:" + "|".join(BOILERPLATE) + ")")
    cuts = F.size(F.split(line, _SEPARATOR, -1)) - 1
    return line.rlike(_ENDS) & ~stock & (cuts < 2) & (_signs(line) * 10 <= F.length(line))


def apply_quality(df: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Judge every document and clean its text by lines.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_percent, clean_text and kept;
    columns of these names in the input are replaced. clean_text has the lines that pass, and lines without a word.

    Edge cases: a null or empty text has no words and so fails the base rules; its clean_text is null or empty. A
    text of any length is judged whole. Repeated rows are judged alike. An empty table gives an empty result. Columns
    of any names travel along as one struct, so none can clash.
    """
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_percent", "clean_text", "kept")
    kept = columns_but(df, out)
    d = pinned(df, packed([*kept, text]), words_of(at(text)).alias("__w"), F.split(F.coalesce(at(text), F.lit("")), "\n", -1).alias("__l"))
    t, has_word = F.coalesce(inside(text), F.lit("")), lambda x: x.rlike(_WORD)
    w, n = F.col("__w"), F.size("__w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))).otherwise(F.expr("cast(array() as array<bigint>)"))
    d = pinned(
        d, "__in", n.cast("bigint").alias("n_words"), windows.alias("__h"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        _signs(t).cast("bigint").alias("n_symbols"),
        F.filter("__l", has_word).alias("__full"),
        F.filter("__l", lambda x: ~has_word(x) | _good_line(x)).alias("__good"),
    )
    # The base numbers, then the verdicts.
    twice = F.when(F.size("__h") > F.size(F.array_distinct("__h")), _covered(F.col("__h"))).otherwise(F.lit(0).cast("bigint"))
    d = pinned(d, "__in", F.array_join("__good", "\n").alias("__clean"), "n_words", "word_chars", "n_symbols", (F.size("__full") - F.size(F.array_distinct("__full"))).cast("bigint").alias("n_dup_lines"), twice.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.when(F.col("__clean") == t, F.col("word_chars")).otherwise(F.length(F.array_join(words_of(F.col("__clean")), "")))
    d = d.select("__in", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "__clean", (F.when(F.col("word_chars") > 0, (F.col("word_chars") - left) * 100 / F.col("word_chars")).otherwise(0.0)).alias("lost_percent"))
    return d.select(*unpacked(kept), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_percent", F.when(inside(text).isNotNull(), F.col("__clean")).alias("clean_text"), (~F.col("base_failed") & (F.col("lost_percent") <= max_lost_percent)).alias("kept"))
