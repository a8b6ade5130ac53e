"""Line dedup over overlapping three-line windows.

Consecutive lines are hashed together (lines are trimmed, blank ones passed over); windows that occur more than once
anywhere are found by one aggregate; every occurrence but the first covers its lines, and covered lines are removed.
The first occurrence is that of the least document id, then place in the text.

Texts are never shuffled to find windows: rows of 128-bit hashes are. Covered positions come back by a join on the
document, broadcast only when they are proven few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, at, columns_but, inside, packed, pinned, spread_join, unpacked

#: Lines of a window.
WINDOW = 3
#: Covered positions are broadcast up to this many (about 8 bytes each), else joined by a shuffle.
BROADCAST_POSITIONS = 2_000_000
_BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _full(lines: Column) -> Column:
    """The numbers of the lines that aren't blank."""
    numbered = F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(_BLANKS)) != "", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _row_key(id: str, text: str) -> list[Column]:
    return [F.xxhash64(at(id), at(text)).alias("__k1"), F.xxhash64(F.lit(1), at(text), at(id)).alias("__k2")]


def window_rows(df: DataFrame, id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(h1, h2, id, __k1, __k2, pos): one row a window; pos counts lines that aren't blank."""
    lines = F.filter(F.transform(_lines(at(text)), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    d = pinned(df, at(id).alias("id"), *_row_key(id, text), lines.alias("ls")).where(F.size("ls") >= window)
    near = lambda i: [F.get(F.col("ls"), i + j) for j in range(window)]
    hashes = F.transform(F.sequence(F.lit(0), F.size("ls") - window), lambda i: F.struct(F.xxhash64(*near(i)).alias("h1"), F.xxhash64(F.lit(1), *near(i)).alias("h2")))
    return d.select("id", "__k1", "__k2", F.posexplode(hashes).alias("pos", "h")).select(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"), "id", "__k1", "__k2", "pos")


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows with repeated lines removed from text; adds n_lines and n_removed (bigint).

    All columns are kept; columns of the added names are replaced.

    Edge cases: texts of fewer than three lines that aren't blank have no window and stay. A null text stays null and
    has no lines. Rows with the same id and text are one document and lose the same lines; a null id counts as the
    least. Within a text a window that overlaps its own earlier occurrence is a later one too, so of a line repeated
    on end one copy stays. An empty table gives an empty result.
    """
    work = Work(df.sparkSession, "lines")
    rows = work.table(window_rows(df, id, text, window), "windows")
    place = F.struct("id", "__k1", "pos")
    repeats = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", F.col("h2").alias("__h2"), "first")
    later = spread_join(rows, repeats, "h1", "inner").where((F.col("h2") == F.col("__h2")) & ~place.eqNullSafe(F.col("first")))
    covered = work.table(later.groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("__pos")), "covered")
    work.drop("windows")
    total = covered.agg(F.coalesce(F.sum(F.size("__pos") + 4), F.lit(0))).first()[0]
    out = ("n_lines", "n_removed")
    kept = columns_but(df, out)
    docs, t = df.select(packed([*kept, text]), *_row_key(id, text)), inside(text)
    docs = docs.join(F.broadcast(covered) if total <= BROADCAST_POSITIONS else covered, ["__k1", "__k2"], "left")
    hit = F.col("__pos").isNotNull()
    docs = pinned(docs, "__in", "__pos", _lines(t).alias("__lines"), F.when(hit, _full(_lines(t))).alias("__full"))
    gone = F.array_distinct(F.flatten(F.transform("__pos", lambda p: F.slice(F.col("__full"), p + 1, window))))
    docs = pinned(docs, "__in", "__lines", F.when(hit, gone).alias("__gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    joined = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    clean = F.when(F.col("__gone").isNull(), t).otherwise(joined)
    n = F.when(t.isNull(), 0).otherwise(F.size("__lines")).cast("bigint")
    return pinned(docs, *[clean.alias(c) if c == text else x for c, x in zip(kept, unpacked(kept), strict=True)], n.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_removed"))
