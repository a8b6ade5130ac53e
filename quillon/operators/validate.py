"""Validation of write batches: one column of errors a row, and requests that fail as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import ID_BYTES
from ..functions.values import MAX_STRING, MIN_STRING

#: Keys of tenants.
API_KEY = r"^[A-Za-z0-9_-]{1,256}$"


def errors(binary_ids: bool = True) -> Column:
    """The rules that a pending triple breaks, as an array of names."""
    size = F.octet_length("s")
    length = (lambda c: F.octet_length(c) != ID_BYTES) if binary_ids else (lambda c: F.octet_length(c) == 0)
    rules = [
        ("request_id", F.col("request_id").isNull()),
        ("entity_id", F.col("e").isNull() | length("e")),
        ("attribute_id", F.col("a").isNull() | length("a")),
        ("value", F.col("kind").isNull() | ~F.col("kind").isin("bool", "num", "str")),
        ("string_length", (F.col("kind") == "str") & (F.col("s").isNull() | (size < MIN_STRING) | (size > MAX_STRING))),
        ("hlc", F.col("hlc_p").isNull() | F.col("hlc_l").isNull() | F.col("hlc_n").isNull()),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def validate(updates: DataFrame, binary_ids: bool = True) -> DataFrame:
    """Adds errors, and request_ok: no triple of the request is bad. An aggregate by request, not a window over it."""
    checked = updates.withColumn("errors", errors(binary_ids))
    bad = checked.where(F.size("errors") > 0).select("request_id").distinct().withColumn("__bad", F.lit(True))
    joined = checked.join(bad.withColumnRenamed("request_id", "__id"), F.col("request_id").eqNullSafe(F.col("__id")), "left")
    return joined.withColumn("request_ok", F.col("__bad").isNull()).drop("__bad", "__id")


def first_error(checked: DataFrame) -> DataFrame:
    """The error each failing request reports: that of its first bad triple."""
    w = Window.partitionBy("request_id").orderBy("seq")
    return checked.where(F.size("errors") > 0).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("request_id", "seq", F.get("errors", F.lit(0)).alias("error"))


def valid_api_key(key: Column) -> Column:
    return F.coalesce(key.rlike(API_KEY), F.lit(False))
