"""Time alignment of two legs without a hot partition.

A row can only meet rows within the tolerance, so time is cut into buckets of many tolerances and the right side is
repeated into a neighbouring bucket where it lies within a tolerance of the edge. Everything after that is partitioned by
(key, bucket): a pair that holds most of the rows is spread over its buckets, with one shuffle and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances in a bucket: 1 in 32 right rows travels twice.
BUCKET = 64


def _united(left: DataFrame, right: DataFrame, by: list[str], at: str, before: int, behind: int, seq: str) -> tuple[DataFrame, list[str]]:
    """Rows of both sides by (by, _bucket): _side 0 is right, so a right row stands before a left row of the same time.

    Of right rows of equal key and time the one with the largest seq counts: it comes last among them.
    """
    width = max(1, BUCKET * max(before, behind, 1))
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    t = F.col(at).cast("long")
    keys = [F.col(c) for c in by]
    kind = right.schema[seq].dataType.simpleString()
    lefts = left.select(*keys, t.alias("_t"), bucket(t).alias("_bucket"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_seq"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("_r"))
    where = F.array_distinct(F.array(bucket(t - behind), bucket(t), bucket(t + before)))
    rights = right.select(*keys, t.alias("_t"), F.explode(where).alias("_bucket"), F.lit(0).alias("_side"), F.col(seq).alias("_seq"), F.lit(None).cast(lefts.schema["_l"].dataType).alias("_l"), F.struct(*right.columns).alias("_r"))
    return lefts.unionByName(rights), [*by, "_bucket"]


_STAMP = "CASE WHEN _side = 0 THEN struct(_t AS t, _r AS r) END"


def _back(part: list[str]) -> Column:
    """The last right row at or before a row."""
    w = Window.partitionBy(*part).orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.expr(_STAMP), ignorenulls=True).over(w)


def _ahead(part: list[str], same: bool) -> Column:
    """The first right row at (`same`: or at the time of the row itself) or behind a row.

    Descending order with a growing frame: a frame that shrinks from behind would be evaluated anew for every row.
    """
    side = F.col("_side").asc() if same else F.col("_side").desc()
    w = Window.partitionBy(*part).orderBy(F.col("_t").desc(), side, "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.expr(_STAMP), ignorenulls=True).over(w)


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, tolerance: int, seq: str) -> DataFrame:
    """Left rows with the right row nearest in time within the tolerance (inclusive): columns l and r.

    Of two right rows equally far the later one is taken; right rows may be taken more than once; left rows without one
    go. Right rows of equal key and time are one, that with the largest seq.
    """
    rows, part = _united(left, right, by, at, tolerance, tolerance, seq)
    seen = rows.select("*", _back(part).alias("_p")).select("*", _ahead(part, False).alias("_n")).filter("_side = 1")
    later = F.col("_p").isNull() | (F.col("_n.t") - F.col("_t") <= F.col("_t") - F.col("_p.t"))
    pick = F.when(F.col("_n").isNotNull() & later, F.col("_n")).otherwise(F.col("_p"))
    met = seen.select(F.col("_l").alias("l"), F.col("_t"), pick.alias("_m")).filter(F.abs(F.col("_m.t") - F.col("_t")) <= tolerance)
    return met.select("l", F.col("_m.r").alias("r"))


def latest(left: DataFrame, right: DataFrame, by: list[str], at: str, bound: int, seq: str) -> DataFrame:
    """Left rows with the last right row at or before their time, no older than `bound` (inclusive): columns l and r."""
    rows, part = _united(left, right, by, at, bound, 0, seq)
    seen = rows.select("*", _back(part).alias("_p")).filter("_side = 1 AND _p IS NOT NULL")
    return seen.filter(F.col("_t") - F.col("_p.t") <= bound).select(F.col("_l").alias("l"), F.col("_p.r").alias("r"))


def following(left: DataFrame, right: DataFrame, by: list[str], at: str, bound: int, seq: str) -> DataFrame:
    """Left rows with the first right row at or behind their time, within `bound`: the delayed look at a rung."""
    rows, part = _united(left, right, by, at, 0, bound, seq)
    seen = rows.select("*", _ahead(part, True).alias("_n")).filter("_side = 1 AND _n IS NOT NULL")
    return seen.filter(F.col("_n.t") - F.col("_t") <= bound).select(F.col("_l").alias("l"), F.col("_n.r").alias("r"))


def within(a: Column, b: Column, most: float) -> Column:
    return F.abs(a - b) <= most
