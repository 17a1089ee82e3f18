"""Ordered computations over long series without a task that holds a whole series.

A series is cut into tiles of time. Inside a tile a window does the work; what crosses the border of a tile (the row
before, a running value) is one row a tile, computed from one aggregate by tile and joined back. Rows are shuffled once,
by (key, tile): window, aggregate and join all use that exchange. Only the one row of each tile meets the others of its
key. Keys are not null; rows of a null key are a series in each tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds in a tile unless told otherwise: a day.
DAY = 86_400_000_000
_SUMS = {"sum": F.sum, "max": F.max}


def tiled(rows: DataFrame, by: list[str], at: Column, width: int = DAY) -> DataFrame:
    """Adds _tile and deals the rows by it. Rows without a time are a tile of their own, the first."""
    tile = F.coalesce(F.floor(at / F.lit(width)).cast("long"), F.lit(-(2**62)).cast("long"))
    return rows.withColumn("_tile", tile).repartition(*by, "_tile")


def _joined(rows: DataFrame, by: list[str], carried: DataFrame) -> DataFrame:
    """rows with the carried columns of their tile: (by, _tile, ...)."""
    return rows.join(carried, [*by, "_tile"], "left")


def previous(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds name = value of the row before in the order of (key, order), null for a key's first; rows come from tiled()."""
    kept = rows.withColumn("_own", F.struct(*(v.alias(n) for n, v in values.items())))
    last = kept.groupBy(*by, "_tile").agg(F.max_by("_own", F.struct(*order)).alias("_last"))
    before = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*by).orderBy("_tile")))
    inside = F.lag("_own").over(Window.partitionBy(*by, "_tile").orderBy(*order))
    out = _joined(kept, by, before).withColumn("_before", F.coalesce(inside, F.col("_last")))
    return out.withColumns({n: F.col(f"_before.{n}") for n in values}).drop("_own", "_last", "_before")


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], how: str = "sum") -> DataFrame:
    """Adds name = sum (or max) of a column up to and with the row and its peers, in the order of (key, order)."""
    fold, names = _SUMS[how], list(values)
    kept = rows.withColumns({f"_x{k}": values[n] for k, n in enumerate(names)})
    total = kept.groupBy(*by, "_tile").agg(*(fold(f"_x{k}").alias(f"_b{k}") for k in range(len(names))))
    so_far = Window.partitionBy(*by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*by, "_tile", *(fold(f"_b{k}").over(so_far).alias(f"_b{k}") for k in range(len(names))))
    inside = Window.partitionBy(*by, "_tile").orderBy(*order)
    both = lambda a, b: F.coalesce(a + b, a, b) if how == "sum" else F.greatest(a, b)
    out = _joined(kept, by, before).withColumns({n: both(F.col(f"_b{k}"), fold(f"_x{k}").over(inside)) for k, n in enumerate(names)})
    return out.drop(*(f"{p}{k}" for p in ("_x", "_b") for k in range(len(names))))
