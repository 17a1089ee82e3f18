"""Heatmaps, profiles, curves, downsampling and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import tiles
from tidemark.operators.episodes import market
from tidemark.sources.bridge import LEVELS


def latency_heat(books: DataFrame) -> DataFrame:
    return books.groupBy("leg", F.hour("capture_ts").alias("hour")).agg(F.median("fetch_ms").alias("median_ms"), F.count("*").alias("n"))


def edge_heat(edges: DataFrame) -> DataFrame:
    return edges.groupBy("pair_key", F.hour("capture_ts").alias("hour")).agg((100 * F.avg(F.when(F.round("fee_adj_edge", 9) > 0, 1.0).otherwise(0.0))).alias("positive_pct"), F.count("*").alias("n"))


def survival_heat(probes: DataFrame) -> DataFrame:
    return probes.groupBy("pair_key", "benchmark_ms").agg((100 * F.avg(F.col("survived").cast("double"))).alias("survived_pct"), F.count("*").alias("n"))


def pivoted(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A heatmap as a table with one column for each of the given keys."""
    return cells.groupBy(row).pivot(column, columns).agg(F.first(value))


def liquidity(books: DataFrame) -> DataFrame:
    """Median depth of the top levels by leg and by leg and hour in one pass (grouping sets), with the spread's p50."""
    size = sum((F.coalesce(F.col(f"{s}_sz_{i}"), F.lit(0.0)) for s in ("bid", "ask") for i in range(1, LEVELS + 1)), F.lit(0.0))
    rows = books.select("leg", F.hour("capture_ts").alias("hour"), size.alias("depth"), F.round(F.col("best_ask") - F.col("best_bid"), 9).alias("spread"))
    return rows.groupingSets([["leg"], ["leg", "hour"]], "leg", "hour").agg(F.count("*").alias("n"), F.median("depth").alias("median_depth"), F.median("spread").alias("spread_p50"))


def depth_curve(edges: DataFrame, sizes: tuple[int, ...] = (1, 100, 1000, 5000)) -> DataFrame:
    shares = [(100 * F.avg((F.col("max_profitable_size") >= k).cast("double"))).alias(f"pct_{k}") for k in sizes]
    return edges.groupBy("direction").agg(F.count("*").alias("n"), *shares, F.median("max_profitable_size").alias("median_size"), F.max("max_profitable_size").alias("max_size"))


def thinned(rows: DataFrame, by: list[str], order: list[str], most: int = 500) -> DataFrame:
    """Every ceil(n / most)-th row of each series, the first included; order[0] is a timestamp."""
    out = tiles.running(tiles.tiled(rows, by, F.unix_micros(F.col(order[0]).cast("timestamp"))), by, order, {"_k": F.lit(1)})
    total = rows.groupBy(*by).agg(F.ceil(F.count("*") / most).alias("_step"))
    return out.join(total, by).filter((F.col("_k") - 1) % F.col("_step") == 0).drop("_k", "_step", "_tile")


def recurrence(episodes: DataFrame, hours: int = 4) -> DataFrame:
    """Of each (market, direction): episodes, median minutes between starts, peak edge, best tier, the busiest start hours."""
    w = Window.partitionBy("market", "direction")
    us = F.unix_micros("start_ts")
    gap = episodes.withColumn("_gap", (us - F.lag(us).over(w.orderBy("start_ts"))) / 6e7)
    base = gap.groupBy("market", "direction").agg(F.count("*").alias("episodes"), F.median("_gap").alias("median_gap_min"), F.max("median_depth_edge").alias("peak_depth_edge"), F.max("through_ms").alias("through_ms"))
    by_hour = episodes.groupBy("market", "direction", F.hour("start_ts").alias("h")).agg(F.count("*").alias("n"))
    top = by_hour.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("n"), "h"))).filter(F.col("_rn") <= hours)
    lists = top.groupBy("market", "direction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "h"))), lambda x: x["h"].cast("string")), ",").alias("top_hours"))
    return base.join(lists, ["market", "direction"], "left")


def survival_split(ladders: DataFrame, buckets: DataFrame) -> DataFrame:
    """Ladders by bucket of their market (unusable by default): tiers and counts at 250, 500 and 1000 ms."""
    rows = ladders.withColumn("market", market(F.col("pair_key"))).join(buckets.select("market", "bucket"), "market", "left")
    at = [F.count_if(F.col("through_ms") >= k).alias(f"ge_{k}") for k in (250, 500, 1000)]
    return rows.filter("tier IS NOT NULL").groupBy(F.coalesce("bucket", F.lit("unusable")).alias("bucket"), "tier").agg(F.count("*").alias("n"), *at)


def page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int, most: int = 500) -> DataFrame:
    """Keyset pagination: the next rows behind `after` in the order of keys, 1 to `most` of them."""
    if after is not None:
        later = F.lit(False)
        for k in range(len(keys)):
            same = F.lit(True)
            for j in range(k):
                same &= F.col(keys[j]) == after[j]
            later |= same & (F.col(keys[k]) > after[k])
        rows = rows.filter(later)
    return rows.orderBy(*keys).limit(min(max(1, limit), most))


def in_edge_runs(edges: DataFrame, hit: Column, by: list[str], order: list[str]) -> DataFrame:
    """Adds run: how many rows in a row have been in edge, 0 where the row isn't; order[0] is a number of microseconds.

    Hits so far less those at the last row that was no hit: both are running values, so an island of any length is split.
    """
    out = tiles.tiled(edges.withColumn("_hit", hit), by, F.col(order[0]))
    out = tiles.running(out, by, order, {"_hits": F.col("_hit").cast("long")})
    out = tiles.running(out, by, order, {"_lost": F.when(F.col("_hit"), 0).otherwise(F.col("_hits"))}, how="max")
    return out.withColumn("run", F.when(F.col("_hit"), F.col("_hits") - F.col("_lost")).otherwise(0)).drop("_hit", "_hits", "_lost", "_tile")


def ewma(samples: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.2) -> DataFrame:
    """Exponential moving average of each key, seeded by its first sample: a fold over the key's ordered samples."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))))
    rows = samples.groupBy(*by).agg(ordered.alias("_x"))
    fold = F.aggregate(F.slice("_x", 2, F.greatest(F.size("_x") - 1, F.lit(0))), F.get("_x", F.lit(0))["_v"], lambda a, x: (1 - alpha) * a + alpha * x["_v"])
    return rows.select(*by, fold.alias("ewma"))
