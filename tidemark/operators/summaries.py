"""Summaries of recordings: liquidity, survival over baselines, scan counters, orders of reports, books rebuilt from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators.episodes import bucket_rank
from tidemark.operators.quality import floor_place, linear, ranked_values, rounded_place
from tidemark.sources.bridge import LEVELS

#: Tiers that count as graded, and the order of tiers in a report.
GRADED = ("survived_250ms", "survived_500ms", "survived_1000ms")


def leg_liquidity(books: DataFrame) -> DataFrame:
    """Of each leg: rows, median depth of the top levels, spread p50 and p90 at the rounded index (spreads below 0 left out)."""
    size = sum((F.coalesce(F.col(f"{s}_sz_{i}"), F.lit(0.0)) for s in ("bid", "ask") for i in range(1, LEVELS + 1)), F.lit(0.0))
    rows = books.select("leg", size.alias("depth"), F.round(F.col("best_ask") - F.col("best_bid"), 9).alias("spread"))
    spreads = ranked_values(rows.filter("spread >= 0"), ["leg"], "spread", {"spread_p50": rounded_place(0.5), "spread_p90": rounded_place(0.9)})
    return rows.groupBy("leg").agg(F.count("*").alias("rows")).join(linear(rows, ["leg"], "depth", {"median_depth": 0.5}), "leg").join(spreads, "leg", "left")


def depth_ratio(legs: DataFrame) -> DataFrame:
    """One row: the median depth of leg A by that of leg B, to four places; null without leg B."""
    of = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("median_depth")))
    return legs.agg(F.round(of("A") / F.nullif(of("B"), F.lit(0.0)), 4).alias("a_to_b_depth_ratio"))


def probe_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of public probe rows (benchmark_ms, tier, through_ms): ladders counted at rung 0 by tier, and the longest survival."""
    probes = rows.filter("public_probe")
    first = F.col("benchmark_ms") == 0
    tiers = probes.filter(first & F.col("tier").isNotNull()).groupBy(*by, "tier").agg(F.count("*").alias("n"))
    top = probes.groupBy(*by).agg(F.max("through_ms").alias("max_through_ms"))
    lists = tiers.groupBy(*by).agg(F.sum("n").alias("ladders"), F.array_sort(F.collect_list(F.struct("tier", "n"))).alias("tiers"))
    return top.join(lists, by, "left").withColumn("ladders", F.coalesce("ladders", F.lit(0)))


def graded(rows: DataFrame) -> DataFrame:
    """One row for all public probe rows: how many have a tier, and how many a graded one."""
    told = rows.filter("public_probe AND tier IS NOT NULL")
    return told.agg(F.count("*").alias("probed"), F.count_if(F.col("tier").isin(*GRADED)).alias("graded_total"))


def against_baselines(new: DataFrame, baselines: list[DataFrame]) -> DataFrame:
    """Ladders by tier (counted at rung 0) of a recording beside those of all baselines together."""
    count = lambda d, name: d.filter("benchmark_ms = 0 AND tier IS NOT NULL").select("tier", F.lit(name).alias("of"))
    rows = count(new, "new")
    for b in baselines:
        rows = rows.unionByName(count(b, "old"))
    return rows.groupBy("tier").agg(F.count_if(F.col("of") == "new").alias("new"), F.count_if(F.col("of") == "old").alias("old"))


def scan_counters(detections: DataFrame) -> DataFrame:
    """One row: detections, those that qualify, probed and survived ones, and percentiles of the absolute skew at the floor index."""
    skews = detections.select(F.lit(0).alias("_k"), F.abs("skew_ms").alias("s"))
    p = ranked_values(skews, ["_k"], "s", {f"skew_p{k}": floor_place(k) for k in (50, 95, 99)})
    base = detections.agg(F.lit(0).alias("_k"), F.count("*").alias("arbs_detected"), F.count_if("qualifies").alias("qualifying"), F.count_if(F.col("survived").isNotNull()).alias("survival_probes"), F.count_if("survived").alias("survived_confirmed"), F.round(F.max(F.abs("skew_ms")), 2).alias("skew_max"))
    return base.join(p, "_k", "left").drop("_k")


def by_pair(detections: DataFrame) -> DataFrame:
    """Opportunities of each pair, the most first."""
    return detections.groupBy("pair_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair_key")


def pair_order(pairs: DataFrame) -> DataFrame:
    """Classified pairs as reports list them: transient, basis, unusable, the best score first. Opportunities have another order."""
    return pairs.orderBy(bucket_rank(P.TRANSIENT, P.BASIS, P.UNUSABLE), F.desc("score"), "market")


def recurrence_order(rows: DataFrame) -> DataFrame:
    """The recurrence report: by the tier's text, descending (as text, so 500 comes before 250 and 1000), then by episodes."""
    return rows.orderBy(F.desc(F.coalesce("tier", F.lit(""))), F.desc("episodes"), "market", "direction")


def rebuilt(events: DataFrame, by: list[str]) -> DataFrame:
    """Levels (by, side, price, size) of last-write-wins books from events (kind, seq, side, price, size).

    A book event's rows replace everything before; changes before a key's first book are ignored, as are prices outside
    0 to 1; size 0 or less takes a level away.
    """
    last = events.filter("kind = 'book'").groupBy(*by).agg(F.max("seq").alias("_book"))
    rows = events.join(last, by).filter((F.col("seq") >= F.col("_book")) & (F.col("price") > 0) & (F.col("price") < 1))
    rows = rows.filter((F.col("kind") == "change") | (F.col("seq") == F.col("_book")))
    return rows.groupBy(*by, "side", "price").agg(F.max_by("size", "seq").alias("size")).filter("size > 0")


def unwind_cost(locked: Column, apr: float, days: Column, spread: Column, fallback: float, hold: bool) -> Column:
    """What getting out of a failed leg costs a unit: capital held to resolution, or the displayed spread of the worse leg
    (the fallback where it was not seen), not below 0."""
    return locked * apr * days / 365.0 if hold else F.greatest(F.coalesce(spread, F.lit(fallback)), F.lit(0.0))


def displayed_spread(books: DataFrame, by: list[str]) -> DataFrame:
    """The median displayed spread of the worse leg of each key."""
    rows = books.select(*by, "leg", (F.col("best_ask") - F.col("best_bid")).alias("spread"))
    return linear(rows, [*by, "leg"], "spread", {"m": 0.5}).groupBy(*by).agg(F.max("m").alias("unwind_spread"))


def members(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Adds recurs: whether a row's key is in any other recording."""
    seen = others.select(key).distinct().withColumn("_in", F.lit(True))
    return rows.join(seen, key, "left").withColumn("recurs", F.coalesce("_in", F.lit(False))).drop("_in")


def first_rows(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
