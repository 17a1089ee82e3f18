"""Data quality of captured books: per-market counts, global duplicates, percentiles, thresholds and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import tiles
from tidemark.params import FRESH_SECONDS

#: The thresholds of the gates.
MIN_ROWS, MAX_GAP_RATE, MAX_STALE_RATE, MAX_OFFSET_MS = 1440, 0.05, 0.10, 100.0


def markets(books: DataFrame, nominal_s: float = 30.0) -> DataFrame:
    """Rows, stale, missing and crossed rows, intervals, gaps and median interval of each (leg, market)."""
    us, by = F.unix_micros("capture_ts"), ["leg", "market_id"]
    slim = books.select(*by, "capture_ts", "capture_seq", "status", "best_bid", "best_ask", "staleness_s")
    rows = tiles.previous(tiles.tiled(slim, by, us), by, ["capture_ts", "capture_seq"], {"_at": us}).withColumn("_iv", (us - F.col("_at")) / 1e6)
    return rows.groupBy("leg", "market_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "fresh").alias("fresh_rows"), F.count_if(F.col("status") == "stale").alias("stale_rows"),
        F.count_if(F.col("best_bid").isNull() & F.col("best_ask").isNull()).alias("empty_rows"), F.count_if(F.col("best_bid") > F.col("best_ask")).alias("crossed_rows"),
        F.count("_iv").alias("intervals"), F.count_if(F.col("_iv") > 2 * nominal_s).alias("gap_intervals"),
        F.max("staleness_s").alias("max_staleness_s"),
    ).join(linear(rows, by, "_iv", {"median_interval_s": 0.5}), by, "left")


def run_level(books: DataFrame) -> DataFrame:
    """Rows, duplicate sequence numbers over all legs and files, and linear percentiles of the fetch time."""
    # Sequence numbers are counted where they meet, so no task holds all of them.
    again = books.groupBy("capture_seq").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("capture_seq").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_seq"))
    return again.join(linear(books, [], "fetch_ms", {"fetch_p50": 0.5, "fetch_p99": 0.99}), how="left")  # one row and one row


def thresholds(per_market: DataFrame, duplicates: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """One row: worst values, each threshold's verdict, and the health and freshness gates; null without markets.

    offsets: (run_id, ntp_offset_ms), null where a run did not measure it; a run beyond the bound fails the health gate.
    """
    worst = per_market.agg(F.min("rows").alias("min_rows"), F.max(F.col("gap_intervals") / F.when(F.col("intervals") > 0, F.col("intervals"))).alias("gap_rate"), F.max(F.col("stale_rows") / F.col("rows")).alias("stale_rate"), F.sum("crossed_rows").alias("crossed"))
    out = worst.crossJoin(F.broadcast(duplicates.select("duplicate_seq")))  # one row and one row
    out = out.withColumns({"rows_ok": F.col("min_rows") >= MIN_ROWS, "gap_ok": F.col("gap_rate") < MAX_GAP_RATE, "stale_ok": F.col("stale_rate") < MAX_STALE_RATE, "dup_ok": F.col("duplicate_seq") == 0, "crossed_ok": F.col("crossed") == 0})
    if offsets is None:
        out = out.withColumns({"bad_offsets": F.lit(0).cast("long"), "offset_ok": F.lit(True)})
    else:
        bad = offsets.agg(F.count_if(F.abs("ntp_offset_ms") > MAX_OFFSET_MS).alias("bad_offsets"))
        out = out.crossJoin(F.broadcast(bad)).withColumn("offset_ok", F.col("bad_offsets") == 0)  # one row
    true = lambda *c: [F.coalesce(F.col(x), F.lit(True)) for x in c]
    a, b, c, d, e = true("rows_ok", "gap_ok", "dup_ok", "crossed_ok", "offset_ok")
    return out.withColumns({"health_ok": a & b & c & d & e, "freshness_ok": true("stale_ok")[0]})


def by_leg(books: DataFrame) -> DataFrame:
    return books.groupBy("leg").agg(F.count("*").alias("rows"), F.avg((F.col("status") == "fresh").cast("double")).alias("fresh_rate"), F.avg((F.col("status") == "stale").cast("double")).alias("stale_rate"))


def floor_place(pct: float) -> Column:
    """The index floor(n x pct / 100) of the sorted values, at most the last."""
    return F.least(F.col("_n") - 1, F.floor(F.col("_n") * pct / 100))


def rounded_place(q: float) -> Column:
    """The index (n - 1) x q rounded half to even."""
    return F.least(F.col("_n") - 1, F.bround((F.col("_n") - 1) * q, 0).cast("long"))


#: Equal slices of a key's range of values: the place of a rank is found by slices first, then inside one.
SLICES = 1024


def ranked_values(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """name = the index-th smallest value of each key, for each index (which may use _n, the key's count).

    Values are counted first; slices of the value's range are counted next, at most SLICES rows a key; only the slices
    that hold a place are ordered. So neither a key's rows nor all its distinct values meet in a task.
    """
    own = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ends = counts.groupBy(*own).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    cut = counts.join(ends, own).withColumn("_s", F.least(F.floor(share * SLICES), F.lit(SLICES - 1)))
    before = Window.partitionBy(*own).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = cut.groupBy(*own, "_s").agg(F.sum("_c").alias("_m"), F.first("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), i.cast("long").alias("i")) for n, i in places.items()))).alias("_q")
    hit = slices.select(*own, "_s", "_m", "_before", asked).filter((F.col("_q.i") >= F.col("_before")) & (F.col("_q.i") < F.col("_before") + F.col("_m")))
    inside = Window.partitionBy(*own, "_s", "_q.name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.select(*own, "_s", "_v", "_c").join(hit.select(*own, "_s", "_before", "_q"), [*own, "_s"])
    placed = placed.withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
    found = placed.filter((F.col("_q.i") >= F.col("_to") - F.col("_c")) & (F.col("_q.i") < F.col("_to")))
    out = found.groupBy(*own).agg(*(F.max(F.when(F.col("_q.name") == n, F.col("_v"))).alias(n) for n in places))
    return out if by else out.drop("_all")


def ranked_value(rows: DataFrame, by: list[str], value: str, index: Column, name: str) -> DataFrame:
    return ranked_values(rows, by, value, {name: index})


def linear(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation between the two values around (n - 1) x q; the median is that of q = 0.5."""
    at = lambda q: (F.col("_n") - 1) * F.lit(q)
    places = {f"_{k}_{n}": f(at(q)) for n, q in quantiles.items() for k, f in (("lo", F.floor), ("hi", F.ceil))}
    # The fraction needs the count once more, in the same order of operations.
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    got = ranked_values(rows, by, value, places)
    both = got.join(n, by) if by else got.crossJoin(F.broadcast(n))  # one row and one row
    out = [(F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * (at(q) - F.floor(at(q)))).alias(m) for m, q in quantiles.items()]
    return both.select(*by, *out)


def continuity(events: DataFrame) -> DataFrame:
    """Counts of a continuity log by kind and reason."""
    return events.groupBy("kind", "reason").agg(F.count("*").alias("n"))


def late_cycles(events: DataFrame, by: list[str], at: str, cadence_s: float, late: float = 1.5) -> DataFrame:
    """Rows that come later than `late` cadences behind the one before."""
    us = F.unix_micros(at)
    rows = tiles.previous(tiles.tiled(events, by, us), by, [at], {"_at": us})
    return rows.withColumn("gap_s", (us - F.col("_at")) / 1e6).filter(F.col("gap_s") > late * cadence_s).drop("_at", "_tile")


def is_stale(age_s: Column, threshold: float = FRESH_SECONDS) -> Column:
    return age_s > threshold
