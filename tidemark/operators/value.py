"""Expected value of episodes: fill probability, carry, unwinding, verdicts and the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators.episodes import tier, tier_value


def pair_value(episodes: DataFrame, grid: DataFrame, days: float, v: P.Value = P.Value(), x: P.Executable = P.Executable()) -> DataFrame:
    """EV of each (pair, direction) of the grid (pair_key, days_to_resolution); zeros where no episode qualifies.

    Episodes count from min_snapshots on, with skew up to the bound, outside basis markets.
    """
    if days <= 0:
        raise ValueError("days must be above 0")
    ok = episodes.filter((~F.col("is_basis")) & (F.col("snapshots") >= x.min_snapshots) & (F.col("max_abs_skew_ms") <= x.max_skew_ms))
    agg = ok.groupBy("pair_key", "direction").agg(F.count("*").alias("n"), F.median("median_depth_edge").alias("edge"), F.median("max_fill_size").alias("size"), F.max("through_ms").alias("through"))
    directions = F.explode(F.array(*(F.lit(d) for d in P.DIRECTIONS))).alias("direction")
    out = grid.select("pair_key", "days_to_resolution", directions).join(agg, ["pair_key", "direction"], "left")
    some = F.col("n").isNotNull()
    zero = lambda c: F.when(some, c).otherwise(0.0)
    gross = F.col("edge") + v.fee_base
    out = out.withColumn("gross", zero(gross))
    locked = F.greatest(1.0 - F.col("gross"), F.lit(0.0))
    carry = locked * v.apr * F.coalesce("days_to_resolution", F.lit(0.0)) / 365.0
    unwind = carry if v.hold_to_resolution else F.lit(max(v.fallback_spread, 0.0))
    out = out.withColumns({
        "fees": zero(F.lit(v.fee_base)), "fill_p": zero(tier_value(tier(F.col("through")), P.FILL_BY_TIER, v.unprobed_fill)),
        "fill_size": zero(x.depth_haircut * F.col("size")), "carry": zero(carry), "failed_leg": zero(v.leg_failure * unwind),
        "episodes": F.coalesce("n", F.lit(0)), "per_day": F.coalesce(F.col("n") / days, F.lit(0.0)),
    })
    out = out.withColumn("ev", (F.col("fill_p") * (F.col("gross") - F.col("fees") - F.col("carry")) - F.col("failed_leg")) * F.col("fill_size"))
    out = out.withColumn("ev_per_day", F.col("ev") * F.col("per_day"))
    viable = (F.col("ev_per_day") >= v.viable_per_day) & (F.col("per_day") * 7.0 >= v.viable_per_week)
    label = F.when(viable, "viable").when(F.col("ev_per_day") > 0, "marginal").otherwise("not_viable")
    return out.select("pair_key", "direction", "episodes", "gross", "fees", "fill_p", "fill_size", "carry", "failed_leg", "ev", "per_day", "ev_per_day", label.alias("verdict"))


def overall(values: DataFrame) -> DataFrame:
    """One verdict: viable if any is; marginal with two pairs or more; insufficient without rows."""
    n = F.countDistinct(F.when(F.col("verdict") != "not_viable", F.col("pair_key")))
    label = F.when(F.count("*") == 0, "insufficient_data").when(F.coalesce(F.bool_or(F.col("verdict") == "viable"), F.lit(False)), "viable").when(n >= 2, "marginal").otherwise("not_viable")
    return values.agg(label.alias("verdict"), F.count("*").alias("rows"), F.sum("ev_per_day").alias("ev_per_day"))


def best_row(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def chances(rows: DataFrame, latency_ms: float, placeholder: float, leg_failure: float) -> DataFrame:
    """One row over strategy rows (is_probe, qualifies, through_ms, capture_ts): how likely a profit is, and what it rests on.

    The chance that an edge outlives the reaction time is the share of probed qualifying rows that did, or a placeholder
    where none was probed; times the share of baseline rows that qualify. A loss is its complement, less failed legs.
    """
    probed = F.col("qualifies") & F.col("through_ms").isNotNull()
    base = ~F.col("is_probe")
    out = rows.agg(
        F.count_if(base).alias("snapshots"), F.count_if(base & F.col("qualifies")).alias("qualifying_rows"), F.count_if(probed).alias("probed"),
        F.count_if(probed & (F.col("through_ms") >= latency_ms)).alias("_alive"), ((F.max(F.when(base, F.unix_micros("capture_ts"))) - F.min(F.when(base, F.unix_micros("capture_ts")))) / 3.6e9).alias("_hours"),
    )
    alive = F.when(F.col("probed") > 0, F.col("_alive") / F.col("probed")).otherwise(placeholder)
    rate = F.when(F.col("snapshots") > 0, F.col("qualifying_rows") / F.col("snapshots")).otherwise(0.0)
    hours = F.when(F.col("_hours").isNotNull(), F.greatest(F.col("_hours"), F.lit(24.0 / 1440.0))).otherwise(0.0)
    profit = alive * rate
    return out.select("snapshots", "qualifying_rows", "probed", F.round(profit, 6).alias("chance_of_profit"), F.round(1.0 - profit * (1.0 - leg_failure), 6).alias("chance_of_loss"), F.round(hours, 2).alias("soak_hours"))
