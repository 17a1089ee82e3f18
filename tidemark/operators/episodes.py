"""Episodes of qualifying edges: sessions, persistence, survival, classification, score and fee sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import tiles
from tidemark.operators.edges import qualifies


def market(pair_key: Column) -> Column:
    return F.substring_index(pair_key, "|", 1)


def persistence(edges: DataFrame, g: P.Gate = P.Gate()) -> DataFrame:
    """Cycles of each market, cycles in edge, and whether the share marks a basis; a missing stamp is a cycle of its own."""
    stamp = F.coalesce(F.col("capture_ts").cast("string"), F.lit("-"))
    out = edges.groupBy(market(F.col("pair_key")).alias("market")).agg(F.countDistinct(stamp).alias("total_cycles"), F.countDistinct(F.when(qualifies(g), stamp)).alias("in_edge_cycles"))
    return out.withColumn("is_basis", F.col("in_edge_cycles") / F.col("total_cycles") > g.cutoff)


def sessions(rows: DataFrame, by: list[str], at: str, gap_seconds: float) -> DataFrame:
    """Adds session: 0, 1, ... in each key; a gap longer than gap_seconds starts a new one."""
    us = F.unix_micros(at)
    out = tiles.previous(tiles.tiled(rows, by, us), by, [at], {"_at": us})
    new = F.when(us - F.col("_at") > int(gap_seconds * 1e6), 1).otherwise(0)
    return tiles.running(out, by, [at], {"session": new}).drop("_at", "_tile")


def build(edges: DataFrame, g: P.Gate = P.Gate()) -> DataFrame:
    """One row for each episode of a (pair, direction)."""
    rows = sessions(edges.filter(qualifies(g) & F.col("capture_ts").isNotNull()), ["pair_key", "direction"], "capture_ts", g.gap_seconds)
    out = rows.groupBy("pair_key", "direction", "session").agg(
        F.min("capture_ts").alias("start_ts"), F.max("capture_ts").alias("end_ts"), F.count("*").alias("snapshots"), F.max("fee_adj_edge").alias("peak_edge"),
        F.median("fee_adj_edge").alias("median_edge"), F.median("depth_adj_edge").alias("median_depth_edge"), F.max("max_profitable_size").alias("max_fill_size"), F.max(F.abs("skew_ms")).alias("max_abs_skew_ms"),
    )
    return out.withColumn("duration_s", (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6).withColumn("market", market(F.col("pair_key")))


def tier(through: Column) -> Column:
    """Survival tier of the contiguous survival in milliseconds; null for null."""
    out = F.when(through.isNull(), F.lit(None).cast("string"))
    for ms in P.TIERS_MS:
        out = out.when(through >= ms, f"survived_{ms}ms")
    return out.otherwise("expired_lt_250ms")


def survived_through(probes: DataFrame, by: list[str]) -> DataFrame:
    """The largest rung before the first failure of each ladder: rungs that have no failure at or before them."""
    w = Window.partitionBy(*by).orderBy("benchmark_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    alive = probes.filter("benchmark_ms IS NOT NULL").withColumn("_ok", F.min(F.coalesce("survived", F.lit(False))).over(w))
    out = alive.groupBy(*by).agg(F.max(F.when(F.col("_ok"), F.col("benchmark_ms"))).alias("through_ms"), F.count("*").alias("rungs"))
    return out.withColumn("tier", tier(F.col("through_ms")))


def best_survival(ladders: DataFrame) -> DataFrame:
    """The best ladder of each (pair, direction)."""
    return ladders.filter("through_ms IS NOT NULL").groupBy("pair_key", "direction").agg(F.max("through_ms").alias("through_ms")).withColumn("tier", tier(F.col("through_ms")))


def tier_value(of: Column, table: dict[str, float], missing: float | None) -> Column:
    out = F.when(of.isNull(), F.lit(missing).cast("double"))
    for name, p in table.items():
        out = out.when(of == name, p)
    return out.otherwise(0.0)


def score(g: P.Gate = P.Gate()) -> Column:
    """Research score of an episode: edge in cents, survival, recurrence and capped size, less penalties."""
    cents = F.greatest(F.col("median_depth_edge"), F.lit(0.0)) * 100.0
    value = cents * tier_value(F.col("tier"), P.SCORE_BY_TIER, 0.5) * (1.0 + F.log1p(F.greatest(F.col("recurrence") - 1, F.lit(0)).cast("double"))) * F.log10(F.least(F.greatest(F.col("max_fill_size"), F.lit(1.0)), F.lit(1000.0)) + 1.0)
    return value - F.when(F.col("is_basis"), 5.0).otherwise(0.0) - F.col("max_abs_skew_ms") / g.max_skew_ms * 0.5 - F.when(F.col("snapshots") >= 2, 0.0).otherwise(cents * 0.5)


def bucket() -> Column:
    return F.when(F.col("is_basis"), P.BASIS).when((F.col("snapshots") < 2) | (F.coalesce(F.col("tier"), F.lit("")) == "expired_lt_250ms"), P.UNUSABLE).otherwise(P.TRANSIENT)


def ranked(edges: DataFrame, probes: DataFrame | None, g: P.Gate = P.Gate(), include_basis: bool = False) -> DataFrame:
    """Episodes with persistence, survival, recurrence, bucket, score and rank (transient, unusable, basis; best first)."""
    eps = build(edges, g)
    alive = best_survival(survived_through(probes, ["pair_key", "direction", "ladder"])) if probes is not None else None
    eps = eps.join(persistence(edges, g).select("market", "is_basis"), "market", "left").withColumn("is_basis", F.coalesce("is_basis", F.lit(False)))
    eps = eps.join(alive, ["pair_key", "direction"], "left") if alive is not None else eps.withColumns({"through_ms": F.lit(None).cast("int"), "tier": F.lit(None).cast("string")})
    eps = eps.withColumn("recurrence", F.count("*").over(Window.partitionBy("pair_key", "direction")))
    eps = eps.withColumns({"bucket": bucket(), "survival_p": tier_value(F.col("tier"), P.SCORE_BY_TIER, None)})
    eps = eps.withColumns({"score": score(g), "survival_adj_edge": F.col("median_depth_edge") * F.col("survival_p")})
    return eps if include_basis else eps.filter("NOT is_basis")


def bucket_rank(*order: str) -> Column:
    out = F.lit(9)
    for k, name in reversed(list(enumerate(order))):
        out = F.when(F.col("bucket") == name, k).otherwise(out)
    return out


def rejection(g: P.Gate = P.Gate()) -> Column:
    """Why a market has no candidate, from maxima over its rows."""
    fresh = F.coalesce(F.col("books_fresh"), F.lit(False))
    near = fresh & F.coalesce(F.abs("skew_ms") < g.max_skew_ms, F.lit(False))
    fee, deep, size = (F.max(F.when(near, F.col(c))) for c in ("fee_adj_edge", "depth_adj_edge", "max_profitable_size"))
    fee, deep = F.round(fee, 9), F.round(deep, 9)
    return (
        F.when(~F.coalesce(F.bool_or(fresh), F.lit(False)), "stale book").when(~F.coalesce(F.bool_or(near), F.lit(False)), "high skew").when(fee < 0, "negative after fees").when(F.coalesce(fee < g.min_edge, F.lit(True)), "edge below fee threshold")
        .when(F.coalesce(deep < g.min_edge, F.lit(True)), "negative after depth").when(F.coalesce(size < g.min_fill, F.lit(True)), "no depth").otherwise("below thresholds")
    )


def classify(edges: DataFrame, probes: DataFrame | None, g: P.Gate = P.Gate()) -> DataFrame:
    """Every market with its bucket, reason, shares and best episode."""
    eps = ranked(edges, probes, g, include_basis=True)
    best = eps.groupBy("market").agg(F.count("*").alias("episodes"), F.count_if(F.col("bucket") == P.TRANSIENT).alias("transient"), F.max(F.when(F.col("bucket") == P.TRANSIENT, F.col("score"))).alias("_t"), F.max("score").alias("_s"))
    out = persistence(edges, g).join(edges.groupBy(market(F.col("pair_key")).alias("market")).agg(rejection(g).alias("rejection")), "market").join(best, "market", "left")
    n = F.coalesce("transient", F.lit(0))
    kind = F.when(F.col("is_basis"), P.BASIS).when(n > 0, P.TRANSIENT).otherwise(P.UNUSABLE)
    why = F.when(F.col("is_basis"), "persistent basis").when(n > 0, "transient").otherwise(F.col("rejection"))
    return out.select("market", kind.alias("bucket"), why.alias("reason"), (F.col("in_edge_cycles") / F.col("total_cycles")).alias("in_edge_frac"), "total_cycles", F.coalesce("episodes", F.lit(0)).alias("episode_count"), F.coalesce(F.when(n > 0, F.col("_t")).otherwise(F.col("_s")), F.lit(0.0)).alias("score"))


def fee_sweep(edges: DataFrame, levels: tuple[float, ...] = P.FEE_LEVELS, base: float = P.FLAT_FEE, g: P.Gate = P.Gate()) -> DataFrame:
    """For each fee: qualifying rows outside basis markets, their markets, and markets lost against the fee before.

    Rows are tested for all levels in one pass and counted by (market, level) before anything is gathered.
    """
    basis = persistence(edges, g).filter("is_basis").select("market")
    rows = edges.withColumn("market", market(F.col("pair_key"))).join(basis, "market", "left_anti")
    hits = F.array_compact(F.array(*(F.when(qualifies(g, F.lit(base - f)), F.lit(k)) for k, f in enumerate(levels))))
    counted = rows.select("market", F.explode(hits).alias("k")).groupBy("market", "k").agg(F.count("*").alias("n"))
    by_level = counted.groupBy("k").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("market")).alias("markets"))
    grid = edges.sparkSession.createDataFrame([(k, float(f)) for k, f in enumerate(levels)], "k int, fee double")
    out = grid.join(F.broadcast(by_level), "k", "left").select("k", "fee", F.coalesce("n", F.lit(0)).alias("candidate_rows"), F.coalesce("markets", F.array().cast("array<string>")).alias("markets"))
    before = F.lag("markets").over(Window.orderBy("k"))  # one row for each fee level
    return out.select("fee", "candidate_rows", "markets", F.coalesce(F.array_except(before, F.col("markets")), F.array().cast("array<string>")).alias("dropped"))
