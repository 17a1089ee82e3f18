"""Steps of the live scanner: pairing of fetches, probes of detections at rungs, standard edge rows, throttles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.books import worst

#: Fixed value: the rung that stands for a probe where it is among the rungs.
BASELINE_MS = 200


def cycles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paired snapshots of two concurrent fetches (cycle, pair_key, recv_ns, ...): a pair goes where a leg failed."""
    side = lambda x, p: x.select("cycle", "pair_key", F.col("recv_ns").alias(f"{p}_ns"))
    rows = side(a, "a").join(side(b, "b"), ["cycle", "pair_key"])
    return rows.withColumns({"skew_ms": (F.col("a_ns") - F.col("b_ns")) / 1e6, "recv_ns": F.greatest("a_ns", "b_ns")})


def specified(batch: DataFrame, pairs: DataFrame) -> DataFrame:
    """The keys of a scanner batch with their pair's columns."""
    return batch.join(pairs, "pair_key")


def survival_edge() -> Column:
    """The depth edge where the book's depth is whole, else the edge after fees."""
    return F.when(F.col("liquidity_complete"), F.col("depth_adj_edge")).otherwise(F.col("fee_adj_edge"))


def probed(detections: DataFrame, probes: DataFrame) -> DataFrame:
    """Detections (detection, direction, recv_ns) with the probe of the same direction: survived, edge, qualifies, elapsed.

    probes: (detection, direction, delay_ms, recv_ns, qualifies and the columns of survival_edge). A detection without a
    probe has not survived.
    """
    p = probes.select("detection", "direction", "delay_ms", F.col("recv_ns").alias("_ns"), F.col("qualifies").alias("_q"), survival_edge().alias("_edge"))
    rows = detections.join(p, ["detection", "direction"], "left")
    elapsed = F.round((F.col("_ns") - F.col("recv_ns")) / 1e6, 2)
    return rows.withColumns({"survived": F.coalesce(F.col("_edge") > 0, F.lit(False)), "edge": F.col("_edge"), "probe_qualifies": F.coalesce("_q", F.lit(False)), "elapsed_ms": elapsed}).drop("_ns", "_q", "_edge")


def rungs(detections: DataFrame, probes: DataFrame, delays: tuple[int, ...]) -> DataFrame:
    """One row a detection with a column for each rung, and the baseline rung (200 ms, else the middle one) as survived."""
    delays = tuple(sorted(delays))
    base = BASELINE_MS if BASELINE_MS in delays else delays[len(delays) // 2]
    grid = detections.withColumn("delay_ms", F.explode(F.array(*(F.lit(d) for d in delays))))
    p = probes.select("detection", "direction", "delay_ms", survival_edge().alias("_edge"))
    rows = grid.join(p, ["detection", "direction", "delay_ms"], "left").withColumn("_s", F.coalesce(F.col("_edge") > 0, F.lit(False)))
    at = lambda d, c: F.max(F.when(F.col("delay_ms") == d, F.col(c)))
    cells = [x for d in delays for x in (at(d, "_s").alias(f"probe_{d}ms_survived"), at(d, "_edge").alias(f"probe_{d}ms_edge"))]
    return rows.groupBy("detection", "direction").agg(*cells, at(base, "_s").alias("survived"), at(base, "_edge").alias("survived_edge"))


def round_trip_ms(a_fetch: Column, b_fetch: Column, skew: Column) -> Column:
    """The slower leg's fetch time, else the absolute skew, else 0."""
    return F.coalesce(F.greatest(a_fetch, b_fetch), F.abs(skew), F.lit(0.0))


def survival_probability(latency_ms: Column, tiers: dict[int, float]) -> Column:
    """The probability of the smallest tier at or above an assumed latency, 0 if there is none."""
    out = F.lit(0.0)
    for ms in sorted(tiers, reverse=True):
        out = F.when(latency_ms <= ms, tiers[ms]).otherwise(out)
    return out


def viable(status: Column) -> Column:
    """Only fresh books are modelled."""
    return F.coalesce(status == "fresh", F.lit(False))


def is_probe(public_probe: Column, benchmark_ms: Column) -> Column:
    return F.coalesce(public_probe, F.lit(False)) | (F.coalesce(benchmark_ms, F.lit(0)) != 0)


def numeric_max(*texts: Column) -> Column:
    """The greatest of those that are numbers."""
    return F.greatest(*(t.try_cast("double") for t in texts))


def expected_fill(a_size: Column, b_size: Column, profitable: Column, haircut: float) -> Column:
    """Haircut times the smaller leg's size, or times the profitable size where a leg's is not known; not below 0."""
    known = a_size.isNotNull() & b_size.isNotNull()
    return F.greatest(haircut * F.when(known, F.least(a_size, b_size)).otherwise(F.coalesce(profitable, F.lit(0.0))), F.lit(0.0))


#: Defaults of stored edge rows that lack a column: conservative, never computed anew.
DEFAULTS = {
    "pair_key": "", "display_name": "", "direction": "", "scanned_at": "", "arb_detected": False, "qualifies": False, "round_trip_latency_ms": 0.0, "est_fees": 0.0, "est_profit": 0.0,
    "raw_edge": 0.0, "fee_adj_edge": 0.0, "depth_adj_edge": 0.0, "visible_size": 0.0, "executable_size": 0.0, "capture_skew_ms": 0.0, "freshness_status": "unknown",
    "fee_model_version": "unknown", "simulation_scope": "paper_scan", "contract_equivalent": "unreviewed", "include": False,
}


def passed_through(rows: DataFrame) -> DataFrame:
    """Stored standard rows: what is there stays, what is missing gets its default, an empty name becomes the key."""
    out = [(F.coalesce(F.col(n), F.lit(d)) if n in rows.columns else F.lit(d)).alias(n) for n, d in DEFAULTS.items()]
    return rows.select("edge_id", *out).withColumn("display_name", F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.col("pair_key")))


def standard(records: DataFrame, pairs: DataFrame, haircut: float) -> DataFrame:
    """Scanner records as standard edge rows with their pair's registry columns; unknown pairs get denying values.

    records: edge_id, pair_key, direction, edges, sizes, a_fetch_ms, b_fetch_ms, capture_skew_ms, a_status, b_status,
    fee_usd, target_size, fee_model_version, arb_detected, qualifies.
    """
    c = F.col
    rows = records.join(pairs.select("pair_key", "display_name", "equivalence", "include"), "pair_key", "left")
    real = c("fee_usd").isNotNull() & (c("target_size") > 0)
    size = F.coalesce("max_profitable_size", F.lit(0.0)) * haircut
    return rows.select(
        "edge_id", "pair_key", F.coalesce(F.nullif(c("display_name"), F.lit("")), c("pair_key")).alias("display_name"), "direction", F.coalesce("arb_detected", F.lit(False)).alias("arb_detected"), F.coalesce("qualifies", F.lit(False)).alias("qualifies"),
        round_trip_ms(c("a_fetch_ms"), c("b_fetch_ms"), c("capture_skew_ms")).alias("round_trip_latency_ms"),
        F.when(real, c("fee_usd") / c("target_size")).otherwise(F.greatest(F.coalesce("raw_edge", F.lit(0.0)) - F.coalesce("fee_adj_edge", F.lit(0.0)), F.lit(0.0))).alias("est_fees"),
        F.when(real, F.coalesce("fee_model_version", F.lit("unknown"))).otherwise("flat_heuristic").alias("fee_model_version"),
        F.coalesce(c("depth_adj_edge") * size, F.lit(0.0)).alias("est_profit"), size.alias("executable_size"), worst(c("a_status"), c("b_status")).alias("freshness_status"),
        F.coalesce("equivalence", F.lit("unreviewed")).alias("contract_equivalent"), F.coalesce("include", F.lit(False)).alias("include"),
    )


def qualifying(rows: DataFrame, only: bool) -> DataFrame:
    """What an edge sink keeps: everything, or only rows that pass the gate."""
    return rows.filter("qualifies") if only else rows


def with_edge_id(rows: DataFrame, soak: Column, file: Column, order: str) -> DataFrame:
    """edge_id = soak:file:number, the number being the row's place in its file."""
    n = F.row_number().over(Window.partitionBy(soak, file).orderBy(order)) - 1
    return rows.withColumn("edge_id", F.concat_ws(":", soak, file, n.cast("string")))


def throttled(detections: DataFrame, at_s: str, gap_s: float = 600.0, by: str = "pair_key") -> DataFrame:
    """Detections that may be probed: the first of a pair and each that comes gap_s or more behind the last one probed.

    Each choice depends on the one before, so a pair's times are folded in order; times alone are held.
    """
    times = detections.groupBy(by).agg(F.array_sort(F.collect_set(at_s)).alias("_t"))
    start = F.array().cast(f"array<{detections.schema[at_s].dataType.simpleString()}>")
    step = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) >= gap_s), F.concat(kept, F.array(t))).otherwise(kept)
    chosen = times.select(by, F.explode(F.aggregate("_t", start, step)).alias(at_s))
    return detections.join(chosen, [by, at_s], "left_semi")


def snapshot_seq(rows: DataFrame, order: list[str]) -> DataFrame:
    """A snapshot sink: legs unchanged in (leg, market_id, recv_ns) go, the others are numbered in order, by leg and market."""
    w = Window.partitionBy("leg", "market_id").orderBy(*order)
    return rows.dropDuplicates(["leg", "market_id", "recv_ns"]).withColumn("seq", F.row_number().over(w))
