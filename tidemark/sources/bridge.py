"""Order books, probes and a registry projected from the driver's event table, as Spark and as SQL.

The tables hold no order books, so queries run on this deterministic projection: even events are quotes of leg A, odd
ones of leg B, event types are markets, and microseconds since 2024 stand for receive nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 5

_RUNGS = "0, 25, 100, 250, 500, 1000"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each quote: keys, clocks, freshness, top of book and five levels a side."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("capture_ts"), "user_id", "event_type", "value")
    levels = []
    for i in range(1, LEVELS + 1):
        size = f"CAST(1 + pmod(event_id * {7 * i}, 50) AS DOUBLE)"
        levels += [f"(m - {i}) / 100D AS bid_px_{i}", f"{size} AS bid_sz_{i}", f"(m + {i}) / 100D AS ask_px_{i}", f"{size} AS ask_sz_{i}"]
    return e.selectExpr("*", "CAST(30 + pmod(floor(value * 100), 21) AS INT) AS m").selectExpr(
        "CASE WHEN pmod(event_id, 2) = 0 THEN 'A' ELSE 'B' END AS leg", "event_type AS market_id", "event_id AS capture_seq", "capture_ts",
        "unix_micros(capture_ts) - 1704067200000000 AS recv_ns", "CAST(pmod(event_id, 97) AS DOUBLE) AS staleness_s",
        "CASE WHEN pmod(event_id, 97) > 60 THEN 'stale' ELSE 'fresh' END AS status", "(m - 1) / 100D AS best_bid", "(m + 1) / 100D AS best_ask",
        "m / 100D AS mid", "value AS fetch_ms", "user_id", *levels,
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair registry: every market with both legs, and whether it counts for strategy metrics."""
    m = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    return m.select(F.concat("event_type", F.lit("|b-"), "event_type").alias("pair_key"), F.col("event_type").alias("a_market"), F.col("event_type").alias("b_market"), (F.length("event_type") % 2 == 0).alias("include"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival ladders: one row for each rung of (pair, direction, ladder)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return e.select(
        F.concat("event_type", F.lit("|b-"), "event_type").alias("pair_key"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "a_yes_b_no").otherwise("a_no_b_yes").alias("direction"),
        F.col("user_id").alias("ladder"),
        F.element_at(F.array(*(F.lit(int(x)) for x in _RUNGS.split(","))), (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("benchmark_ms"),
        (F.pmod(F.floor("value"), F.lit(3)) != 0).alias("survived"),
        F.col("event_id").alias("seq"),
    )


def _levels_sql() -> str:
    return ",\n".join(f"(m - {i}) / 100.0::DOUBLE AS bid_px_{i}, (1 + (event_id * {7 * i}) % 50)::DOUBLE AS bid_sz_{i}, (m + {i}) / 100.0::DOUBLE AS ask_px_{i}, (1 + (event_id * {7 * i}) % 50)::DOUBLE AS ask_sz_{i}" for i in range(1, LEVELS + 1))


BOOKS_SQL = f"""books AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS leg, event_type AS market_id, event_id AS capture_seq, ts AS capture_ts,
         epoch_us(ts) - 1704067200000000 AS recv_ns, (event_id % 97)::DOUBLE AS staleness_s,
         CASE WHEN event_id % 97 > 60 THEN 'stale' ELSE 'fresh' END AS status,
         (m - 1) / 100.0::DOUBLE AS best_bid, (m + 1) / 100.0::DOUBLE AS best_ask, m / 100.0::DOUBLE AS mid, value AS fetch_ms, user_id,
         {_levels_sql()}
  FROM (SELECT *, 30 + (floor(value * 100)::BIGINT % 21 + 21) % 21 AS m FROM events))"""

PAIRS_SQL = """pairs AS (
  SELECT DISTINCT event_type || '|b-' || event_type AS pair_key, event_type AS a_market, event_type AS b_market, length(event_type) % 2 = 0 AS include FROM events)"""

PROBES_SQL = f"""probes AS (
  SELECT event_type || '|b-' || event_type AS pair_key, CASE WHEN user_id % 2 = 0 THEN 'a_yes_b_no' ELSE 'a_no_b_yes' END AS direction,
         user_id AS ladder, ([{_RUNGS}])[(event_id % 6 + 1)::INT] AS benchmark_ms, (floor(value)::BIGINT % 3 + 3) % 3 <> 0 AS survived, event_id AS seq
  FROM events)"""
