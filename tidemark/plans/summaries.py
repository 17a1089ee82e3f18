"""Queries of summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import episodes as EP
from tidemark.operators import summaries as M
from tidemark.operators import value as V
from tidemark.plans import core
from tidemark.plans import sql as S
from tidemark.plans.registry import query
from tidemark.sources import bridge

_DEPTH = " + ".join(f"{s}_sz_{i}" for s in ("bid", "ask") for i in range(1, bridge.LEVELS + 1))
_LEGS = f"""l AS (SELECT leg, {_DEPTH} AS depth, round(best_ask - best_bid, 9) AS spread FROM books),
q AS (SELECT leg, count(*) AS rows, quantile_cont(depth, 0.5) AS median_depth, list_sort(list(spread))[round_even((count(*) - 1) * 0.5, 0)::BIGINT + 1] AS spread_p50, list_sort(list(spread))[round_even((count(*) - 1) * 0.9, 0)::BIGINT + 1] AS spread_p90 FROM l GROUP BY 1)"""


@query(f"WITH {bridge.BOOKS_SQL}, {_LEGS} SELECT * FROM q")
def leg_liquidity(spark, sf):
    return M.leg_liquidity(bridge.books(spark, sf))


@query(f"WITH {bridge.BOOKS_SQL}, {_LEGS} SELECT round((SELECT median_depth FROM q WHERE leg = 'A') / (SELECT median_depth FROM q WHERE leg = 'B'), 4) AS a_to_b_depth_ratio")
def depth_ratio(spark, sf):
    return M.depth_ratio(M.leg_liquidity(bridge.books(spark, sf)))


def _stamped(spark, sf):
    return core.survival_stamp(spark, sf).join(bridge.probes(spark, sf).select("seq", "benchmark_ms", (F.col("seq") % 3 != 0).alias("public_probe")), "seq")


_STAMPED = f"{S.LADDERS}, st AS (SELECT p.pair_key, p.seq, p.benchmark_ms, p.seq % 3 <> 0 AS public_probe, lad.through_ms, lad.tier FROM probes p JOIN lad USING (pair_key, direction, ladder))"


@query(f"""WITH {_STAMPED}, t AS (SELECT pair_key, tier, count(*) AS n FROM st WHERE public_probe AND benchmark_ms = 0 AND tier IS NOT NULL GROUP BY 1, 2)
SELECT pair_key, max(through_ms) AS max_through_ms, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM t WHERE t.pair_key = st.pair_key), 0) AS ladders, (SELECT string_agg(tier || ':' || n, ',' ORDER BY tier) FROM t WHERE t.pair_key = st.pair_key) AS tiers FROM st WHERE public_probe GROUP BY pair_key""")
def probe_summary(spark, sf):
    out = M.probe_summary(_stamped(spark, sf), ["pair_key"])
    return out.withColumn("tiers", F.array_join(F.transform("tiers", lambda x: F.concat_ws(":", x["tier"], x["n"].cast("string"))), ","))


@query(f"WITH {_STAMPED} SELECT count(*) AS probed, count(*) FILTER (tier IN ('survived_250ms', 'survived_500ms', 'survived_1000ms')) AS graded_total FROM st WHERE public_probe AND tier IS NOT NULL")
def graded_probes(spark, sf):
    return M.graded(_stamped(spark, sf))


@query(f"WITH {_STAMPED} SELECT tier, count(*) FILTER (pair_key LIKE 'click%') AS new, count(*) FILTER (pair_key LIKE 'view%' OR pair_key LIKE 'error%') AS old FROM st WHERE benchmark_ms = 0 AND tier IS NOT NULL AND (pair_key LIKE 'click%' OR pair_key LIKE 'view%' OR pair_key LIKE 'error%') GROUP BY 1")
def baseline_tiers(spark, sf):
    st = _stamped(spark, sf)
    of = lambda name: st.filter(F.col("pair_key").startswith(name))
    return M.against_baselines(of("click"), [of("view"), of("error")])


_DETECT = "SELECT l_partkey % 100 AS pair_key, l_extendedprice / 1000 - 30 AS skew_ms, l_tax > 0.04 AS qualifies, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS survived FROM lineitem"


def _detections(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select((F.col("l_partkey") % 100).alias("pair_key"), (F.col("l_extendedprice") / 1000 - 30).alias("skew_ms"), (F.col("l_tax") > 0.04).alias("qualifies"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("survived"))


@query(f"""WITH d AS ({_DETECT}), r AS (SELECT *, row_number() OVER (ORDER BY abs(skew_ms)) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT count(*) AS arbs_detected, count(*) FILTER (qualifies) AS qualifying, count(survived) AS survival_probes, count(*) FILTER (survived) AS survived_confirmed, round(max(abs(skew_ms)), 2) AS skew_max,
{", ".join(f"max(abs(skew_ms)) FILTER (i = least(n - 1, floor(n * {k} / 100.0))) AS skew_p{k}" for k in (50, 95, 99))} FROM r""")
def scan_counters(spark, sf):
    return M.scan_counters(_detections(spark, sf))


@query(f"SELECT pair_key, count(*) AS n FROM ({_DETECT}) GROUP BY 1")
def opportunities_by_pair(spark, sf):
    return M.by_pair(_detections(spark, sf))


@query("""WITH e AS (SELECT l_partkey AS token, CASE WHEN l_linenumber % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN l_tax > 0.06 THEN 'book' ELSE 'change' END AS kind, l_orderkey * 10 + l_linenumber AS seq, round((l_quantity % 12) / 10, 2) AS price, l_suppkey % 7 - 1 AS size FROM lineitem),
b AS (SELECT token, max(seq) AS bk FROM e WHERE kind = 'book' GROUP BY 1), k AS (SELECT e.* FROM e JOIN b USING (token) WHERE seq >= bk AND price > 0 AND price < 1 AND (kind = 'change' OR seq = bk))
SELECT * FROM (SELECT token, side, price, arg_max(size, seq) AS size FROM k GROUP BY 1, 2, 3) WHERE size > 0""")
def rebuilt_books(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    e = li.select(
        F.col("l_partkey").alias("token"), F.when(F.col("l_linenumber") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.when(F.col("l_tax") > 0.06, "book").otherwise("change").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.round((F.col("l_quantity") % 12) / 10, 2).alias("price"), (F.col("l_suppkey") % 7 - 1).alias("size"),
    )
    return M.rebuilt(e, ["token"])


@query("""WITH s AS (SELECT l_partkey AS pair_key, l_linestatus AS leg, quantile_cont(l_tax - l_discount, 0.5) AS m FROM lineitem GROUP BY 1, 2), w AS (SELECT pair_key, max(m) AS sp FROM s GROUP BY 1)
SELECT p_partkey AS pair_key, round(0.9 * 0.05 * p_size / 365.0, 9) AS hold, round(greatest(coalesce(sp, 0.02), 0), 9) AS cross_spread FROM part LEFT JOIN w ON p_partkey = pair_key""")
def unwind_costs(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("pair_key"), F.col("l_linestatus").alias("leg"), F.col("l_tax").alias("best_ask"), F.col("l_discount").alias("best_bid"))
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("pair_key"), F.col("p_size").alias("days")).join(M.displayed_spread(li, ["pair_key"]), "pair_key", "left")
    cost = lambda hold: F.round(M.unwind_cost(F.lit(0.9), 0.05, F.col("days"), F.col("unwind_spread"), 0.02, hold), 9)
    return p.select("pair_key", cost(True).alias("hold"), cost(False).alias("cross_spread"))


@query("WITH c AS (SELECT p_partkey AS market, CASE p_size % 3 WHEN 0 THEN 'transient_candidate' WHEN 1 THEN 'basis_suspect' ELSE 'unusable' END AS bucket, p_retailprice AS score FROM part) SELECT * FROM c ORDER BY CASE bucket WHEN 'transient_candidate' THEN 0 WHEN 'basis_suspect' THEN 1 ELSE 2 END, score DESC, market LIMIT 900")
def pair_report_order(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    kind = F.when(F.col("p_size") % 3 == 0, "transient_candidate").when(F.col("p_size") % 3 == 1, "basis_suspect").otherwise("unusable")
    return M.pair_order(p.select(F.col("p_partkey").alias("market"), kind.alias("bucket"), F.col("p_retailprice").alias("score"))).limit(900)


@query("WITH r AS (SELECT l_partkey AS market, l_linestatus AS direction, count(*) AS episodes, max(l_linenumber) * 150 AS ms FROM lineitem GROUP BY 1, 2), t AS (SELECT market, direction, episodes, CASE WHEN ms >= 1000 THEN 'survived_1000ms' WHEN ms >= 500 THEN 'survived_500ms' WHEN ms >= 250 THEN 'survived_250ms' WHEN ms >= 100 THEN 'survived_100ms' END AS tier FROM r) SELECT * FROM t ORDER BY coalesce(tier, '') DESC, episodes DESC, market, direction LIMIT 700")
def recurrence_report(spark, sf):
    r = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_partkey").alias("market"), F.col("l_linestatus").alias("direction")).agg(F.count("*").alias("episodes"), (F.max("l_linenumber") * 150).alias("ms"))
    return M.recurrence_order(r.withColumn("tier", EP.tier(F.col("ms"))).drop("ms")).limit(700)


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS recurs FROM part")
def cross_soak_recurrence(spark, sf):
    others = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return M.members(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey"), others, "p_partkey")


_STRATEGY = "SELECT l_partkey % 4 = 0 AS is_probe, l_tax > 0.05 AS qualifies, CASE WHEN l_returnflag = 'R' THEN l_linenumber * 100 END AS through_ms, l_shipdate AS capture_ts FROM lineitem"


@query(f"""WITH r AS ({_STRATEGY}), a AS (SELECT count(*) FILTER (NOT is_probe) AS snapshots, count(*) FILTER (NOT is_probe AND qualifies) AS qualifying_rows, count(*) FILTER (qualifies AND through_ms IS NOT NULL) AS probed,
count(*) FILTER (qualifies AND through_ms >= 250) AS alive, (max(epoch_us(capture_ts)) FILTER (NOT is_probe) - min(epoch_us(capture_ts)) FILTER (NOT is_probe)) / 3.6e9 AS h FROM r)
SELECT snapshots, qualifying_rows, probed, round(alive / probed::DOUBLE * qualifying_rows / snapshots::DOUBLE, 6) AS chance_of_profit, round(1 - alive / probed::DOUBLE * qualifying_rows / snapshots::DOUBLE * 0.9, 6) AS chance_of_loss, round(h, 2) AS soak_hours FROM a""")
def profit_chances(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = li.select((F.col("l_partkey") % 4 == 0).alias("is_probe"), (F.col("l_tax") > 0.05).alias("qualifies"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") * 100).alias("through_ms"), F.col("l_shipdate").cast("timestamp").alias("capture_ts"))
    return V.chances(rows, 250.0, 0.25, 0.1)
