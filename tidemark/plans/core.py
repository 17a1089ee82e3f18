"""Queries over the bridge: alignment, edges, episodes, survival, quality, value and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions import fees
from tidemark.operators import align, books as B, edges as E, episodes as EP, quality as Q, reports as R, value as V
from tidemark.plans import sql as S
from tidemark.plans.registry import query
from tidemark.sources import bridge
from tidemark.sources.scratch import stored

#: Bridge rows of one pair are minutes to hours apart in wall time, so sessions use a gap of six hours.
GAP = 21_600.0
GATE = P.Gate(gap_seconds=GAP)


def r9(*names: str) -> list[Column]:
    return [F.round(n, 9).alias(n) for n in names]


def _r9(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


def _us(c: str) -> Column:
    return F.unix_micros(c).alias(c)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return E.derive(E.matches(bridge.books(spark, sf), bridge.pairs(spark, sf)))


def _ladders(spark: SparkSession, sf: str) -> DataFrame:
    return EP.survived_through(bridge.probes(spark, sf), ["pair_key", "direction", "ladder"])


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with the columns that ranking and classifying look at, derived once: they are read several times."""
    return stored(_edges(spark, sf).select("pair_key", "direction", "capture_ts", "books_fresh", "skew_ms", "fee_adj_edge", "depth_adj_edge", "max_profitable_size"))


def _ranked(spark: SparkSession, sf: str, basis: bool = True) -> DataFrame:
    return EP.ranked(_judged(spark, sf), bridge.probes(spark, sf), GATE, include_basis=basis)


EPS = S.episodes(GAP)


@query(f"WITH {bridge.BOOKS_SQL} SELECT leg, market_id, capture_seq, recv_ns, round(best_bid, 9) AS best_bid, round(best_ask, 9) AS best_ask, round(mid, 9) AS mid, round(best_ask - best_bid, 9) AS spread, staleness_s, status FROM books")
def book_scan(spark, sf):
    return bridge.books(spark, sf).select("leg", "market_id", "capture_seq", "recv_ns", *r9("best_bid", "best_ask", "mid"), F.round(F.col("best_ask") - F.col("best_bid"), 9).alias("spread"), "staleness_s", "status")


@query(f"WITH {S.MATCHED} SELECT l.pair_key AS pair_key, l.capture_seq AS a_seq, r.capture_seq AS b_seq, l.recv_ns - r.recv_ns AS skew_ns, greatest(l.recv_ns, r.recv_ns) AS recv_ns FROM matched")
def asof_nearest(spark, sf):
    m = E.matches(bridge.books(spark, sf), bridge.pairs(spark, sf))
    return m.select("l.pair_key", F.col("l.capture_seq").alias("a_seq"), F.col("r.capture_seq").alias("b_seq"), (F.col("l.recv_ns") - F.col("r.recv_ns")).alias("skew_ns"), F.greatest("l.recv_ns", "r.recv_ns").alias("recv_ns"))


_LATEST = f"""WITH {bridge.BOOKS_SQL}, x AS (SELECT * FROM books WHERE leg = 'A'), y AS (SELECT * FROM books WHERE leg = 'B' QUALIFY row_number() OVER (PARTITION BY market_id, recv_ns ORDER BY capture_seq DESC) = 1)
SELECT x.market_id, x.capture_seq AS a_seq, y.capture_seq AS b_seq, x.recv_ns - y.recv_ns AS age_ns FROM x ASOF JOIN y ON x.market_id = y.market_id AND x.recv_ns {{op}} y.recv_ns WHERE abs(x.recv_ns - y.recv_ns) <= {{bound}}"""


def _by_leg(spark, sf, f, bound):
    b = bridge.books(spark, sf)
    m = f(b.filter("leg = 'A'"), b.filter("leg = 'B'"), ["market_id"], "recv_ns", bound, "capture_seq")
    return m.select("l.market_id", F.col("l.capture_seq").alias("a_seq"), F.col("r.capture_seq").alias("b_seq"), (F.col("l.recv_ns") - F.col("r.recv_ns")).alias("age_ns"))


@query(_LATEST.format(op=">=", bound=30_000_000_000))
def latest_per_leg(spark, sf):
    return _by_leg(spark, sf, align.latest, 30_000_000_000)


@query(_LATEST.format(op="<=", bound=1_000_000_000))
def delayed_observation(spark, sf):
    return _by_leg(spark, sf, align.following, 1_000_000_000)


_EDGE_COLUMNS = ("raw_edge", "fee_adj_edge", "depth_fillable_size", "vwap", "a_vwap", "b_vwap", "slippage", "depth_adj_edge", "max_profitable_size")


@query(f"WITH {S.EDGES} SELECT pair_key, direction, a_seq, b_seq, source_seq, skew_ms, books_fresh, max_staleness_s, include, depth_complete, {_r9(*_EDGE_COLUMNS)} FROM edges")
def edge_rows(spark, sf):
    return _edges(spark, sf).select("pair_key", "direction", "a_seq", "b_seq", "source_seq", "skew_ms", "books_fresh", "max_staleness_s", "include", "depth_complete", *r9(*_EDGE_COLUMNS))


@query(f"WITH {S.EDGES} SELECT pair_key, direction, count(*) AS n, count(*) FILTER (WHERE {S.GATE}) AS n_gated, round(avg(raw_edge), 9) AS avg_edge FROM edges GROUP BY 1, 2")
def edge_gate(spark, sf):
    return _edges(spark, sf).groupBy("pair_key", "direction").agg(F.count("*").alias("n"), F.count_if(E.qualifies()).alias("n_gated"), F.round(F.avg("raw_edge"), 9).alias("avg_edge"))


@query(f"WITH {S.EDGES} SELECT pair_key, direction, a_seq, round(CASE WHEN books_fresh AND abs(skew_ms) <= 250 THEN depth_adj_edge - 0.001 * greatest(max_staleness_s, 0) END, 9) AS executable, round(0.5 * greatest(max_profitable_size, 0), 9) AS fill FROM edges")
def executable_edge(spark, sf):
    return _edges(spark, sf).select("pair_key", "direction", "a_seq", F.round(E.executable(), 9).alias("executable"), F.round(E.expected_fill(), 9).alias("fill"))


@query(f"WITH {S.EDGES}, {S.PERSISTENCE} SELECT * FROM pers")
def pair_persistence(spark, sf):
    return EP.persistence(_edges(spark, sf))


_EP = "pair_key, direction, session, snapshots, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, round(duration_s, 6) AS duration_s"


@query(f"WITH {EPS} SELECT {_EP}, {_r9('peak_edge', 'median_edge', 'median_depth_edge', 'max_fill_size', 'max_abs_skew_ms')} FROM eps")
def episode_sessions(spark, sf):
    e = EP.build(_edges(spark, sf), GATE)
    return e.select("pair_key", "direction", "session", "snapshots", _us("start_ts"), _us("end_ts"), F.round("duration_s", 6).alias("duration_s"), *r9("peak_edge", "median_edge", "median_depth_edge", "max_fill_size", "max_abs_skew_ms"))


_RANKED = "pair_key, direction, session, market, snapshots, recurrence, bucket, tier, through_ms, is_basis"


@query(f"WITH {EPS} SELECT {_RANKED}, round(score, 6) AS score FROM eps WHERE NOT is_basis")
def opportunity_ranking(spark, sf):
    return _ranked(spark, sf, basis=False).select(*_RANKED.split(", "), F.round("score", 6).alias("score"))


@query(f"WITH {EPS} SELECT pair_key, direction, session, bucket, round(score, 6) AS score FROM eps ORDER BY CASE bucket WHEN 'transient_candidate' THEN 0 WHEN 'unusable' THEN 1 ELSE 2 END, round(score, 6) DESC, pair_key, direction, session LIMIT 10")
def top_opportunities(spark, sf):
    e = _ranked(spark, sf).withColumn("score", F.round("score", 6))
    return e.orderBy(EP.bucket_rank(P.TRANSIENT, P.UNUSABLE, P.BASIS), F.desc("score"), "pair_key", "direction", "session").limit(10).select("pair_key", "direction", "session", "bucket", "score")


@query(f"""WITH {EPS}, near AS (SELECT *, {S.MARKET} AS market, coalesce(books_fresh, false) AS f, coalesce(books_fresh, false) AND abs(skew_ms) < 250 AS n FROM edges),
rej AS (SELECT market, bool_or(f) AS f, bool_or(n) AS n, round(max(CASE WHEN n THEN fee_adj_edge END), 9) AS fee, round(max(CASE WHEN n THEN depth_adj_edge END), 9) AS deep, max(CASE WHEN n THEN max_profitable_size END) AS size FROM near GROUP BY 1),
best2 AS (SELECT market, count(*) AS episodes, count(*) FILTER (WHERE bucket = 'transient_candidate') AS t, max(CASE WHEN bucket = 'transient_candidate' THEN score END) AS ts, max(score) AS s FROM eps GROUP BY 1)
SELECT p.market, CASE WHEN is_basis THEN 'basis_suspect' WHEN coalesce(t, 0) > 0 THEN 'transient_candidate' ELSE 'unusable' END AS bucket,
CASE WHEN is_basis THEN 'persistent basis' WHEN coalesce(t, 0) > 0 THEN 'transient' WHEN NOT f THEN 'stale book' WHEN NOT n THEN 'high skew' WHEN fee < 0 THEN 'negative after fees' WHEN coalesce(fee < 0.01, true) THEN 'edge below fee threshold'
WHEN coalesce(deep < 0.01, true) THEN 'negative after depth' WHEN coalesce(size < 1, true) THEN 'no depth' ELSE 'below thresholds' END AS reason,
round(in_edge_cycles / total_cycles::DOUBLE, 9) AS in_edge_frac, total_cycles, coalesce(episodes, 0) AS episode_count, round(coalesce(CASE WHEN coalesce(t, 0) > 0 THEN ts ELSE s END, 0.0), 6) AS score
FROM pers p JOIN rej USING (market) LEFT JOIN best2 USING (market)""")
def pair_classification(spark, sf):
    c = EP.classify(_judged(spark, sf), bridge.probes(spark, sf), GATE)
    return c.select("market", "bucket", "reason", F.round("in_edge_frac", 9).alias("in_edge_frac"), "total_cycles", "episode_count", F.round("score", 6).alias("score"))


_SWEEP = " UNION ALL ".join(f"SELECT {k} AS k, {f}::DOUBLE AS fee, market FROM rows WHERE books_fresh AND abs(skew_ms) < 250 AND round(fee_adj_edge + (0.02::DOUBLE - {f}::DOUBLE), 9) >= 0.01 AND round(depth_adj_edge + (0.02::DOUBLE - {f}::DOUBLE), 9) >= 0.01 AND max_profitable_size >= 1" for k, f in enumerate(P.FEE_LEVELS))
_LEVELS = ", ".join(f"({k}, {f}::DOUBLE)" for k, f in enumerate(P.FEE_LEVELS))


@query(f"""WITH {S.EDGES}, {S.PERSISTENCE}, rows AS (SELECT e.*, {S.MARKET} AS market FROM edges e WHERE {S.MARKET} NOT IN (SELECT market FROM pers WHERE is_basis)),
hit AS ({_SWEEP}), lev AS (SELECT v.k, v.fee, count(hit.market) AS candidate_rows, coalesce(list_sort(list(DISTINCT hit.market) FILTER (WHERE hit.market IS NOT NULL)), []) AS ms FROM (VALUES {_LEVELS}) v(k, fee) LEFT JOIN hit ON v.k = hit.k GROUP BY 1, 2)
SELECT fee, candidate_rows, array_to_string(ms, ',') AS markets, array_to_string(coalesce(list_filter(lag(ms) OVER (ORDER BY k), lambda x: NOT list_contains(ms, x)), []), ',') AS dropped FROM lev""")
def fee_sensitivity(spark, sf):
    return EP.fee_sweep(_judged(spark, sf)).select("fee", "candidate_rows", F.array_join("markets", ",").alias("markets"), F.array_join("dropped", ",").alias("dropped"))


@query(f"WITH {S.LADDERS} SELECT * FROM lad")
def survival_ladders(spark, sf):
    return _ladders(spark, sf)


@query(f"WITH {S.LADDERS} SELECT p.pair_key, p.direction, p.ladder, p.seq, l.through_ms, l.tier FROM probes p JOIN lad l ON p.pair_key = l.pair_key AND p.direction = l.direction AND p.ladder = l.ladder")
def survival_stamp(spark, sf):
    p = bridge.probes(spark, sf)
    part = Window.partitionBy("pair_key", "direction", "ladder")
    ok = F.min("survived").over(part.orderBy("benchmark_ms", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = p.withColumn("_ok", ok).withColumn("through_ms", F.max(F.when(F.col("_ok"), F.col("benchmark_ms"))).over(part))
    return rows.select("pair_key", "direction", "ladder", "seq", "through_ms", EP.tier(F.col("through_ms")).alias("tier"))


@query(f"WITH {S.LADDERS} SELECT pair_key, tier, count(*) AS n, max(through_ms) AS max_through FROM lad WHERE tier IS NOT NULL GROUP BY 1, 2")
def survival_summary(spark, sf):
    return _ladders(spark, sf).filter("tier IS NOT NULL").groupBy("pair_key", "tier").agg(F.count("*").alias("n"), F.max("through_ms").alias("max_through"))


@query(f"WITH {S.LADDERS} SELECT tier, count(*) FILTER (WHERE direction = 'a_yes_b_no') AS a_yes_b_no, count(*) FILTER (WHERE direction = 'a_no_b_yes') AS a_no_b_yes FROM lad GROUP BY 1")
def tier_distribution(spark, sf):
    return _ladders(spark, sf).groupBy("tier").pivot("direction", list(P.DIRECTIONS)).agg(F.count(F.lit(1))).fillna(0, list(P.DIRECTIONS))


@query(f"""WITH {EPS}, bk AS (SELECT market, CASE WHEN bool_or(is_basis) THEN 'basis_suspect' WHEN bool_or(bucket = 'transient_candidate') THEN 'transient_candidate' ELSE 'unusable' END AS bucket FROM eps GROUP BY 1)
SELECT coalesce(bucket, 'unusable') AS bucket, tier, count(*) AS n, count(*) FILTER (WHERE through_ms >= 250) AS ge_250, count(*) FILTER (WHERE through_ms >= 500) AS ge_500, count(*) FILTER (WHERE through_ms >= 1000) AS ge_1000
FROM lad LEFT JOIN bk ON {S.MARKET} = bk.market WHERE tier IS NOT NULL GROUP BY 1, 2""")
def survival_split(spark, sf):
    eps = _ranked(spark, sf)
    kinds = eps.groupBy("market").agg(F.when(F.bool_or("is_basis"), P.BASIS).when(F.bool_or(F.col("bucket") == P.TRANSIENT), P.TRANSIENT).otherwise(P.UNUSABLE).alias("bucket"))
    return R.survival_split(_ladders(spark, sf), kinds)


@query(f"""WITH {bridge.BOOKS_SQL}, iv AS (SELECT *, (epoch_us(capture_ts) - epoch_us(lag(capture_ts) OVER (PARTITION BY leg, market_id ORDER BY capture_ts, capture_seq))) / 1e6::DOUBLE AS i FROM books)
SELECT leg, market_id, count(*) AS rows, count(*) FILTER (WHERE status = 'fresh') AS fresh_rows, count(*) FILTER (WHERE status = 'stale') AS stale_rows, count(*) FILTER (WHERE best_bid IS NULL AND best_ask IS NULL) AS empty_rows,
count(*) FILTER (WHERE best_bid > best_ask) AS crossed_rows, count(i) AS intervals, count(*) FILTER (WHERE i > 7200) AS gap_intervals, round(median(i), 6) AS median_interval_s, max(staleness_s) AS max_staleness_s FROM iv GROUP BY 1, 2""")
def market_quality(spark, sf):
    return Q.markets(bridge.books(spark, sf), 3600.0).withColumn("median_interval_s", F.round("median_interval_s", 6))


@query(f"WITH {bridge.BOOKS_SQL} SELECT count(*) AS rows, count(capture_seq) - count(DISTINCT capture_seq) AS duplicate_seq, round(quantile_cont(fetch_ms, 0.5), 9) AS fetch_p50, round(quantile_cont(fetch_ms, 0.99), 9) AS fetch_p99 FROM books")
def run_quality(spark, sf):
    return Q.run_level(bridge.books(spark, sf)).select("rows", "duplicate_seq", *r9("fetch_p50", "fetch_p99"))


@query(f"""WITH {bridge.BOOKS_SQL}, iv AS (SELECT *, (epoch_us(capture_ts) - epoch_us(lag(capture_ts) OVER (PARTITION BY leg, market_id ORDER BY capture_ts, capture_seq))) / 1e6::DOUBLE AS i FROM books),
mk AS (SELECT leg, market_id, count(*) AS rows, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE best_bid > best_ask) AS crossed, count(i) AS n, count(*) FILTER (WHERE i > 7200) AS g FROM iv GROUP BY 1, 2),
w AS (SELECT min(rows) AS min_rows, max(g / nullif(n, 0)::DOUBLE) AS gap_rate, max(stale / rows::DOUBLE) AS stale_rate, sum(crossed)::BIGINT AS crossed, (SELECT count(capture_seq) - count(DISTINCT capture_seq) FROM books) AS duplicate_seq FROM mk)
SELECT min_rows, round(gap_rate, 9) AS gap_rate, round(stale_rate, 9) AS stale_rate, crossed, duplicate_seq, min_rows >= 1440 AND gap_rate < 0.05 AND duplicate_seq = 0 AND crossed = 0 AND bad_offsets = 0 AS health_ok, stale_rate < 0.1 AS freshness_ok, bad_offsets FROM w, (SELECT count(*) FILTER (abs(o) > 100) AS bad_offsets FROM (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(value) - 1000 END AS o FROM events GROUP BY user_id))""")
def quality_gates(spark, sf):
    b = bridge.books(spark, sf)
    runs = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg((F.max("value") - 1000).alias("o")).select(F.when(F.col("user_id") % 3 != 0, F.col("o")).alias("ntp_offset_ms"))
    return Q.thresholds(Q.markets(b, 3600.0), Q.run_level(b), runs).select("min_rows", *r9("gap_rate", "stale_rate"), "crossed", "duplicate_seq", "health_ok", "freshness_ok", "bad_offsets")


@query(f"WITH {bridge.BOOKS_SQL} SELECT leg, count(*) AS rows, round(avg((status = 'fresh')::INT), 9) AS fresh_rate, round(avg((status = 'stale')::INT), 9) AS stale_rate FROM books GROUP BY 1")
def freshness_by_leg(spark, sf):
    return Q.by_leg(bridge.books(spark, sf)).select("leg", "rows", *r9("fresh_rate", "stale_rate"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 95 / 100.0)::BIGINT) + 1] AS p95_floor, list_sort(list(value))[least(count(*) - 1, round_even((count(*) - 1) * 0.9, 0)::BIGINT) + 1] AS p90_round, round(quantile_cont(value, 0.95), 9) AS p95_linear, round(median(value), 9) AS p50 FROM events GROUP BY 1")
def percentile_conventions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value")
    out = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.95), 9).alias("p95_linear"), F.round(F.median("value"), 9).alias("p50"))
    floor = Q.ranked_value(e, ["event_type"], "value", F.least(F.col("_n") - 1, F.floor(F.col("_n") * 95 / 100)), "p95_floor")
    half = Q.ranked_value(e, ["event_type"], "value", F.least(F.col("_n") - 1, F.bround((F.col("_n") - 1) * 0.9, 0).cast("long")), "p90_round")
    return out.join(floor, "event_type").join(half, "event_type")


@query(f"WITH {bridge.BOOKS_SQL} SELECT leg, CAST(hour(capture_ts) AS INT) AS hour, round(median(fetch_ms), 9) AS median_ms, count(*) AS n FROM books GROUP BY 1, 2")
def latency_heatmap(spark, sf):
    return R.latency_heat(bridge.books(spark, sf)).withColumn("median_ms", F.round("median_ms", 9))


@query(f"WITH {S.EDGES} SELECT pair_key, CAST(hour(capture_ts) AS INT) AS hour, round(100 * avg((round(fee_adj_edge, 9) > 0)::INT), 9) AS positive_pct, count(*) AS n FROM edges WHERE include GROUP BY 1, 2")
def edge_heatmap(spark, sf):
    return R.edge_heat(_edges(spark, sf).filter("include")).withColumn("positive_pct", F.round("positive_pct", 9))


@query(f"WITH {bridge.PROBES_SQL} SELECT pair_key, benchmark_ms, round(100 * avg(survived::INT), 9) AS survived_pct, count(*) AS n FROM probes GROUP BY 1, 2")
def survival_heatmap(spark, sf):
    return R.survival_heat(bridge.probes(spark, sf)).withColumn("survived_pct", F.round("survived_pct", 9))


@query(f"WITH {bridge.BOOKS_SQL} SELECT leg, " + ", ".join(f"round(median(fetch_ms) FILTER (WHERE hour(capture_ts) = {h}), 9) AS h{h}" for h in range(24)) + " FROM books GROUP BY 1")
def latency_matrix(spark, sf):
    cells = R.latency_heat(bridge.books(spark, sf)).select("leg", F.concat(F.lit("h"), "hour").alias("h"), F.round("median_ms", 9).alias("v"))
    return R.pivoted(cells, "leg", "h", "v", [f"h{h}" for h in range(24)])


_DEPTH = " + ".join(f"{s}_sz_{i}" for s in ("bid", "ask") for i in range(1, bridge.LEVELS + 1))


@query(f"WITH {bridge.BOOKS_SQL}, d AS (SELECT leg, CAST(hour(capture_ts) AS INT) AS hour, {_DEPTH} AS depth, round(best_ask - best_bid, 9) AS spread FROM books) SELECT leg, hour, count(*) AS n, round(median(depth), 9) AS median_depth, round(median(spread), 9) AS spread_p50 FROM d GROUP BY GROUPING SETS ((leg), (leg, hour))")
def liquidity_profile(spark, sf):
    return R.liquidity(bridge.books(spark, sf)).select("leg", "hour", "n", *r9("median_depth", "spread_p50"))


@query(f"WITH {S.EDGES} SELECT direction, count(*) AS n, " + ", ".join(f"round(100 * avg((max_profitable_size >= {k})::INT), 9) AS pct_{k}" for k in (1, 100, 1000, 5000)) + ", round(median(max_profitable_size), 9) AS median_size, max(max_profitable_size) AS max_size FROM edges GROUP BY 1")
def depth_curve(spark, sf):
    return R.depth_curve(_edges(spark, sf)).select("direction", "n", *r9("pct_1", "pct_100", "pct_1000", "pct_5000", "median_size"), "max_size")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k % CAST(ceil(n / 500.0) AS BIGINT) = 0")
def series_downsample(spark, sf):
    return R.thinned(spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", "value", "ts"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "value")


@query(f"""WITH {EPS}, g AS (SELECT *, (epoch_us(start_ts) - epoch_us(lag(start_ts) OVER (PARTITION BY market, direction ORDER BY start_ts))) / 6e7::DOUBLE AS gap FROM eps),
hrs AS (SELECT market, direction, hour(start_ts) AS h, count(*) AS n FROM eps GROUP BY 1, 2, 3), top AS (SELECT market, direction, string_agg(h::VARCHAR, ',' ORDER BY rn) AS top_hours FROM (SELECT *, row_number() OVER (PARTITION BY market, direction ORDER BY n DESC, h) AS rn FROM hrs) WHERE rn <= 4 GROUP BY 1, 2)
SELECT g.market, g.direction, count(*) AS episodes, round(median(gap), 6) AS median_gap_min, round(max(median_depth_edge), 9) AS peak_depth_edge, max(through_ms) AS through_ms, any_value(top_hours) AS top_hours FROM g JOIN top ON g.market = top.market AND g.direction = top.direction GROUP BY 1, 2""")
def recurrence_timing(spark, sf):
    out = R.recurrence(_ranked(spark, sf))
    return out.select("market", "direction", "episodes", F.round("median_gap_min", 6).alias("median_gap_min"), F.round("peak_depth_edge", 9).alias("peak_depth_edge"), "through_ms", "top_hours")


_DAYS = 30.0
_EV = f"""{EPS}, grid AS (SELECT pair_key, length(a_market)::DOUBLE AS ttr, d.direction FROM pairs, (VALUES ('a_yes_b_no'), ('a_no_b_yes')) d(direction)),
ag AS (SELECT pair_key, direction, count(*) AS n, median(median_depth_edge) AS edge, median(max_fill_size) AS size, max(through_ms) AS through_ms FROM eps WHERE NOT is_basis AND snapshots >= 2 AND max_abs_skew_ms <= 250 GROUP BY 1, 2),
v0 AS (SELECT g.pair_key, g.direction, g.ttr, n, CASE WHEN n IS NULL THEN 0.0 ELSE edge + 0.02::DOUBLE END AS gross, CASE WHEN n IS NULL THEN 0.0 ELSE 0.02::DOUBLE END AS fees, CASE WHEN n IS NULL THEN 0.0 ELSE 0.5 * size END AS fill_size,
CASE WHEN n IS NULL THEN 0.0 ELSE CASE WHEN through_ms IS NULL THEN 0.25 WHEN through_ms >= 1000 THEN 0.8 WHEN through_ms >= 500 THEN 0.5 WHEN through_ms >= 250 THEN 0.25 WHEN through_ms >= 100 THEN 0.05 ELSE 0.0 END END AS fill_p,
CASE WHEN n IS NULL THEN 0.0 ELSE 0.1::DOUBLE * 0.02::DOUBLE END AS failed_leg, coalesce(n / {_DAYS}::DOUBLE, 0.0) AS per_day FROM grid g LEFT JOIN ag ON g.pair_key = ag.pair_key AND g.direction = ag.direction),
v1 AS (SELECT *, CASE WHEN n IS NULL THEN 0.0 ELSE greatest(1.0 - gross, 0.0) * 0.05::DOUBLE * ttr / 365.0::DOUBLE END AS carry FROM v0),
v2 AS (SELECT *, (fill_p * (gross - fees - carry) - failed_leg) * fill_size AS ev FROM v1),
v AS (SELECT *, ev * per_day AS ev_per_day, CASE WHEN ev * per_day >= 5 AND per_day * 7 >= 5 THEN 'viable' WHEN ev * per_day > 0 THEN 'marginal' ELSE 'not_viable' END AS verdict FROM v2)"""


def _values(spark, sf):
    grid = bridge.pairs(spark, sf).select("pair_key", F.length("a_market").cast("double").alias("days_to_resolution"))
    return V.pair_value(_ranked(spark, sf), grid, _DAYS)


@query(f"WITH {_EV} SELECT pair_key, direction, coalesce(n, 0) AS episodes, verdict, {_r9('gross', 'fees', 'fill_p', 'fill_size', 'carry', 'failed_leg', 'ev', 'per_day', 'ev_per_day')} FROM v")
def pair_expected_value(spark, sf):
    return _values(spark, sf).select("pair_key", "direction", "episodes", "verdict", *r9("gross", "fees", "fill_p", "fill_size", "carry", "failed_leg", "ev", "per_day", "ev_per_day"))


@query(f"WITH {_EV} SELECT CASE WHEN count(*) = 0 THEN 'insufficient_data' WHEN bool_or(verdict = 'viable') THEN 'viable' WHEN count(DISTINCT CASE WHEN verdict <> 'not_viable' THEN pair_key END) >= 2 THEN 'marginal' ELSE 'not_viable' END AS verdict, count(*) AS rows, round(sum(ev_per_day), 6) AS ev_per_day FROM v")
def overall_verdict(spark, sf):
    return V.overall(_values(spark, sf)).withColumn("ev_per_day", F.round("ev_per_day", 6))


@query(f"WITH {EPS}, {', '.join(['s AS (SELECT count(*) AS episodes, round(sum(score), 6) AS score_sum, count(*) FILTER (WHERE bucket = ' + repr('transient_candidate') + ') AS transient FROM eps)', 'l AS (SELECT round(median(abs(skew_ms)), 6) AS p50_latency_ms, count(*) AS edge_rows FROM edges)'])} SELECT * FROM s, l")
def analysis_summary(spark, sf):
    eps = _ranked(spark, sf).agg(F.count("*").alias("episodes"), F.round(F.sum("score"), 6).alias("score_sum"), F.count_if(F.col("bucket") == P.TRANSIENT).alias("transient"))
    lat = _edges(spark, sf).agg(F.round(F.median(F.abs("skew_ms")), 6).alias("p50_latency_ms"), F.count("*").alias("edge_rows"))
    return eps.crossJoin(F.broadcast(lat))  # one row each


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 700 ELSE 350 END AS m, round(0.01 + (l_partkey % 98) / 100.0, 2)::DECIMAL(4,2) AS p, CAST(l_quantity AS BIGINT) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, n, CAST(ceil(m * n * p * (1 - p) / 100) AS BIGINT) AS cents FROM t""")
def order_fee_exact(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", 700).otherwise(350).alias("m"), F.round(0.01 + (F.col("l_partkey") % 98) / 100.0, 2).alias("p"), F.col("l_quantity").cast("long").alias("n"))
    return t.select("l_orderkey", "l_linenumber", "n", fees.order_cents(F.col("m"), F.col("p"), F.col("n")).alias("cents"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN -1 ELSE p_size * 10 END AS bps, p_retailprice / 10000.0 AS p, p_size::DOUBLE AS s FROM part)
SELECT p_partkey, round(s * (CASE WHEN bps >= 0 THEN bps ELSE 1000 END / 10000.0) * least(p, 1.0 - p), 9) AS fee FROM r""")
def rate_fee_fallback(spark, sf):
    r = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size") * 10).alias("bps"), (F.col("p_retailprice") / 10000.0).alias("p"), F.col("p_size").cast("double").alias("s"))
    return r.select("p_partkey", F.round(fees.rate_fee(F.col("bps"), F.col("p"), F.col("s")), 9).alias("fee"))


@query(f"""WITH {S.EDGES}, t AS (SELECT pair_key, direction, a_seq, raw_edge, length({S.MARKET}) * 100 AS bps, CASE WHEN direction = 'a_yes_b_no' THEN l.best_ask ELSE 1.0::DOUBLE - l.best_bid END AS pa, CASE WHEN direction = 'a_yes_b_no' THEN 1.0::DOUBLE - r.best_bid ELSE r.best_ask END AS pb
FROM edges e JOIN matched m ON e.a_seq = m.k), c AS (SELECT *, greatest(0.01, least(0.99, pa)) AS qa, greatest(0.01, least(0.99, pb)) AS qb FROM t)
SELECT pair_key, direction, a_seq, round(raw_edge - ceil(round(7 * round(qa, 4)::DECIMAL(6,4) * (1 - round(qa, 4)::DECIMAL(6,4)), 6)) / 100.0::DOUBLE - bps / 10000.0::DOUBLE * least(qb, 1.0::DOUBLE - qb), 9) AS real_fee_edge FROM c""")
def real_fee_edge(spark, sf):
    m = E.matches(bridge.books(spark, sf), bridge.pairs(spark, sf))
    rows = []
    for d, pa, pb, raw in (("a_yes_b_no", F.col("l.best_ask"), 1.0 - F.col("r.best_bid"), F.col("r.best_bid") - F.col("l.best_ask")), ("a_no_b_yes", 1.0 - F.col("l.best_bid"), F.col("r.best_ask"), F.col("l.best_bid") - F.col("r.best_ask"))):
        rows.append(F.struct(F.lit(d).alias("direction"), F.round(pa, 4).alias("pa"), pb.alias("pb"), raw.alias("raw")))
    out = m.select("l.pair_key", F.col("l.capture_seq").alias("a_seq"), F.explode(F.array(*rows)).alias("d"))
    bps = F.length(EP.market(F.col("pair_key"))) * 100
    fee = fees.round_trip(F.lit(fees.TAKER_E4), bps, F.col("d.pa"), F.col("d.pb"), F.lit(1.0))
    return out.select("pair_key", "d.direction", "a_seq", F.round(F.col("d.raw") - fee, 9).alias("real_fee_edge"))


@query(f"WITH {S.EDGES}, h AS (SELECT *, {S.GATE} AS hit FROM edges), x AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY pair_key, direction ORDER BY recv_ns, a_seq ROWS UNBOUNDED PRECEDING) AS z FROM h) SELECT pair_key, direction, a_seq, CAST(sum(hit::INT) OVER (PARTITION BY pair_key, direction, z ORDER BY recv_ns, a_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM x")
def in_edge_runs(spark, sf):
    return R.in_edge_runs(_edges(spark, sf), E.qualifies(), ["pair_key", "direction"], ["recv_ns", "a_seq"]).select("pair_key", "direction", "a_seq", "run")


@query(f"WITH {S.EDGES}, b1 AS (SELECT pair_key, max(fee_adj_edge) AS edge FROM edges WHERE {S.GATE} GROUP BY 1) SELECT pair_key, round(edge, 9) AS edge FROM b1 ORDER BY round(edge, 9) DESC, pair_key LIMIT 3")
def probe_targets(spark, sf):
    best = _edges(spark, sf).filter(E.qualifies()).groupBy("pair_key").agg(F.round(F.max("fee_adj_edge"), 9).alias("edge"))
    return best.orderBy(F.desc("edge"), "pair_key").limit(3)


@query(f"WITH {S.EDGES} SELECT pair_key, count(*) AS n FROM edges WHERE {S.GATE} OR round(fee_adj_edge, 9) > 0.02 GROUP BY 1")
def scan_statistics(spark, sf):
    return _edges(spark, sf).filter(E.qualifies() | (F.round("fee_adj_edge", 9) > 0.02)).groupBy("pair_key").agg(F.count("*").alias("n"))


@query(f"WITH {bridge.BOOKS_SQL} SELECT market_id, capture_seq, recv_ns FROM books WHERE (market_id, capture_seq) > ('click', 500) ORDER BY market_id, capture_seq LIMIT 200")
def cursor_page(spark, sf):
    return R.page(bridge.books(spark, sf), ["market_id", "capture_seq"], ("click", 500), 200).select("market_id", "capture_seq", "recv_ns")


@query(f"WITH {bridge.BOOKS_SQL}, z AS (SELECT leg, market_id, capture_seq, CASE WHEN capture_seq % 3 = 0 THEN best_ask ELSE best_bid END AS b, CASE WHEN capture_seq % 3 = 0 THEN best_bid ELSE best_ask END AS a FROM books) SELECT leg, market_id, capture_seq, round(least(a, b), 9) AS best_bid, round(greatest(a, b), 9) AS best_ask, round(greatest(a, b) - least(a, b), 9) AS spread FROM z")
def legacy_swap(spark, sf):
    b = bridge.books(spark, sf)
    third = F.col("capture_seq") % 3 == 0
    names = [("best_bid", "best_ask"), *((f"bid_{f}_{i}", f"ask_{f}_{i}") for f in ("px", "sz") for i in range(1, bridge.LEVELS + 1))]
    swapped = b.withColumns({x: F.when(third, F.col(y)).otherwise(F.col(x)) for p, q in names for x, y in ((p, q), (q, p))})
    return B.unswapped(swapped).select("leg", "market_id", "capture_seq", *r9("best_bid", "best_ask", "spread"))


@query(f"WITH {bridge.BOOKS_SQL} SELECT market_id || ':' || leg AS market_key, capture_seq, status AS freshness, array_to_string(list_filter([CASE WHEN best_bid > best_ask THEN 'crossed_book' END, CASE WHEN status <> 'fresh' THEN status END], lambda x: x IS NOT NULL), ',') AS dq_flags FROM books")
def book_view(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("best_bid") > F.col("best_ask"), "crossed_book"), F.when(F.col("status") != "fresh", F.col("status"))))
    return bridge.books(spark, sf).select(F.concat("market_id", F.lit(":"), "leg").alias("market_key"), "capture_seq", F.col("status").alias("freshness"), F.array_join(flags, ",").alias("dq_flags"))


@query(f"WITH {S.EDGES} SELECT pair_key, direction, a_seq, round(abs(skew_ms), 9) AS latency_ms, CASE WHEN a_status = 'stale' OR b_status = 'stale' THEN 'stale' ELSE 'fresh' END AS freshness, round(fee_adj_edge, 9) AS est_profit, coalesce(include, false) AS include FROM edges")
def edge_view(spark, sf):
    return _edges(spark, sf).select("pair_key", "direction", "a_seq", F.round(F.abs(F.coalesce("skew_ms", F.lit(0.0))), 9).alias("latency_ms"), B.worst(F.col("a_status"), F.col("b_status")).alias("freshness"), F.round("fee_adj_edge", 9).alias("est_profit"), F.coalesce("include", F.lit(False)).alias("include"))


@query(f"WITH {bridge.BOOKS_SQL} SELECT leg, market_id, capture_seq % 1000 AS seq, min(recv_ns) AS recv_ns FROM books GROUP BY 1, 2, 3")
def compaction_dedupe(spark, sf):
    b = bridge.books(spark, sf).withColumn("seq", F.col("capture_seq") % 1000)
    return B.latest_rows(b.select("leg", "market_id", "seq", "recv_ns"), ["leg", "market_id", "seq"], "recv_ns")


@query("SELECT event_type, user_id AS price, CAST(max_by(floor(value)::BIGINT % 4, event_id) AS DOUBLE) AS size FROM events GROUP BY 1, 2 HAVING max_by(floor(value)::BIGINT % 4, event_id) > 0")
def book_last_write(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("user_id").alias("price"), (F.floor("value") % 4).cast("double").alias("size"), "event_id")
    return B.last_written(e, ["event_type"], "price", "size", "event_id")


@query("""WITH d AS (SELECT event_type, user_id % 50 AS price, event_id, (floor(value)::BIGINT % 7 - 3)::DOUBLE AS delta FROM events), r AS (SELECT *, sum(delta) OVER (PARTITION BY event_type, price ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM d)
SELECT event_type, price, max_by(s, event_id) - least(0.0, min(s)) AS size FROM r GROUP BY 1, 2 HAVING max_by(s, event_id) - least(0.0, min(s)) > 0""")
def book_delta_sum(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", (F.col("user_id") % 50).alias("price"), "event_id", (F.floor("value") % 7 - 3).cast("double").alias("delta"))
    return B.summed(e, ["event_type"], "price", "delta", "event_id")


@query("WITH s AS (SELECT event_type, event_id, coalesce(event_id <> lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) + 1, false) AS gap FROM events) SELECT event_type, event_id, gap, CAST(sum(gap::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS epoch FROM s")
def sequence_gaps(spark, sf):
    return B.gaps(spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id"), ["event_type"], "event_id")


@query("SELECT * FROM (SELECT event_type, event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) / 1e6::DOUBLE, 6) AS gap_s FROM events) WHERE gap_s > 5400")
def late_cycles(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return Q.late_cycles(e, ["event_type"], "ts", 3600.0).select("event_type", "event_id", F.round("gap_s", 6).alias("gap_s"))
