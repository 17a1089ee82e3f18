"""Queries of review, status and scanner steps, each with its SQL. Raw rows are written once, for Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fees
from tidemark.operators import review as V
from tidemark.operators import scanner as N
from tidemark.operators import status as U
from tidemark.plans.registry import query


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cols(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


_P = {
    "pair_key": "CASE WHEN o_orderkey % 71 = 0 THEN 'P0' ELSE concat('P', CAST(o_orderkey AS STRING)) END",
    "a_market": "CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE concat('A', CAST(o_custkey AS STRING)) END",
    "b_market": "CASE WHEN o_orderkey % 31 = 0 THEN CAST(NULL AS STRING) ELSE concat('B', CAST(o_orderkey AS STRING)) END",
    "b_condition": "concat('C', CAST(o_orderkey AS STRING))",
    "a_question": "CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'Is it so?' END",
    "b_question": "'Is it so?'",
    "a_close_time": "'2026-01-01'",
    "b_close_time": "CASE WHEN o_orderkey % 19 = 0 THEN CAST(NULL AS STRING) ELSE '2026-01-02' END",
    "orientation": "CASE WHEN o_orderkey % 13 = 0 THEN 'sideways' WHEN o_orderkey % 2 = 0 THEN 'same' ELSE 'inverted' END",
    "status": "CASE WHEN o_orderstatus = 'P' THEN 'candidate' ELSE 'approved_for_paper' END",
    "auto_approved": "CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS BOOLEAN) ELSE o_orderkey % 11 = 0 END",
    "confidence": "CASE WHEN o_orderkey % 7 = 0 THEN 'high' ELSE CAST(o_orderkey % 130 AS STRING) END",
    "human_approved": "o_orderkey % 37 <> 0",
    "contract_equivalent": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS BOOLEAN) ELSE o_orderkey % 9 <> 0 END",
    "scope": "CASE WHEN o_orderkey % 3 = 0 THEN 'connectivity_only' ELSE 'paper_scan' END",
    "include": "o_orderkey % 4 = 0",
    "reviewer": "CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'someone' END",
    "reviewer_notes": "concat(o_orderpriority, ' seen and read')",
    "approved_at": "CASE WHEN o_orderkey % 43 = 0 THEN 'never' ELSE '2026-01-01T00:00:00Z' END",
    "equivalence": "CASE WHEN o_orderkey % 6 = 0 THEN 'unreviewed' WHEN o_orderkey % 6 = 1 THEN 'tail_divergence_documented' ELSE 'verified_equivalent' END",
    "display_name": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('Name ', o_orderpriority) END",
}
_PAIRS = f"p AS (SELECT o_orderkey, {', '.join(_cols(_P))} FROM orders)"


def _pairs(spark, sf) -> DataFrame:
    return _read(spark, sf, "orders").selectExpr("o_orderkey", *_cols(_P))


def _union(checks: list[tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT pair_key, '{name}' AS violation FROM p WHERE {when}" for when, name in checks)
    return f"WITH {_PAIRS} {rows} UNION ALL SELECT pair_key, 'duplicate_pair_key' FROM p WHERE pair_key IN (SELECT pair_key FROM p GROUP BY 1 HAVING count(*) > 1)"


_OTHER = "coalesce(NOT contract_equivalent, false)"


@query(_union([
    ("trim(a_market) = ''", "missing_a_market"), ("b_market IS NULL", "missing_b_market"), ("orientation = 'sideways'", "orientation"), ("status <> 'approved_for_paper'", "status"), ("NOT human_approved", "not_human_approved"),
    (f"{_OTHER} AND scope <> 'connectivity_only'", "scope_of_other_contracts"), (f"{_OTHER} AND include", "other_contracts_in_metrics"), ("reviewer = ''", "missing_reviewer"), ("length(trim(reviewer_notes)) < 20", "short_notes"), ("approved_at = 'never'", "approved_at"),
]))
def registry_violations(spark, sf):
    return V.registry_violations(_pairs(spark, sf))


@query(_union([
    ("trim(a_market) = ''", "missing_a_market"), ("b_market IS NULL", "missing_b_market"), ("a_question = ''", "missing_a_question"), ("b_close_time IS NULL", "missing_b_close_time"), ("orientation = 'sideways'", "orientation"), ("status <> 'candidate'", "status"),
    ("coalesce(auto_approved, true)", "auto_approved"), ("confidence = 'high'", "confidence_not_numeric"), ("TRY_CAST(confidence AS DOUBLE) > 1", "confidence_out_of_range"),
]))
def candidate_violations(spark, sf):
    return V.candidate_violations(_pairs(spark, sf))


@query(f"WITH {_PAIRS} SELECT o_orderkey, CASE WHEN equivalence = 'unreviewed' THEN 'equivalence_not_verified' WHEN {_OTHER} THEN 'contracts_not_equivalent' WHEN scope = 'connectivity_only' THEN 'connectivity_only' END AS reason FROM p")
def approval_blocks(spark, sf):
    return _pairs(spark, sf).select("o_orderkey", V.block_reason().alias("reason"))


@query(f"WITH {_PAIRS} SELECT pair_key, o_orderkey FROM p WHERE status = 'approved_for_paper' AND pair_key LIKE '%77%'")
def scannable_pairs(spark, sf):
    return V.naming(V.scannable(_pairs(spark, sf)), "77").select("pair_key", "o_orderkey")


@query(f"WITH {_PAIRS}, n AS (SELECT pair_key, o_orderkey, lower(coalesce(nullif(display_name, ''), pair_key)) AS name_key FROM p WHERE o_orderkey % 71 <> 0) SELECT * FROM n WHERE name_key > 'name 3-medium' OR (name_key = 'name 3-medium' AND pair_key > 'P5') ORDER BY name_key, pair_key LIMIT 100")
def pair_listing(spark, sf):
    return V.listing(_pairs(spark, sf).filter("o_orderkey % 71 <> 0"), ("name 3-medium", "P5"), 500).select("pair_key", "o_orderkey", "name_key")


@query(f"""WITH {_PAIRS}, h AS (SELECT *, CASE WHEN status = 'candidate' THEN 1 ELSE 0 END AS k FROM p WHERE pair_key = 'C100' OR a_market = 'C100' OR b_condition = 'C100')
SELECT pair_key, b_condition, CASE WHEN k = 0 THEN 'approved' ELSE 'candidate' END AS source FROM h ORDER BY k, pair_key LIMIT 1""")
def pair_lookup(spark, sf):
    p = _pairs(spark, sf)
    return V.found([("approved", p.filter("status <> 'candidate'")), ("candidate", p.filter("status = 'candidate'"))], "C100").select("pair_key", "b_condition", "source")


@query(f"""WITH {_PAIRS}, m AS (SELECT concat('A', CAST(c_custkey AS STRING)) AS market_id, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT concat('B', CAST(o_orderkey AS STRING)) AS market_id, o_totalprice FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, m.c_mktsegment AS a_segment, n.o_totalprice AS b_price FROM p LEFT JOIN m ON p.a_market = m.market_id LEFT JOIN n ON p.b_market = n.market_id""")
def review_context(spark, sf):
    a = _read(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("market_id"), "c_mktsegment")
    b = _read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("market_id"), "o_totalprice")
    return V.context(_pairs(spark, sf), a, b).select("o_orderkey", F.col("a_record.c_mktsegment").alias("a_segment"), F.col("b_record.o_totalprice").alias("b_price"))


_Q = {
    "question": "CASE WHEN p_partkey % 7 = 0 THEN concat('Will ', p_name, ' be the Democratic Presidential nominee in 2028?') WHEN p_partkey % 7 = 1 THEN concat('Will ', p_name, ' win the 2026 FIFA World Cup?') WHEN p_partkey % 7 = 2 THEN concat('Will ', p_name, '  win the F1 Drivers Championship?') WHEN p_partkey % 7 < 5 THEN concat(' Is  it ', p_name, '? ') ELSE '' END",
    "ticker": "CASE WHEN p_size % 4 = 0 THEN concat('KXWCCONTINENT-26-', CASE WHEN p_size % 8 = 0 THEN 'EUR' ELSE 'XX' END) WHEN p_size % 4 = 1 THEN concat('KXF1-2027-', p_brand) WHEN p_size % 4 = 2 THEN concat('KXPRESNOMD-28-', p_brand) ELSE concat('T', CAST(p_partkey AS STRING)) END",
    "existing": "CASE WHEN p_partkey % 11 = 0 THEN ' By hand ' ELSE '' END",
}


@query(f"""WITH q AS (SELECT p_partkey, p_name, p_brand, p_size, {", ".join(_cols(_Q))} FROM part)
SELECT p_partkey, CASE WHEN existing <> '' THEN 'By hand' WHEN p_partkey % 7 = 0 THEN '2028 Democratic nominee - ' || p_name WHEN p_partkey % 7 = 1 THEN 'World Cup 2026 - ' || p_name || ' wins' WHEN p_partkey % 7 = 2 THEN 'F1 Drivers Championship - ' || p_name
 WHEN p_partkey % 7 < 5 THEN 'Is it ' || p_name WHEN p_size % 8 = 0 THEN 'World Cup 2026 - Europe (UEFA) wins' WHEN p_size % 4 = 0 THEN 'World Cup 2026 - XX wins' WHEN p_size % 4 = 1 THEN 'F1 2027 Drivers Championship - ' || p_brand WHEN p_size % 4 = 2 THEN '2028 Democratic nominee - ' || p_brand ELSE 'K' || p_partkey END AS label FROM q""")
def display_names(spark, sf):
    q = _read(spark, sf, "part").selectExpr("p_partkey", *_cols(_Q))
    return q.select("p_partkey", V.display_name(F.col("existing"), F.col("question"), F.col("ticker"), F.concat(F.lit("K"), F.col("p_partkey").cast("string"))).alias("label"))


_SUBJECTIVE, _GROUPING, _DATED = ("discretion", "deems"), ("any of", "group"), ("before", "by the end")
_TEXT = "CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 7 = 1 THEN 'At its Discretion' WHEN o_orderkey % 7 = 2 THEN 'any of these before May' WHEN o_orderkey % 7 = 3 THEN 'Before May' ELSE 'It happens' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_TEXT} AS t, epoch_us(o_orderdate) AS a, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE epoch_us(o_orderdate) + (o_custkey % 4 - 1) * 3600000000 END AS b FROM orders),
c AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'needs_human' WHEN o_orderkey % 7 = 1 THEN 'subjective' WHEN o_orderkey % 7 = 2 THEN 'categorical_grouping' WHEN o_orderkey % 7 = 3 THEN 'date_cutoff' ELSE 'objective_single_event' END AS structure FROM s)
SELECT o_orderkey, structure, concat_ws(',', CASE WHEN structure = 'subjective' THEN 'subjective' WHEN structure = 'needs_human' THEN 'no_rules' END, CASE WHEN b IS NULL THEN 'cutoff_unknown' WHEN abs(a - b) > 3600000000 THEN 'cutoff_differs' END,
 CASE WHEN a - epoch_us(TIMESTAMP '1997-01-01 00:00:00') > 90 * 86400000000 THEN 'long_dated' END, CASE WHEN o_orderkey % 3 = 0 THEN 'snapshot: thin' END) AS flags FROM c""")
def prescreen_flags(spark, sf):
    o = _read(spark, sf, "orders")
    b = F.when(F.col("o_custkey") % 5 != 0, F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_custkey") % 4 - 1) * F.lit(3_600_000_000)))
    rows = o.select("o_orderkey", F.expr(_TEXT).alias("t"), F.col("o_orderdate").cast("timestamp").alias("a_close_time"), b.alias("b_close_time"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("thin"))).alias("warnings"))
    rows = rows.withColumn("structure", V.structure(F.col("t"), _SUBJECTIVE, _GROUPING, _DATED))
    return V.prescreened(rows, F.lit("1997-01-01 00:00:00").cast("timestamp")).select("o_orderkey", "structure", F.array_join("flags", ",").alias("flags"))


_ANSWER = "concat('Text ', CASE WHEN o_orderkey % 8 = 0 THEN 'no block' ELSE concat('```json {\"status\": \"old\"} ``` then ```json {\"status\": \"', CASE WHEN o_orderkey % 8 = 1 THEN 'fine' ELSE 'basis' END, '\", ', CASE WHEN o_orderkey % 8 = 2 THEN '' ELSE '\"tail_risks\": [\"x\"], ' END, '\"confidence\": ', CASE WHEN o_orderkey % 8 = 3 THEN '7' ELSE '0.5' END, ', \"grouping_check\": \"', CASE WHEN o_orderkey % 8 = 4 THEN ' ' ELSE 'ok' END, '\", \"date_check\": \"ok\"} ``` end') END)"


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'no_block' WHEN 1 THEN 'status' WHEN 2 THEN 'tail_risks' WHEN 3 THEN 'confidence' WHEN 4 THEN 'checks' END AS problem, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'fine' ELSE 'basis' END AS status FROM orders")
def audit_verdicts(spark, sf):
    return V.verdict(_read(spark, sf, "orders").selectExpr("o_orderkey", f"{_ANSWER} AS t"), "t").select("o_orderkey", "problem", F.col("verdict.status").alias("status"))


@query("""WITH p AS (SELECT l_partkey AS pair_key, strftime(l_shipdate, '%Y%m%d') AS folder, 'root' || l_suppkey || '/' || strftime(l_shipdate, '%Y%m%d') AS path FROM lineitem), m AS (SELECT pair_key, max(folder) AS folder FROM p GROUP BY 1)
SELECT pair_key, max(path) AS path FROM p JOIN m USING (pair_key, folder) GROUP BY 1""")
def latest_evidence(spark, sf):
    day = F.date_format("l_shipdate", "yyyyMMdd")
    return V.latest_pack(_read(spark, sf, "lineitem").select(F.col("l_partkey").alias("pair_key"), day.alias("folder"), F.concat(F.lit("root"), F.col("l_suppkey").cast("string"), F.lit("/"), day).alias("path")))


@query("SELECT pair_key, CAST(sum(n) AS BIGINT) AS episode_count, string_agg(b || ':' || n, ',' ORDER BY b) AS buckets FROM (SELECT l_partkey AS pair_key, CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE l_returnflag END AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def evidence_buckets(spark, sf):
    e = V.bucket_counts(_read(spark, sf, "lineitem").select(F.col("l_partkey").alias("pair_key"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("bucket")))
    return e.select("pair_key", "episode_count", F.array_join(F.transform("buckets", lambda x: F.concat_ws(":", x["bucket"], x["n"].cast("string"))), ",").alias("buckets"))


# Status: events by user stand for recordings.


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS book, count(*) FILTER (event_type = 'view') AS opportunities, count(*) FILTER (event_type NOT IN ('click', 'view')) AS edges FROM events GROUP BY 1")
def recording_counts(spark, sf):
    e = _read(spark, sf, "events")
    return U.row_counts({"book": e.filter("event_type = 'click'"), "opportunities": e.filter("event_type = 'view'"), "edges": e.filter("event_type NOT IN ('click', 'view')")}, "user_id")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS pair_keys, count(DISTINCT event_type) AS pair_count FROM events GROUP BY 1")
def recording_pairs(spark, sf):
    e = _read(spark, sf, "events").select("user_id", F.col("event_type").alias("pair_key"), "event_id")
    early = F.col("event_id") < 1000
    return U.pair_keys([e.filter(early), e.filter(~early)], "user_id").select("user_id", F.array_join("pair_keys", ",").alias("pair_keys"), "pair_count")


@query("SELECT c_custkey AS id, c_acctbal AS edge, CAST(NULL AS VARCHAR) AS tier FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'T' || s_nationkey FROM supplier")
def united_sources(spark, sf):
    a = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("edge"))
    b = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("edge"), F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("tier"))
    return U.united([a, b])


@query("SELECT nation, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1")
def added_counters(spark, sf):
    count = lambda t, c: _read(spark, sf, t).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n"))
    return U.counters_added([count("customer", "c_nationkey"), count("supplier", "s_nationkey")], ["nation"], "n")


@query("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def unknown_keys(spark, sf):
    return U.unknown_keys(_read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), _read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), "k")


_LOG = "SELECT CASE WHEN event_id % 4 = 0 THEN 'heartbeat' WHEN event_type = 'error' THEN 'recorder_gap' WHEN event_type = 'signup' THEN 'recorder_start' ELSE 'other' END AS kind, ts AS observed_at, concat('run', CAST(floor(event_id / 500) AS INT)) AS run_id, event_id AS cycle, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS leg FROM events"
_NOW = "(SELECT max(ts) FROM events)"


def _log(spark, sf) -> DataFrame:
    e = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        F.when(F.col("event_id") % 4 == 0, "heartbeat").when(F.col("event_type") == "error", "recorder_gap").when(F.col("event_type") == "signup", "recorder_start").otherwise("other").alias("kind"), F.col("ts").alias("observed_at"),
        F.concat(F.lit("run"), F.floor(F.col("event_id") / 500).cast("int").cast("string")).alias("run_id"), F.col("event_id").alias("cycle"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("leg"),
    )


@query(f"""WITH l AS ({_LOG.replace("concat('run', CAST(floor(event_id / 500) AS INT))", "'run' || CAST(floor(event_id / 500) AS INT)")}), b AS (SELECT epoch_us(max(observed_at)) AS t FROM l WHERE kind = 'heartbeat')
SELECT leg, count(*) AS rows_today, any_value((epoch_us({_NOW}) - t) / 1e6) AS age_s, any_value(CASE WHEN (epoch_us({_NOW}) - t) / 1e6 < 120 THEN 'ALIVE' ELSE 'STALE' END) AS state FROM l, b WHERE CAST(observed_at AS DATE) = CAST({_NOW} AS DATE) GROUP BY 1""")
def recorder_status(spark, sf):
    log = _log(spark, sf)
    now = log.agg(F.max("observed_at").alias("t")).first()["t"]  # one value
    return U.recorder(log.select("leg", F.col("observed_at").alias("capture_ts")), log, F.lit(now))


@query(f"""WITH l AS ({_LOG.replace("concat('run', CAST(floor(event_id / 500) AS INT))", "'run' || CAST(floor(event_id / 500) AS INT)")}) SELECT kind, run_id, cycle FROM l WHERE kind IN ('recorder_gap', 'recorder_start') ORDER BY observed_at DESC, cycle DESC LIMIT 8""")
def recorder_events(spark, sf):
    return U.last_events(_log(spark, sf)).select("kind", "run_id", "cycle")


@query(f"""WITH l AS ({_LOG.replace("concat('run', CAST(floor(event_id / 500) AS INT))", "'run' || CAST(floor(event_id / 500) AS INT)")}), g AS (SELECT *, (epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER w) / 1e6 AS gap_s, lag(run_id) OVER w AS r FROM l WINDOW w AS (PARTITION BY kind, leg ORDER BY observed_at, cycle))
SELECT cycle, CASE WHEN r <> run_id THEN 'restart' WHEN gap_s > 1.5 * 3600 THEN 'late' END AS mark FROM g""")
def restart_marks(spark, sf):
    return U.restarts(_log(spark, sf), ["kind", "leg"], "observed_at", 3600.0).select("cycle", "mark")


@query("""WITH s AS (SELECT p_brand AS endpoint, 'size_ms' AS stage, round(p_size::DOUBLE, 3) AS v FROM part UNION ALL SELECT p_brand, 'price_ms', round(p_retailprice, 3) FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY endpoint, stage ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY endpoint, stage) AS n FROM s)
SELECT endpoint, stage, max(v) FILTER (i = least(n - 1, round_even((n - 1) * 0.5, 0))) AS p50, max(v) FILTER (i = least(n - 1, round_even((n - 1) * 0.95, 0))) AS p95, max(v) FILTER (i = least(n - 1, round_even((n - 1) * 0.99, 0))) AS p99 FROM r GROUP BY 1, 2""")
def latency_stages(spark, sf):
    s = _read(spark, sf, "part").select(F.col("p_brand").alias("endpoint"), F.col("p_size").cast("double").alias("size_ms"), F.col("p_retailprice").alias("price_ms"))
    return U.stages(s, "endpoint", ["size_ms", "price_ms"])


_CHECKS = "CASE WHEN o_orderstatus = 'P' THEN CAST(NULL AS DOUBLE) ELSE o_totalprice / 1000 END AS skew_ms, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'timeout' WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 1 THEN 'OSError' END AS error"


@query(f"SELECT o_orderkey AS pair_key, skew_ms IS NOT NULL AS healthy, CASE WHEN skew_ms IS NOT NULL THEN 'healthy' WHEN error = 'timeout' THEN 'timeout' WHEN error = 'OSError' THEN 'error:OSError' ELSE 'unavailable' END AS status FROM (SELECT o_orderkey, {_CHECKS} FROM orders)")
def pair_health(spark, sf):
    return _pair_health(spark, sf).drop("skew_ms")


def _pair_health(spark, sf) -> DataFrame:
    return U.pair_health(_read(spark, sf, "orders").selectExpr("o_orderkey AS pair_key", *_CHECKS.split(", ", 1)))


@query(f"SELECT count(*) AS pairs, count(skew_ms) AS healthy, count(*) - count(skew_ms) AS unavailable FROM (SELECT {_CHECKS} FROM orders)")
def health_summary(spark, sf):
    return U.health(_read(spark, sf, "orders").selectExpr("o_orderkey AS pair_key", *_CHECKS.split(", ", 1)))


@query("""WITH s AS (SELECT abs(c_acctbal) AS v FROM customer), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT any_value(n) AS paired, any_value(2 * n) AS book_rows, any_value(round(n / 10.0, 1)) AS updates_per_min, max(v) AS skew_max, max(v) FILTER (i = least(n - 1, floor(n * 0.50))) AS skew_p50, max(v) FILTER (i = least(n - 1, floor(n * 0.95))) AS skew_p95, max(v) FILTER (i = least(n - 1, floor(n * 0.99))) AS skew_p99 FROM r""")
def capture_summary(spark, sf):
    return U.capture(_read(spark, sf, "customer").select(F.col("c_acctbal").alias("skew_ms")), 600.0)


_TIMING = "l_partkey AS market, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey % 5 * 250 AS INT) END AS through_ms, l_quantity AS episodes, l_orderkey * 10 + l_linenumber AS rank"


@query(f"""WITH t AS (SELECT {_TIMING} FROM lineitem), f AS (SELECT market, arg_min(coalesce(through_ms, -1), rank) AS ms, arg_min(episodes, rank) AS episodes FROM t GROUP BY 1), o AS (SELECT DISTINCT p_partkey AS market FROM part WHERE p_size % 2 = 0)
SELECT f.market, episodes, o.market IS NOT NULL AS recurs, CASE WHEN ms >= 500 AND o.market IS NOT NULL THEN 'STRONG' WHEN ms >= 250 THEN 'PROMISING' WHEN ms = -1 THEN 'UNPROBED' ELSE 'WEAK' END AS label FROM f LEFT JOIN o ON f.market = o.market""")
def go_no_go(spark, sf):
    through = F.when(F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 5 * 250).cast("int"))
    t = _read(spark, sf, "lineitem").select(F.col("l_partkey").alias("market"), through.alias("through_ms"), F.col("l_quantity").alias("episodes"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # The SQL leaves equal ranks open; in one thread it takes the first row stored, and so does this.
    return U.go_no_go(t, _read(spark, sf, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("market")), ("file", "row")).select("market", "episodes", "recurs", "label")


@query("SELECT l_suppkey AS soak, string_agg(DISTINCT lpad(CAST(l_partkey AS VARCHAR), 8, '0'), ',' ORDER BY lpad(CAST(l_partkey AS VARCHAR), 8, '0')) AS markets FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def cross_soak_transients(spark, sf):
    e = _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("soak"), F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("market"), F.when(F.col("l_returnflag") == "R", "transient_candidate").otherwise("unusable").alias("bucket"))
    return U.transients(e).select("soak", F.array_join("markets", ",").alias("markets"))


@query("""WITH m AS (SELECT l_linestatus AS leg, CAST(l_partkey AS VARCHAR) AS market_id, count(*) AS intervals, count(*) FILTER (l_quantity > 40) AS gap_intervals, max(l_extendedprice) AS max_staleness_s FROM lineitem GROUP BY 1, 2)
SELECT leg, market_id, round(gap_intervals / intervals::DOUBLE, 9) AS gap_rate FROM m ORDER BY gap_intervals / intervals::DOUBLE DESC, max_staleness_s DESC, leg, market_id LIMIT 10""")
def worst_markets(spark, sf):
    m = _read(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("leg"), F.col("l_partkey").cast("string").alias("market_id")).agg(F.count("*").alias("intervals"), F.count_if(F.col("l_quantity") > 40).alias("gap_intervals"), F.max("l_extendedprice").alias("max_staleness_s"))
    return U.worst(m).select("leg", "market_id", F.round("gap_rate", 9).alias("gap_rate"))


# Scanner: orders stand for detections, their lines for probes.

_PROBES = "l_orderkey AS detection, CASE WHEN l_linenumber % 2 = 0 THEN 'a_yes_b_no' ELSE 'a_no_b_yes' END AS direction"


def _detections(spark, sf) -> DataFrame:
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("detection"), F.when(F.col("o_custkey") % 2 == 0, "a_yes_b_no").otherwise("a_no_b_yes").alias("direction"), (F.col("o_orderkey") * 1000).alias("recv_ns"))


def _probes(spark, sf) -> DataFrame:
    c = F.col
    one = _read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("detection"), F.when(c("l_linenumber") % 2 == 0, "a_yes_b_no").otherwise("a_no_b_yes").alias("direction"), F.element_at(F.array(F.lit(100), F.lit(200), F.lit(400)), (c("l_linenumber") % 3 + 1).cast("int")).alias("delay_ms"))
    x = one.agg(F.max(F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10_000_000).alias("recv_ns"), F.round(F.max(c("l_discount") - 0.05), 9).alias("depth_adj_edge"), F.round(F.min(c("l_tax") - 0.03), 9).alias("fee_adj_edge"), (F.max("l_quantity") > 25).alias("liquidity_complete"))
    return x.withColumn("qualifies", F.col("depth_adj_edge") > 0.01)


_PROBE_SQL = f"""d AS (SELECT o_orderkey AS detection, CASE WHEN o_custkey % 2 = 0 THEN 'a_yes_b_no' ELSE 'a_no_b_yes' END AS direction, o_orderkey * 1000 AS ns FROM orders),
p AS (SELECT {_PROBES}, ([100, 200, 400])[l_linenumber % 3 + 1] AS delay_ms, max(l_orderkey * 1000 + l_linenumber * 10000000) AS pns, round(max(l_discount - 0.05), 9) AS de, round(min(l_tax - 0.03), 9) AS fe, max(l_quantity) > 25 AS whole FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT *, CASE WHEN whole THEN de ELSE fe END AS edge FROM p)"""


@query(f"""WITH {_PROBE_SQL} SELECT d.detection, d.direction, coalesce(edge > 0, false) AS survived, edge, coalesce(de > 0.01, false) AS probe_qualifies, round((pns - ns) / 1e6, 2) AS elapsed_ms FROM d LEFT JOIN (SELECT * FROM e WHERE delay_ms = 200) e ON d.detection = e.detection AND d.direction = e.direction""")
def survival_probes(spark, sf):
    return N.probed(_detections(spark, sf), _probes(spark, sf).filter("delay_ms = 200")).select("detection", "direction", "survived", "edge", "probe_qualifies", "elapsed_ms")


@query(f"""WITH {_PROBE_SQL}, r AS (SELECT d.detection, d.direction, {", ".join(f"max(edge) FILTER (delay_ms = {k}) AS e{k}" for k in (100, 200, 400))} FROM d LEFT JOIN e ON d.detection = e.detection AND d.direction = e.direction GROUP BY 1, 2)
SELECT detection, direction, {", ".join(f"coalesce(e{k} > 0, false) AS probe_{k}ms_survived, e{k} AS probe_{k}ms_edge" for k in (100, 200, 400))}, coalesce(e200 > 0, false) AS survived, e200 AS survived_edge FROM r""")
def survival_rungs(spark, sf):
    return N.rungs(_detections(spark, sf), _probes(spark, sf), (400, 100, 200))


@query("""WITH a AS (SELECT o_custkey AS cycle, o_orderkey % 50 AS pair_key, min(o_orderkey) AS ns FROM orders GROUP BY 1, 2), b AS (SELECT l_suppkey AS cycle, l_partkey % 50 AS pair_key, max(l_orderkey) AS ns FROM lineitem GROUP BY 1, 2)
SELECT cycle, pair_key, (a.ns - b.ns) / 1e6 AS skew_ms, greatest(a.ns, b.ns) AS recv_ns FROM a JOIN b USING (cycle, pair_key)""")
def paired_cycles(spark, sf):
    a = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cycle"), (F.col("o_orderkey") % 50).alias("pair_key")).agg(F.min("o_orderkey").alias("recv_ns"))
    b = _read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cycle"), (F.col("l_partkey") % 50).alias("pair_key")).agg(F.max("l_orderkey").alias("recv_ns"))
    return N.cycles(a, b).select("cycle", "pair_key", "skew_ms", "recv_ns")


_REC = {
    "edge_id": "CAST(l_orderkey * 10 + l_linenumber AS STRING)", "pair_key": "concat('P', CAST(l_orderkey AS STRING))", "direction": "l_linestatus", "arb_detected": "l_tax > 0.02", "qualifies": "CASE WHEN l_quantity < 5 THEN CAST(NULL AS BOOLEAN) ELSE l_tax > 0.04 END",
    "a_fetch_ms": "CASE WHEN l_quantity > 30 THEN CAST(NULL AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END", "b_fetch_ms": "CASE WHEN l_suppkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(l_suppkey AS DOUBLE) END", "capture_skew_ms": "CAST(l_linenumber - 4 AS DOUBLE)",
    "raw_edge": "CAST(l_discount AS DOUBLE)", "fee_adj_edge": "CAST(l_discount - 0.02 AS DOUBLE)", "depth_adj_edge": "CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS DOUBLE) ELSE CAST(l_discount - 0.03 AS DOUBLE) END", "max_profitable_size": "CAST(l_quantity AS DOUBLE)",
    "a_status": "CASE WHEN l_partkey % 4 = 0 THEN 'stale' ELSE 'fresh' END", "b_status": "CASE WHEN l_partkey % 5 = 0 THEN 'missing' ELSE 'fresh' END", "fee_usd": "CASE WHEN l_linenumber = 1 THEN CAST(l_tax AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END", "target_size": "CAST(l_quantity - 10 AS DOUBLE)", "fee_model_version": "CAST(NULL AS STRING)",
}


@query(f"""WITH {_PAIRS}, r AS (SELECT {", ".join(_cols(_REC))} FROM lineitem), q AS (SELECT pair_key, any_value(display_name) AS display_name, any_value(equivalence) AS equivalence, any_value(include) AS include FROM p WHERE o_orderkey % 71 <> 0 AND o_orderkey % 10 <> 0 GROUP BY 1)
SELECT edge_id, pair_key, coalesce(nullif(display_name, ''), pair_key) AS display_name, direction, arb_detected, coalesce(qualifies, false) AS qualifies, coalesce(greatest(a_fetch_ms, b_fetch_ms), abs(capture_skew_ms)) AS round_trip_latency_ms,
 round(CASE WHEN fee_usd IS NOT NULL AND target_size > 0 THEN fee_usd / target_size ELSE greatest(raw_edge - fee_adj_edge, 0) END, 9) AS est_fees, CASE WHEN fee_usd IS NOT NULL AND target_size > 0 THEN 'unknown' ELSE 'flat_heuristic' END AS fee_model_version,
 round(coalesce(depth_adj_edge * max_profitable_size * 0.5, 0), 9) AS est_profit, max_profitable_size * 0.5 AS executable_size, coalesce(equivalence, 'unreviewed') AS contract_equivalent, coalesce(include, false) AS include FROM r LEFT JOIN q USING (pair_key)""")
def standard_edges(spark, sf):
    pairs = _pairs(spark, sf).filter("o_orderkey % 71 <> 0 AND o_orderkey % 10 <> 0")
    out = N.standard(_read(spark, sf, "lineitem").selectExpr(*_cols(_REC)), pairs, 0.5)
    return out.withColumns({"est_fees": F.round("est_fees", 9), "est_profit": F.round("est_profit", 9)}).drop("freshness_status")


@query("""SELECT o_orderkey, CASE WHEN p <= 25 THEN 0.1 WHEN p <= 250 THEN 0.25 WHEN p <= 1000 THEN 0.8 ELSE 0.0 END::DOUBLE AS survival_p, s = 'F' AS viable, q OR k <> 0 AS is_probe, greatest(TRY_CAST(x AS DOUBLE), TRY_CAST(y AS DOUBLE)) AS most,
 greatest(0.5 * CASE WHEN k <> 0 AND q THEN least(k, p) ELSE p END, 0) AS fill FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS p, o_orderstatus AS s, o_custkey % 2 = 0 AS q, o_custkey % 5 AS k, o_orderpriority AS x, CAST(o_custkey AS VARCHAR) AS y FROM orders)""")
def scanner_scalars(spark, sf):
    c = F.col
    o = _read(spark, sf, "orders").select("o_orderkey", c("o_custkey").cast("double").alias("p"), F.when(c("o_orderstatus") == "F", "fresh").otherwise("stale").alias("s"), (c("o_custkey") % 2 == 0).alias("q"), (c("o_custkey") % 5).alias("k"), c("o_orderpriority").alias("x"), c("o_custkey").cast("string").alias("y"))
    a = F.when((c("k") != 0) & c("q"), c("k").cast("double"))
    return o.select("o_orderkey", N.survival_probability(c("p"), {25: 0.1, 250: 0.25, 1000: 0.8}).alias("survival_p"), N.viable(c("s")).alias("viable"), N.is_probe(c("q"), c("k")).alias("is_probe"), N.numeric_max(c("x"), c("y")).alias("most"), N.expected_fill(a, c("p"), c("p"), 0.5).alias("fill"))


@query("""WITH RECURSIVE t AS (SELECT o_custkey AS pair_key, epoch(o_orderdate)::BIGINT AS s FROM orders GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY s) AS i FROM t),
r AS (SELECT pair_key, s, i, s AS last, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.pair_key, n.s, n.i, CASE WHEN n.s - r.last >= 10000000 THEN n.s ELSE r.last END, n.s - r.last >= 10000000 FROM r JOIN n ON n.pair_key = r.pair_key AND n.i = r.i + 1)
SELECT pair_key, s AS at_s FROM r WHERE kept""")
def throttled_probes(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("pair_key"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at_s")).distinct()
    return N.throttled(o, "at_s", 10_000_000.0)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS n FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.04)) SELECT concat_ws(':', CAST(l_suppkey AS VARCHAR), l_returnflag, CAST(n AS VARCHAR)) AS edge_id, l_orderkey * 10 + l_linenumber AS k FROM e""")
def edge_ids(spark, sf):
    e = _read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("soak"), F.col("l_returnflag").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_tax") > 0.04).alias("qualifies")).distinct()
    return N.with_edge_id(N.qualifying(e, True), F.col("soak"), F.col("file"), "k").select("edge_id", "k")


@query("""WITH r AS (SELECT o_custkey AS token, epoch(o_orderdate)::BIGINT * 100000 + o_orderkey AS at_s, CASE WHEN o_orderkey % 5 = 0 THEN 'x' WHEN o_orderkey % 7 = 0 THEN '-3' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS base_fee FROM orders),
g AS (SELECT *, CASE WHEN TRY_CAST(base_fee AS INT) >= 0 THEN at_s END AS good_at FROM r), l AS (SELECT *, max(good_at) OVER (PARTITION BY token ORDER BY at_s) AS last_at FROM g)
SELECT l.token, l.at_s, CASE WHEN l.at_s - l.last_at < 2000 * 3600 * 1000::BIGINT THEN TRY_CAST(k.base_fee AS INT) ELSE 1000 END AS bps, CASE WHEN l.at_s - l.last_at < 2000 * 3600 * 1000::BIGINT THEN 'api' ELSE 'fallback' END AS source FROM l LEFT JOIN r k ON k.token = l.token AND k.at_s = l.last_at""")
def rate_lookups(spark, sf):
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 100_000 + F.col("o_orderkey")
    fee = F.when(F.col("o_orderkey") % 5 == 0, "x").when(F.col("o_orderkey") % 7 == 0, "-3").otherwise((F.col("o_orderkey") % 100).cast("string"))
    return fees.recorded_rate(_read(spark, sf, "orders").select(F.col("o_custkey").alias("token"), at.alias("at_s"), fee.alias("base_fee")), "token", "at_s", 2_000_000.0).select("token", "at_s", "bps", "source")
