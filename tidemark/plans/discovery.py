"""Queries of discovery and of the fee metadata, each with its SQL. Raw records are written once, for Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fees
from tidemark.operators import discovery as D
from tidemark.plans.registry import query


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cols(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


_RAW_A = {
    "ticker": "CASE WHEN p_partkey % 29 = 0 THEN ' ' WHEN p_partkey % 31 = 0 THEN concat('KXMVE', CAST(p_partkey AS STRING)) ELSE concat('T', CAST(p_partkey AS STRING)) END",
    "event_ticker": "concat('S', CAST(p_size AS STRING), '-', p_type)",
    "title": "CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END",
    "yes_sub_title": "p_brand",
    "no_sub_title": "CAST(NULL AS STRING)",
    "status": "CASE WHEN p_partkey % 17 = 0 THEN 'settled' WHEN p_partkey % 2 = 0 THEN 'ACTIVE' ELSE 'open' END",
    "close_time": "CASE WHEN p_partkey % 19 = 0 THEN CAST('2023-06-01 00:00:00' AS TIMESTAMP) ELSE CAST('2024-06-01 00:00:00' AS TIMESTAMP) END",
    "rules_primary": "concat('Resolves by ', p_type)",
    "rules_secondary": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' the list of ', p_brand, ' ') END",
    "mve": "p_partkey % 37 = 0",
    "volume_24h": "CAST(p_retailprice - 930 AS DOUBLE)",
    "volume": "CAST(p_size - 2 AS DOUBLE)",
    "open_interest": "CAST(p_retailprice * 100 AS DOUBLE)",
    "yes_bid": "CAST((p_size % 50) / 100.0E0 AS DOUBLE)",
    "yes_ask": "CAST((p_size % 50 + p_partkey % 33) / 100.0E0 AS DOUBLE)",
    "no_bid": "CAST((40 - p_size) / 100.0E0 AS DOUBLE)",
    "no_ask": "CAST((45 - p_size) / 100.0E0 AS DOUBLE)",
    "yes_ask_size": "CAST(p_partkey % 4 AS DOUBLE)",
    "no_ask_size": "CAST(p_partkey % 3 AS DOUBLE)",
}


def _price(c: str) -> str:
    return f"CASE WHEN {c} > 0 AND {c} < 1 THEN {c} END"


def _spread(bid: str, ask: str) -> str:
    return f"CASE WHEN {ask} >= {bid} THEN round({ask} - {bid}, 10) END"


_A_SQL = f"""raw AS (SELECT {", ".join(_cols(_RAW_A))} FROM part), t AS (SELECT concat('T', CAST(l_partkey AS STRING)) AS tk, count(*) AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
p AS (SELECT *, {", ".join(f"{_price(c)} AS p_{c}" for c in ("yes_bid", "yes_ask", "no_bid", "no_ask"))} FROM raw),
m AS (SELECT trim(ticker) AS market_id, trim(event_ticker) AS event_id, coalesce(nullif(trim(title), ''), trim(yes_sub_title)) AS question, lower(status) AS st, close_time,
 trim(rules_primary) || CASE WHEN trim(rules_secondary) = '' THEN '' ELSE chr(10) || trim(rules_secondary) END AS rules, volume_24h, volume AS volume_total, open_interest, mve OR starts_with(ticker, 'KXMVE') AS multi,
 least({_spread("p_yes_bid", "p_yes_ask")}, {_spread("p_no_bid", "p_no_ask")}) AS spread, yes_ask_size AS yd, no_ask_size AS nd, coalesce(n, 0) AS trades, coalesce(v, 0) AS tv FROM p LEFT JOIN t ON ticker = tk),
a AS (SELECT *, CASE WHEN market_id = '' OR event_id = '' THEN 'missing_identifiers' WHEN st NOT IN ('active', 'open') THEN 'not_open' WHEN close_time <= TIMESTAMP '2024-01-01 00:00:00' THEN 'stale_or_expired' WHEN multi THEN 'multivariate'
 WHEN length(question) < 8 THEN 'unclear_question' WHEN length(rules) < 20 THEN 'unclear_rules' WHEN volume_24h < 1 THEN 'low_24h_volume' WHEN volume_total < 1 THEN 'low_total_volume' WHEN spread IS NULL THEN 'empty_quotes' WHEN spread > 0.25 THEN 'wide_spread'
 WHEN greatest(yd, nd) < 1 THEN 'insufficient_depth' END AS reject_reason FROM m)"""


def _venue_a(spark, sf) -> DataFrame:
    raw = _read(spark, sf, "part").selectExpr(*_cols(_RAW_A))
    trades = _read(spark, sf, "lineitem").groupBy(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("ticker")).agg(F.count("*").alias("trades"), F.sum("l_quantity").alias("volume"))
    return D.venue_a(raw, trades, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(f"WITH {_A_SQL} SELECT market_id, event_id, split_part(event_id, '-', 1) AS series_id, question, round(spread, 9) AS spread, trades AS recent_trade_count, round(tv, 6) AS recent_trade_volume, reject_reason FROM a")
def normal_markets_a(spark, sf):
    return _venue_a(spark, sf).select("market_id", "event_id", "series_id", "question", F.round("spread", 9).alias("spread"), "recent_trade_count", F.round("recent_trade_volume", 6).alias("recent_trade_volume"), "reject_reason")


@query(f"WITH {_A_SQL} SELECT reject_reason AS reason, count(*) AS n FROM a WHERE reject_reason IS NOT NULL GROUP BY 1")
def reject_histogram(spark, sf):
    return D.histogram(_venue_a(spark, sf))


@query(f"WITH {_A_SQL}, r AS (SELECT market_id, volume_24h, volume_total, round(volume_24h + 2 * tv + least(open_interest, 100000) * 0.01, 6) AS activity FROM a WHERE reject_reason IS NULL) SELECT * FROM r ORDER BY activity DESC, volume_24h DESC, volume_total DESC, market_id DESC LIMIT 40")
def ranked_markets(spark, sf):
    return D.ranked(_venue_a(spark, sf)).limit(40).select("market_id", "volume_24h", "volume_total", "activity")


@query("""WITH f AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS venue, CAST(l_partkey AS STRING) AS market_id, round(l_extendedprice, 2) AS activity FROM lineitem),
d AS (SELECT venue, market_id, max(activity) AS activity FROM f WHERE activity >= 50000 GROUP BY 1, 2) SELECT * FROM d ORDER BY activity DESC, venue, market_id LIMIT 100""")
def discovery_universe(spark, sf):
    found = _read(spark, sf, "lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("venue"), F.col("l_partkey").cast("string").alias("market_id"), F.round("l_extendedprice", 2).alias("activity"))
    return D.universe(found, 100, 50_000.0)


_RAW_B = {
    "condition_id": "CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE concat('0x', CAST(o_orderkey AS STRING)) END",
    "slug": "concat('order-', CAST(o_orderkey AS STRING))",
    "question": "CASE WHEN o_orderkey % 13 = 0 THEN 'Short?' ELSE concat('Will it ship with ', o_orderpriority) END",
    "active": "o_orderstatus <> 'P'",
    "closed": "o_orderkey % 11 = 0",
    "accepting": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS BOOLEAN) ELSE TRUE END",
    "end_date": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST('2024-06-01 00:00:00' AS TIMESTAMP) END",
    "description": "concat('By ', o_orderpriority, ' of status ')",
    "source": "o_orderstatus",
    "neg_risk": "o_orderkey % 43 = 0",
    "outcomes": "CASE WHEN o_orderkey % 10 = 0 THEN '[\"Up\", \"Down\"]' WHEN o_orderkey % 9 = 0 THEN 'no json' ELSE '[\"Yes\", \"No\"]' END",
    "tokens": "CASE WHEN o_orderkey % 8 = 0 THEN '[\"7\"]' ELSE concat('[\"', CAST(o_orderkey AS STRING), '1\", \"', CAST(o_orderkey AS STRING), '2\"]') END",
    "book": "o_orderkey % 5 <> 0",
    "volume_24h": "CAST(o_totalprice / 1000 AS DOUBLE)",
    "volume": "CAST(o_totalprice AS DOUBLE)",
    "liquidity": "CAST(o_custkey AS DOUBLE)",
    "open_interest": "CAST(o_custkey * 2 AS DOUBLE)",
    "best_bid": "CAST((o_orderkey % 97) / 100.0E0 AS DOUBLE)",
    "best_ask": "CAST((o_orderkey % 97 + o_custkey % 40) / 100.0E0 AS DOUBLE)",
    "yes_depth": "CAST(o_custkey % 3 AS DOUBLE)",
    "no_depth": "CAST(o_orderkey % 2 AS DOUBLE)",
}

_B_SQL = f"""raw AS (SELECT o_custkey, {", ".join(_cols(_RAW_B))} FROM orders),
m AS (SELECT condition_id AS market_id, 'e' || o_custkey AS event_id, slug, question, active AND NOT closed AND coalesce(accepting, false) AS open, coalesce(end_date, CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 6 = 1 THEN TIMESTAMP '2023-01-01 00:00:00' ELSE TIMESTAMP '2024-05-01 00:00:00' END) AS close_time,
 trim(description) || chr(10) || source AS rules, neg_risk AS multi, outcomes, tokens, book, volume_24h, volume, {_price("best_bid")} AS bid, {_price("best_ask")} AS ask, yes_depth, no_depth FROM raw),
b AS (SELECT *, {_spread("bid", "ask")} AS spread, round(1 - ask, 10) AS best_no_bid FROM m),
r AS (SELECT *, CASE WHEN market_id = '' THEN 'missing_identifiers' WHEN NOT open THEN 'not_open' WHEN close_time IS NULL OR close_time <= TIMESTAMP '2024-01-01 00:00:00' THEN 'stale_or_expired' WHEN multi THEN 'multivariate' WHEN length(question) < 8 THEN 'unclear_question'
 WHEN length(rules) < 20 THEN 'unclear_rules' WHEN outcomes NOT LIKE '%Yes%' THEN 'unsupported_outcomes' WHEN tokens = '["7"]' THEN 'missing_token_ids' WHEN NOT book THEN 'orderbook_disabled' WHEN volume_24h < 1 THEN 'low_24h_volume' WHEN volume < 1 THEN 'low_total_volume'
 WHEN spread IS NULL THEN 'empty_quotes' WHEN spread > 0.25 THEN 'wide_spread' WHEN greatest(yes_depth, no_depth) < 1 THEN 'insufficient_depth' END AS reject_reason FROM b)"""


@query(f"WITH {_B_SQL} SELECT market_id, event_id, slug, round(spread, 9) AS spread, round(best_no_bid, 9) AS best_no_bid, CASE WHEN tokens <> '[\"7\"]' THEN substr(slug, 7) || '2' END AS no_token_id, reject_reason FROM r")
def normal_markets_b(spark, sf):
    """Events hold their markets as arrays; outcomes and tokens are JSON inside text."""
    raw = _read(spark, sf, "orders").selectExpr("o_custkey", *_cols(_RAW_B))
    events = raw.groupBy("o_custkey").agg(F.collect_list(F.struct(*_RAW_B)).alias("markets"))
    end = F.when(F.col("o_custkey") % 6 == 0, None).when(F.col("o_custkey") % 6 == 1, F.lit("2023-01-01 00:00:00")).otherwise(F.lit("2024-05-01 00:00:00")).cast("timestamp")
    events = events.select(F.concat(F.lit("e"), "o_custkey").alias("id"), F.lit("").alias("slug"), F.lit(None).cast("string").alias("series"), end.alias("end_date"), F.lit(None).cast("boolean").alias("neg_risk"), "markets")
    return D.venue_b(events, F.lit("2024-01-01 00:00:00").cast("timestamp")).select("market_id", "event_id", "slug", F.round("spread", 9).alias("spread"), F.round("best_no_bid", 9).alias("best_no_bid"), "no_token_id", "reject_reason")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) * 0.2::DOUBLE AS price, l_quantity - 3 AS size FROM lineitem)
SELECT l_orderkey, max(CASE WHEN price > 0 AND price < 1 AND size > 0 THEN round(price, 9) END) AS best_bid, min(CASE WHEN price > 0 AND price < 1 AND size > 0 THEN round(price, 9) END) AS best_ask, coalesce(sum(CASE WHEN price > 0 AND price < 1 AND size > 0 THEN size END), 0.0) AS ask_depth FROM l GROUP BY 1""")
def payload_metrics(spark, sf):
    """Book metrics of a payload: an order's lines are the levels of both sides."""
    level = F.struct(((F.col("l_linenumber") - 1) * 0.2).cast("double").alias("price"), (F.col("l_quantity") - 3).cast("double").alias("size"))
    books = _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(level).alias("levels"))
    m = books.select("l_orderkey", D.book_metrics(F.col("levels"), F.col("levels")).alias("m"))
    return m.select("l_orderkey", F.round("m.best_bid", 9).alias("best_bid"), F.round("m.best_ask", 9).alias("best_ask"), "m.ask_depth")


@query("SELECT CAST(l_partkey AS STRING) AS market_id, arg_max(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) AS version, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS flag FROM lineitem WHERE l_partkey % 50 <> 0 GROUP BY 1")
def discovery_index(spark, sf):
    li = _read(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("market_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), F.col("l_returnflag").alias("flag"))
    return D.index(li, "version").select("market_id", "version", "flag")


_RULES = (("S1", 350, 90), ("S2-ECONOMY", 500, 0), ("S2", 800, 100), ("S3-PROMO", 0, 175))


@query("""WITH t AS (SELECT p_partkey, 'S' || p_size % 5 || '-' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '-X' ELSE '' END AS ticker FROM part)
SELECT p_partkey, CASE WHEN split_part(ticker, '-', 1) = 'S1' THEN 350 WHEN ticker = 'S2-ECONOMY' OR starts_with(ticker, 'S2-ECONOMY-') THEN 500 WHEN split_part(ticker, '-', 1) = 'S2' THEN 800 WHEN ticker = 'S3-PROMO' OR starts_with(ticker, 'S3-PROMO-') THEN 0 ELSE 700 END AS taker_e4,
 CASE WHEN split_part(ticker, '-', 1) = 'S1' THEN 90 WHEN ticker = 'S2-ECONOMY' OR starts_with(ticker, 'S2-ECONOMY-') THEN 0 WHEN split_part(ticker, '-', 1) = 'S2' THEN 100 WHEN ticker = 'S3-PROMO' OR starts_with(ticker, 'S3-PROMO-') THEN 175 ELSE 0 END AS maker_e4 FROM t""")
def fee_overrides(spark, sf):
    t = _read(spark, sf, "part").select("p_partkey", F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string"), F.lit("-"), "p_type", F.when(F.col("p_partkey") % 2 == 0, "-X").otherwise("")).alias("ticker"))
    m = fees.multipliers(F.col("ticker"), fees.Schedule(overrides=_RULES))
    return t.select("p_partkey", m["taker_e4"].alias("taker_e4"), m["maker_e4"].alias("maker_e4"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 10, 0.05), 0.95) AS p, l_quantity AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(ceil(round(0.07 * n * round(p, 2) * (1 - round(p, 2)) * 100, 6)) AS BIGINT) AS taker_cents, CAST(ceil(round(0.0175 * n * round(p, 2) * (1 - round(p, 2)) * 100, 6)) AS BIGINT) AS maker_cents FROM x""")
def maker_taker_fees(spark, sf):
    li = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.least(F.greatest(F.col("l_discount") * 10, F.lit(0.05)), F.lit(0.95)), 2).alias("p"), F.col("l_quantity").cast("long").alias("n"))
    return li.select("l_orderkey", "l_linenumber", *(fees.order_cents(F.lit(m), F.col("p"), F.col("n")).alias(f"{k}_cents") for k, m in (("taker", fees.TAKER_E4), ("maker", fees.MAKER_SERIES_E4))))


_META = {
    "market_ok": "o_orderkey % 11 <> 0",
    "rate_ok": "o_orderkey % 13 <> 0",
    "base_fee": "CASE WHEN o_orderkey % 17 = 0 THEN 'x' WHEN o_orderkey % 19 = 0 THEN '-5' WHEN o_orderkey % 3 = 0 THEN '0' ELSE CAST(o_custkey % 50 AS STRING) END",
    "taker_fee": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 5 = 0 THEN '10' WHEN o_orderkey % 3 = 0 THEN '0' ELSE CAST(o_custkey % 50 AS STRING) END",
    "curve_rate": "CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE CAST(CAST(o_custkey % 9 AS DOUBLE) / 100 AS STRING) END",
}


@query(f"""WITH m AS (SELECT o_orderkey, {", ".join(_cols(_META))} FROM orders), n AS (SELECT *, TRY_CAST(base_fee AS INT) AS b, coalesce(TRY_CAST(taker_fee AS INT), TRY_CAST(base_fee AS INT)) AS t, TRY_CAST(curve_rate AS DOUBLE) AS r FROM m)
SELECT o_orderkey, CASE WHEN NOT market_ok THEN 'market_info_unavailable' WHEN NOT rate_ok THEN 'fee_rate_unavailable' WHEN b IS NULL THEN 'invalid_fee_payload' WHEN b < 0 OR t < 0 THEN 'negative_fee_metadata' WHEN b <> t THEN 'fee_endpoint_mismatch'
 WHEN b <> 0 AND coalesce(r, 0) <= 0 THEN 'missing_fee_curve_rate' ELSE 'public_fee_metadata_verified' END AS reason,
 CASE WHEN market_ok AND rate_ok AND b >= 0 AND t >= 0 AND b = t THEN CASE WHEN b = 0 THEN 0.0 WHEN r > 0 THEN r END END AS fee_rate FROM n""")
def fee_cross_check(spark, sf):
    return fees.cross_checked(_read(spark, sf, "orders").selectExpr("o_orderkey", *_cols(_META))).select("o_orderkey", "reason", "fee_rate")


_TRADE = "SELECT l_orderkey, l_linenumber, round(0.05 + l_discount * 3, 2) AS pa, round(0.9 - l_tax * 5, 2) AS pb, CAST(l_quantity * 1.25 AS DOUBLE) AS size, l_suppkey * 10 AS bps FROM lineitem"


@query(f"""WITH t AS ({_TRADE}), f AS (SELECT *, ceil(round(7 * ceil(size) * CAST(pa AS DECIMAL(4, 2)) * (1 - CAST(pa AS DECIMAL(4, 2))), 6)) / 100.0 + size * bps / 10000.0 * least(pb, 1 - pb) AS fee FROM t)
SELECT l_orderkey, l_linenumber, round(1 - pa - pb - fee / size, 9) + 0.0 AS fee_adj_edge, 'formula:v1' AS fee_model_version, round(fee, 9) AS fee_usd_at_target FROM f""")
def real_fee_columns(spark, sf):
    c = F.col
    t = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(0.05 + c("l_discount") * 3, 2).alias("pa"), F.round(0.9 - c("l_tax") * 5, 2).alias("pb"), (c("l_quantity") * 1.25).cast("double").alias("size"), (c("l_suppkey") * 10).alias("bps"))
    out = t.select("l_orderkey", "l_linenumber", *(x.alias(n) for n, x in fees.override_columns(1 - c("pa") - c("pb"), F.lit(fees.TAKER_E4), c("bps"), c("pa"), c("pb"), c("size"), "formula:v1").items()))
    return out.withColumns({n: F.round(n, 9) + 0.0 for n in ("fee_adj_edge", "fee_usd_at_target")})  # no negative zeros
