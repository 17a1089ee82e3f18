"""Queries of registry, discovery, matching and text operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import matching as M
from tidemark.operators import registry as G
from tidemark.plans.registry import query


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _words_sql(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_ENT = f"list_distinct(list_filter(regexp_extract_all(lower({{c}}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({_words_sql(T.STOP_WORDS + T.NO_ENTITY)}, t) AND NOT regexp_matches(t, '^[0-9]+$')))"


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


def _customers(spark, sf):
    """Customers as token sets: country, market segment and the digits of the name in groups of three."""
    c = _read(spark, sf, "customer").join(_read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [F.lower("c_mktsegment"), F.concat(F.lit("n"), "n_nationkey"), *(F.concat(F.lit(p), F.substring("c_name", -k, n)) for p, k, n in (("x", 3, 3), ("y", 6, 3), ("z", 2, 2), ("w", 1, 1)))]
    return c.select(F.col("c_custkey").alias("id"), F.array_distinct(F.array(*parts)).alias("tokens"))


_CUSTOMERS = """x AS (SELECT c_custkey AS id, list_sort(list_distinct([lower(c_mktsegment), 'n' || n_nationkey, 'x' || substr(c_name, -3, 3), 'y' || substr(c_name, -6, 3), 'z' || substr(c_name, -2, 2), 'w' || substr(c_name, -1, 1)])) AS t
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {_CUSTOMERS}, e AS (SELECT a.id AS a_id, b.id AS b_id, {_jac("a.t", "b.t")} AS overlap FROM x a JOIN x b ON a.id < b.id AND len(list_intersect(a.t, b.t)) >= 3)
SELECT a_id, b_id, round(overlap, 9) AS overlap FROM e WHERE overlap >= 0.7""")
def token_overlap_join(spark, sf):
    """Every pair of customers whose token sets overlap by 0.7: common tokens build no pairs, rare ones do."""
    x = _customers(spark, sf)
    return M.overlapping(x, x, 0.7).filter("a_id < b_id").withColumn("overlap", F.round("overlap", 9))


@query(f"""WITH x AS (SELECT p_partkey AS id, list_sort({_ENT.format(c="p_name || ' ' || p_brand")}) AS t FROM part), r AS (SELECT t, min(id) AS id, count(*) AS n FROM x GROUP BY t)
SELECT a.id AS a_id, b.id AS b_id, a.n AS a_rows, b.n AS b_rows, round({_jac("a.t", "b.t")}, 9) AS overlap FROM r a JOIN r b ON a.id < b.id WHERE {_jac("a.t", "b.t")} >= 0.45""")
def token_class_overlap(spark, sf):
    """Parts of equal token sets are one class; the pairs are those of the classes, with how many rows each has."""
    x = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.entities(F.concat_ws(" ", "p_name", "p_brand")).alias("tokens"))
    classes = M.token_classes(x).groupBy(F.col("class_id").alias("id")).agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    pairs = M.overlapping(classes, classes, 0.45).filter("a_id < b_id").withColumn("overlap", F.round("overlap", 9))
    rows = lambda p: classes.select(F.col("id").alias(f"{p}_id"), F.col("n").alias(f"{p}_rows"))
    return pairs.join(rows("a"), "a_id").join(rows("b"), "b_id").select("a_id", "b_id", "a_rows", "b_rows", "overlap")


def _questions(spark, sf):
    """One market for each order of the two sides: texts, closing times and labels that the rules tell apart."""
    o = _read(spark, sf, "orders").join(_read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_format("o_orderdate", "MMMM")
    place = F.element_at(F.array(F.lit("Canada"), F.lit("Japan"), F.lit("somewhere")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.lit("Will"), "c_name", F.when(F.col("o_orderkey") % 5 == 0, "not"), F.lit("ship"), F.lower("c_mktsegment"), F.lit("in"), month, F.year("o_orderdate").cast("string")).alias("question"),
        F.concat_ws(" ", F.lit("Resolves by the register of"), place, F.lower("o_orderpriority")).alias("rules"), F.col("o_orderdate").cast("timestamp").alias("close_time"),
        F.when(F.col("o_orderkey") % 7 == 0, "Shipped").otherwise("Yes").alias("yes_label"), F.when(F.col("o_orderkey") % 7 == 0, "Kept").otherwise("No").alias("no_label"), "o_custkey",
    )


def _rx(c: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all({c}, '{pattern}', 1))"


_SETS = rf"""s AS (SELECT *, {_rx("w", rf"\b({T.YEARS})\b")} AS y, {_rx("w", rf"\b({T.MONTHS})\b")} AS mo, list_distinct(list_intersect(string_split(w, ' '), {_words_sql(T.PLACES)})) AS pl,
 list_filter(list_distinct(string_split(rules, ' ')), lambda t: t <> '' AND NOT list_contains({_words_sql(T.STOP_WORDS)}, t)) AS rw,
 list_sort(list_distinct(list_filter(string_split(question, ' '), lambda t: regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(t, '^{T.YEARS}$')))) AS nu, regexp_matches(question, '\b(?:{T.NEGATION})\b') AS ne
 FROM (SELECT *, question || ' ' || rules AS w FROM n)),
d AS (SELECT *, list_distinct(list_concat(y, mo)) AS da FROM s)"""


def _compat(c: str) -> str:
    return f"CASE WHEN len(a.{c}) = 0 AND len(b.{c}) = 0 THEN 0.75 WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0.5 ELSE {_jac(f'a.{c}', f'b.{c}')} END"


def _clash(c: str) -> str:
    return f"(len(a.{c}) > 0 AND len(b.{c}) > 0 AND len(list_intersect(a.{c}, b.{c})) = 0)"


@query(rf"""WITH q AS (SELECT o_orderkey AS id, o_custkey, 'Will ' || c_name || CASE WHEN o_orderkey % 5 = 0 THEN ' not' ELSE '' END || ' ship ' || lower(c_mktsegment) || ' in ' || strftime(o_orderdate, '%B') || ' ' || year(o_orderdate) AS question,
 'Resolves by the register of ' || (['Canada', 'Japan', 'somewhere'])[c_nationkey % 3 + 1] || ' ' || lower(o_orderpriority) AS rules, o_orderdate AS close_time, CASE WHEN o_orderkey % 7 = 0 THEN 'shipped' ELSE 'yes' END AS yes_label FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT id, o_custkey, close_time, yes_label, array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+'), ' ') AS question, array_to_string(regexp_extract_all(lower(rules), '[a-z0-9]+'), ' ') AS rules FROM q),
{_SETS}
SELECT a.id AS a_id, b.id AS b_id, round({_jac("a.rw", "b.rw")}, 6) AS rule_similarity, round({_compat("da")}, 9) AS date_compatibility, round({_compat("pl")}, 9) AS location_compatibility,
 round(abs(epoch_us(a.close_time) - epoch_us(b.close_time)) / 3.6e9, 6) AS close_delta_hours, {_clash("y")} OR {_clash("mo")} OR {_clash("da")} AS dates_conflict, {_clash("pl")} AS places_conflict,
 len(a.nu) > 0 AND len(b.nu) > 0 AND a.nu <> b.nu AS numbers_conflict, a.yes_label = 'yes' AND b.yes_label = 'yes' AS generic_labels, a.ne <> b.ne AS polarity_differs
FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.id < b.id""")
def match_evidence(spark, sf):
    """All rules of matching but the text ratio, over every pair of orders of a customer."""
    m = _questions(spark, sf)
    key = lambda p: m.select(F.col("id").alias(f"{p}_id"), "o_custkey")
    pairs = key("a").join(key("b"), "o_custkey").filter("a_id < b_id").select("a_id", "b_id", F.lit(1.0).alias("overlap"))
    x = M.prepared(m)
    return M.evidence(pairs, x, x).select("a_id", "b_id", "rule_similarity", F.round("date_compatibility", 9).alias("date_compatibility"), F.round("location_compatibility", 9).alias("location_compatibility"), F.round("close_delta_hours", 6).alias("close_delta_hours"), "dates_conflict", "places_conflict", "numbers_conflict", "generic_labels", "polarity_differs")


@query()
def fuzzy_candidates(spark, sf):
    """The text ratio needs Python, so this one has no SQL; tests hold it against a nested loop, and match_evidence has the rest."""
    m = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("question"), F.concat_ws(" ", "p_type", "p_brand").alias("rules"), F.timestamp_seconds(1_704_067_200 + F.col("p_size") * 7200).alias("close_time"), F.lit("Yes").alias("yes_label"), F.lit("No").alias("no_label"))
    return M.best_of(m.filter("id % 2 = 0"), m.filter("id % 2 = 1"))


_BEST = """WITH s AS (SELECT l_orderkey AS a_id, l_partkey AS b_id, max(round(l_discount * 10, 6)) AS confidence FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY confidence DESC, b_id) AS rn, lead(confidence) OVER (PARTITION BY a_id ORDER BY confidence DESC, b_id) AS nx FROM s),
b AS (SELECT *, coalesce(round(confidence - nx, 9) <= 0.04, false) AS ambiguous FROM w WHERE rn = 1)
SELECT a_id, b_id, confidence, ambiguous, n_losers FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY confidence DESC, a_id) AS rb, count(*) OVER (PARTITION BY b_id) - 1 AS n_losers FROM b) WHERE rb = 1"""


@query(_BEST)
def best_match(spark, sf):
    s = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("a_id"), F.col("l_partkey").alias("b_id")).agg(F.max(F.round(F.col("l_discount") * 10, 6)).alias("confidence"))
    return M.chosen(s)


@query("""WITH m AS (SELECT l_partkey AS market_id, sum(l_quantity) AS v, count(*) AS n, sum(l_extendedprice) AS oi FROM lineitem GROUP BY 1)
SELECT market_id, n, round(v + 2 * n + least(oi, 100000.0) * 0.01 + least(v, 100000.0) * 0.01, 6) AS activity FROM m ORDER BY round(v + 2 * n + least(oi, 100000.0) * 0.01 + least(v, 100000.0) * 0.01, 6) DESC, market_id DESC LIMIT 25""")
def market_ranking(spark, sf):
    m = _read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("market_id")).agg(F.sum("l_quantity").alias("v"), F.count("*").alias("n"), F.sum("l_extendedprice").alias("oi"))
    m = m.withColumn("activity", F.round(M.activity(F.col("v"), F.col("n"), F.col("oi"), F.col("v")), 6))
    return m.orderBy(F.desc("activity"), F.desc("market_id")).limit(25).select("market_id", "n", "activity")


@query("SELECT l_partkey AS ticker, count(*) AS trades, round(sum(l_quantity), 6) AS volume FROM lineitem GROUP BY 1")
def trade_activity(spark, sf):
    return _read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("ticker")).agg(F.count("*").alias("trades"), F.round(F.sum("l_quantity"), 6).alias("volume"))


@query("""SELECT CASE WHEN p_retailprice < 950 THEN 'low_volume' WHEN p_size > 40 THEN 'wide_spread' WHEN p_type = 'ECONOMY' THEN 'multivariate' WHEN length(p_name) < 8 THEN 'no_rules' END AS reason, count(*) AS n FROM part GROUP BY 1""")
def reject_reasons(spark, sf):
    why = F.when(F.col("p_retailprice") < 950, "low_volume").when(F.col("p_size") > 40, "wide_spread").when(F.col("p_type") == "ECONOMY", "multivariate").when(F.length("p_name") < 8, "no_rules")
    return _read(spark, sf, "part").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def _pairs(spark, sf):
    o = _read(spark, sf, "orders")
    log = F.array(F.struct(F.col("o_orderdate").cast("string").alias("at"), F.lit("propose").alias("decision")), F.struct(F.col("o_orderdate").cast("string").alias("at"), F.when(F.col("o_orderkey") % 3 == 0, "approve").otherwise("hold").alias("decision")))
    return o.select(
        F.concat(F.lit("P"), "o_orderkey").alias("pair_key"), F.concat(F.lit("A"), F.col("o_custkey")).alias("a_market"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("T"), "o_orderkey")).alias("b_token"), F.when(F.col("o_orderkey") % 8 == 0, None).otherwise(F.concat(F.lit("C"), "o_custkey")).alias("b_condition"),
        F.lit(None).cast("string").alias("b_market"), (F.col("o_orderstatus") != "P").alias("include"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("candidate").alias("status"), log.alias("decisions"),
    )


_PAIRS = """pr AS (SELECT 'P' || o_orderkey AS pair_key, 'A' || o_custkey AS a_market, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'T' || o_orderkey END AS b_token, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'C' || o_custkey END AS b_condition,
o_orderstatus <> 'P' AS include, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'candidate' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'approve' ELSE 'hold' END AS latest FROM orders)"""


@query(f"WITH {_PAIRS} SELECT pair_key, include AND status = 'approved' AND latest = 'approve' AS include_gated, latest FROM pr")
def registry_gate(spark, sf):
    return G.gated(_pairs(spark, sf)).select("pair_key", "include_gated", G.latest_decision(F.col("decisions")).alias("latest"))


@query(f"WITH {_PAIRS} SELECT * FROM (SELECT pair_key, a_market, coalesce(nullif(b_token, ''), b_condition) AS b_market, include FROM pr) WHERE b_market IS NOT NULL")
def registry_edge_pairs(spark, sf):
    return G.edge_pairs(_pairs(spark, sf))


@query(f"WITH {_PAIRS}, e AS (SELECT a_market, coalesce(nullif(b_token, ''), b_condition) AS b_market FROM pr WHERE coalesce(nullif(b_token, ''), b_condition) IS NOT NULL) SELECT DISTINCT leg, market_id FROM (SELECT 'A' AS leg, a_market AS market_id FROM e UNION ALL SELECT 'B', b_market FROM e)")
def registry_universe(spark, sf):
    return G.universe(G.edge_pairs(_pairs(spark, sf)))


@query("""WITH h AS (SELECT user_id, event_type, floor(value / 10)::BIGINT AS band, epoch_us(ts) > (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) / 2 FROM events) AS late FROM events),
o AS (SELECT DISTINCT user_id, event_type, band FROM h WHERE NOT late), n AS (SELECT DISTINCT user_id, event_type, band FROM h WHERE late)
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'retired' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def universe_diff(spark, sf):
    """The first half of the time against the second: two snapshots that together read all events."""
    e = _read(spark, sf, "events").select("user_id", "event_type", F.floor(F.col("value") / 10).alias("band"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    middle = e.agg(((F.min("t") + F.max("t")) / 2).alias("middle"))
    h = e.crossJoin(F.broadcast(middle)).withColumn("late", F.col("t") > F.col("middle"))  # one row
    of = lambda late: h.filter(F.col("late") == late).select("user_id", "event_type", "band").distinct()
    return G.changed(of(False), of(True))


@query("""SELECT c_custkey, source FROM (SELECT c_custkey, source, row_number() OVER (PARTITION BY c_custkey ORDER BY p) AS rn FROM (SELECT c_custkey, 'a' AS source, 0 AS p FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'b', 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'c', 2 FROM customer)) WHERE rn = 1""")
def priority_union(spark, sf):
    c = _read(spark, sf, "customer").select("c_custkey")
    return G.first_of([c.filter("c_custkey % 2 = 0").withColumn("source", F.lit("a")), c.filter("c_custkey % 3 = 0").withColumn("source", F.lit("b")), c.withColumn("source", F.lit("c"))], ["c_custkey"])


@query(f"WITH {_PAIRS}, ok AS (SELECT * FROM pr WHERE include AND status = 'approved' AND latest = 'approve') SELECT pair_key, a_market FROM pr WHERE pair_key NOT IN (SELECT pair_key FROM ok) AND a_market NOT IN (SELECT a_market FROM ok)")
def awaiting_approval(spark, sf):
    p = G.gated(_pairs(spark, sf))
    return G.awaiting(p, p.filter("include_gated")).select("pair_key", "a_market")


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) WHERE ((i - 20) % n + n) % n < 10")
def rotation_batch(spark, sf):
    return G.rotation(_read(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 10, 2)


@query(r"SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'))) AS t0, sha256(trim(regexp_replace(p_name || '  ' || p_type, '\s+', ' ', 'g'))) AS digest FROM part".replace("list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'))) AS t0", "array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'))), ' ') AS tokens"))
def normal_text(spark, sf):
    p = _read(spark, sf, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(T.tokens(F.concat_ws(" ", "p_name", "p_brand")))), " ").alias("tokens"), F.sha2(F.trim(F.regexp_replace(F.concat_ws("  ", "p_name", "p_type"), r"\s+", " ")), 256).alias("digest"))


def _redacted_sql(text: str) -> str:
    """The rules without lookaround, which DuckDB's patterns lack: a first character that is no bracket stands for "not done yet"."""
    names = "|".join(T.SECRET_NAMES)
    for pattern, put in (
        (r"(?s)-----BEGIN[^-]{0,64}-----.*?-----END[^-]{0,64}-----", T.REDACTED), (r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}", T.REDACTED),
        (r"(?im)^([ \t]*(?:set-)?cookie\s*:\s*).+$", rf"\1{T.REDACTED}"), (r"(?i)\b([A-Z0-9]+-ACCESS-(?:KEY|SIGNATURE)\s*[:=]\s*)(\S+)", rf"\1{T.REDACTED}"),
        (r"(?i)\b(authorization\s*[:=]\s*(?:(?:bearer|basic|token|digest)\s+)?)[^\s\[]\S*", rf"\1{T.REDACTED}"),
        (rf"""(?i)(["'']?[A-Za-z0-9_.\-]*(?:{names})[A-Za-z0-9_.\-]*["'']?\s*[:=]\s*["'']?)[^\s"'',;}}\]\[][^\s"'',;}}\]]*""", rf"\1{T.REDACTED}"),
        (r"\b[A-Za-z0-9+/]{40,}={1,2}", T.REDACTED),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


_MAIL = """(SELECT conv_id, turn, coalesce(text, '') || ' | Authorization: Bearer abc' || conv_id || ' | api_secret: s3cr3t-' || turn || ' | "password": "p' || conv_id || '"' || chr(10) || 'cookie: sid=' || conv_id || chr(10) || '0x' || repeat('ab', 20) || ' ' || repeat('7', 77) AS t FROM conversations)"""


@query(f"SELECT conv_id, turn, sha256({_redacted_sql('t')}) AS digest FROM {_MAIL}")
def redaction(spark, sf):
    """Whole conversations, each with credentials of every rule and with public ids that must stay."""
    c = _read(spark, sf, "conversations")
    text = F.concat(
        F.coalesce("text", F.lit("")), F.lit(" | Authorization: Bearer abc"), F.col("conv_id").cast("string"), F.lit(" | api_secret: s3cr3t-"), F.col("turn").cast("string"), F.lit(' | "password": "p'), F.col("conv_id").cast("string"),
        F.lit('"\ncookie: sid='), F.col("conv_id").cast("string"), F.lit("\n0x" + "ab" * 20 + " " + "7" * 77),
    )
    return c.select("conv_id", "turn", F.sha2(T.redacted(text), 256).alias("digest"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def cross_soak_membership(spark, sf):
    li, o = _read(spark, sf, "lineitem"), _read(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
