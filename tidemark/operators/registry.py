"""Registry dimension: identifiers, deny-by-default gate, sources in order of priority, universes and their changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = "pair_key string, a_market string, b_token string, b_condition string, b_market string, include boolean, status string, decisions array<struct<at:string,decision:string>>"


def identifier(*names: str) -> Column:
    """The first identifier that is there and not empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def latest_decision(log: Column) -> Column:
    return F.try_element_at(log, F.lit(-1))["decision"]


def gated(pairs: DataFrame) -> DataFrame:
    """include_gated: the flag, an approved status and a latest decision that approves; anything missing denies."""
    ok = F.col("include") & F.col("status").isin("approved", "strategy_eligible") & (latest_decision(F.col("decisions")) == "approve")
    return pairs.withColumn("include_gated", F.coalesce(ok, F.lit(False)))


def edge_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_key, a_market, b_market, include); pairs without one of the legs go."""
    out = pairs.select("pair_key", F.nullif(F.col("a_market"), F.lit("")).alias("a_market"), identifier("b_token", "b_condition", "b_market").alias("b_market"), "include")
    return out.filter("a_market IS NOT NULL AND b_market IS NOT NULL")


def universe(pairs: DataFrame) -> DataFrame:
    """Distinct (leg, market_id)."""
    return pairs.select(F.explode(F.array(F.struct(F.lit("A").alias("leg"), F.col("a_market").alias("market_id")), F.struct(F.lit("B").alias("leg"), F.col("b_market").alias("market_id")))).alias("x")).select("x.*").filter("market_id IS NOT NULL").distinct()


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and retired between two universes of the same columns."""
    return new.subtract(old).withColumn("change", F.lit("added")).unionByName(old.subtract(new).withColumn("change", F.lit("retired")))


def first_of(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of sources in order of priority: of rows with the same key the first source's stays."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("_p", F.lit(k)) for k, s in enumerate(sources)))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("_p"))).filter("_rn = 1").drop("_rn", "_p")


def awaiting(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """Candidates approved neither by pair key nor by the market of leg A."""
    return candidates.join(approved.select("pair_key"), "pair_key", "left_anti").join(approved.select("a_market"), "a_market", "left_anti")


def prescreen(question: Column, rules: Column, close_a: Column, close_b: Column, now: Column) -> Column:
    """Sorted warning flags of a candidate."""
    text = F.lower(F.concat_ws(" ", question, rules))
    far = F.abs(F.unix_micros(close_a) - F.unix_micros(close_b)) > 3_600_000_000
    late = F.unix_micros(F.least(close_a, close_b)) - F.unix_micros(now) > 90 * 86_400_000_000
    flags = F.array(F.when(text.contains("before") | text.contains("by the end"), "deadline"), F.when(text.contains("range") | text.contains("between"), "range"), F.when(far, "cutoff_mismatch"), F.when(late, "long_dated"))
    return F.array_compact(flags)


def rotation(markets: DataFrame, order: str, batch: int, tick: int) -> DataFrame:
    """The batch of a tick in round-robin order with wrap-around.

    Numbering a registry takes one ordered pass; the registry is a small dimension.
    """
    rows = markets.withColumns({"_i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return rows.filter(F.pmod(F.col("_i") - F.lit(tick * batch), F.col("_n")) < batch).drop("_i", "_n")
