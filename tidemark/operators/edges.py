"""Edges of paired quotes: two directions a match, depth walked over both ladders, fees, freshness and skew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import align
from tidemark.sources.bridge import LEVELS


def both_fresh(a: Column, b: Column) -> Column:
    """False if any side is bad, true if both are fresh, else null."""
    bad = F.array(F.lit("stale"), F.lit("missing_venue_timestamp"), F.lit("missing_book"))
    either = F.coalesce(F.array_contains(bad, a), F.lit(False)) | F.coalesce(F.array_contains(bad, b), F.lit(False))
    return F.when(either, F.lit(False)).when((a == "fresh") & (b == "fresh"), F.lit(True))


def _ladder(side: str, book: str, name: str) -> list[str]:
    """SQL of price and cumulative size of each level; a level without price or size has no width."""
    out, widths = [], []
    for i in range(1, LEVELS + 1):
        px, sz = f"{book}.{side}_px_{i}", f"{book}.{side}_sz_{i}"
        widths.append(f"CASE WHEN {px} IS NOT NULL AND {sz} > 0 THEN {sz} ELSE 0D END")
        out += [f"coalesce({px if side == 'ask' else f'1D - {px}'}, 0D) AS {name}p{i}", f"{' + '.join(widths)} AS {name}h{i}"]
    return out


def _overlaps() -> str:
    """SQL of the 5 x 5 overlaps (lo, hi, both prices) of two ladders seen as cumulative intervals."""
    at = lambda name, i: f"d.{name}{i}" if i else "0D"
    pairs = [(i, j) for i in range(1, LEVELS + 1) for j in range(1, LEVELS + 1)]
    return ", ".join(f"struct(greatest({at('ah', i - 1)}, {at('bh', j - 1)}) AS lo, least({at('ah', i)}, {at('bh', j)}) AS hi, {at('ap', i)} AS pa, {at('bp', j)} AS pb)" for i, j in pairs)


def _summed(f) -> Column:
    return F.aggregate("chunks", F.lit(0.0), lambda n, c: n + f(c))


def depth(rows: DataFrame, fee: float | Callable[[Column], Column], target: float) -> DataFrame:
    """Adds filled, cost_a, cost_b (up to the target) and max_profitable_size (all profitable overlaps, not a prefix).

    fee: a flat one, or what a unit of an overlap (lo, hi, pa, pb) costs at its prices.
    """
    cost = fee if callable(fee) else lambda c: F.lit(fee)
    chunks = F.expr(f"filter(array({_overlaps()}), c -> c.hi - c.lo > {P.EPS:.20f})")
    taken = lambda c: F.greatest(F.lit(0.0), F.least(c["hi"], F.lit(target)) - c["lo"])
    out = rows.withColumn("chunks", chunks)
    good = _summed(lambda c: F.when(F.lit(1.0) - (c["pa"] + c["pb"]) - cost(c) > 0, c["hi"] - c["lo"]).otherwise(0.0))
    return out.select("*", _summed(taken).alias("filled"), _summed(lambda c: taken(c) * c["pa"]).alias("cost_a"), _summed(lambda c: taken(c) * c["pb"]).alias("cost_b"), good.alias("max_profitable_size")).drop("chunks")


def matches(books: DataFrame, pairs: DataFrame, tolerance: int = P.MATCH_TOLERANCE_NS) -> DataFrame:
    """Quotes of leg A with the nearest quote of leg B of the same pair: pair columns, l and r. The registry is small."""
    of = lambda leg, key: books.filter(F.col("leg") == leg).join(pairs.select("pair_key", F.col(key).alias("_m"), "include"), F.col("market_id") == F.col("_m")).drop("_m")
    return align.nearest(of("A", "a_market"), of("B", "b_market"), ["pair_key"], "recv_ns", tolerance, "capture_seq")


def derive(matched: DataFrame, fee: float = P.FLAT_FEE, target: float = 1.0) -> DataFrame:
    """One row for each match and direction whose two quotes exist."""
    base = [
        F.col("l.pair_key").alias("pair_key"), F.col("l.capture_ts").alias("capture_ts"), F.col("l.recv_ns").alias("recv_ns"), F.col("l.capture_seq").alias("a_seq"), F.col("r.capture_seq").alias("b_seq"),
        F.greatest("l.capture_seq", "r.capture_seq").cast("double").alias("source_seq"), ((F.col("l.recv_ns") - F.col("r.recv_ns")) / 1e6).alias("skew_ms"),
        F.col("l.status").alias("a_status"), F.col("r.status").alias("b_status"), F.greatest("l.staleness_s", "r.staleness_s").alias("max_staleness_s"), both_fresh(F.col("l.status"), F.col("r.status")).alias("books_fresh"), F.col("l.include").alias("include"),
    ]
    sides = (("a_yes_b_no", "ask", "bid", "r.best_bid - l.best_ask"), ("a_no_b_yes", "bid", "ask", "l.best_bid - r.best_ask"))
    rows = [f"struct('{name}' AS direction, {raw} AS raw_edge, {', '.join(_ladder(sa, 'l', 'a') + _ladder(sb, 'r', 'b'))})" for name, sa, sb, raw in sides]
    out = matched.select(*base, F.expr(f"explode(array({', '.join(rows)}))").alias("d")).filter("d.raw_edge IS NOT NULL")
    kept = [c for c in out.columns if c != "d"]
    out = depth(out, fee, target)
    vwap = F.when(F.col("filled") > 0, (F.col("cost_a") + F.col("cost_b")) / F.col("filled"))
    share = lambda c: F.when(F.col("filled") > 0, F.col(c) / F.col("filled"))
    return out.select(
        *kept, F.col("d.direction").alias("direction"), F.col("d.raw_edge").alias("raw_edge"), (F.col("d.raw_edge") - fee).alias("fee_adj_edge"), F.lit(target).alias("target_size"),
        F.col("filled").alias("depth_fillable_size"), (F.col("filled") + P.EPS >= target).alias("depth_complete"), vwap.alias("vwap"), share("cost_a").alias("a_vwap"), share("cost_b").alias("b_vwap"),
        (F.col("d.raw_edge") - (1.0 - vwap)).alias("slippage"), (1.0 - vwap - fee).alias("depth_adj_edge"), "max_profitable_size",
    )


def qualifies(g: P.Gate = P.Gate(), shift: float | Column = 0.0) -> Column:
    """The practical-edge gate; anything missing fails. `shift` moves both edges, for fee sweeps."""
    s = shift if isinstance(shift, Column) else F.lit(shift)
    ok = F.col("books_fresh") & (F.abs("skew_ms") < g.max_skew_ms) & (F.round(F.col("fee_adj_edge") + s, 9) >= g.min_edge) & (F.round(F.col("depth_adj_edge") + s, 9) >= g.min_edge) & (F.coalesce("max_profitable_size", F.lit(0.0)) >= g.min_fill)
    return F.coalesce(ok, F.lit(False))


def executable(x: P.Executable = P.Executable(), snapshots: Column | None = None) -> Column:
    """Depth edge less a penalty for age, or null where the row can't be trusted."""
    ok = F.col("books_fresh") & (F.abs("skew_ms") <= x.max_skew_ms)
    if snapshots is not None:
        ok &= F.coalesce(snapshots >= x.min_snapshots, F.lit(True))
    age = F.greatest(F.coalesce("max_staleness_s", F.lit(0.0)), F.lit(0.0))
    return F.when(F.coalesce(ok, F.lit(False)), F.col("depth_adj_edge") - x.staleness_penalty * age)


def expected_fill(x: P.Executable = P.Executable()) -> Column:
    return F.lit(x.depth_haircut) * F.greatest(F.coalesce("max_profitable_size", F.lit(0.0)), F.lit(0.0))
