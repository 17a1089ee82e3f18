"""Book rows: payloads, ladders, freshness, the swap of mislabelled sides, and rebuilding from deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import tiles
from tidemark.sources.bridge import LEVELS

#: Sequence numbers in a tile.
SEQUENCES = 1_000_000
LADDER = "array<struct<price:double,size:double>>"


def best(ladder: Column) -> Column:
    return F.get(ladder, F.lit(0))["price"]


def ladder(raw: Column, descending: bool = True) -> Column:
    """Levels with 0 < price < 1 and size > 0 (prices over 1 are cents), in order of price."""
    level = lambda x: F.struct(F.when(x["price"] > 1, x["price"] / 100).otherwise(x["price"]).alias("price"), x["size"].alias("size"))
    ok = F.filter(F.transform(raw, level), lambda x: (x["price"] > 0) & (x["price"] < 1) & (x["size"] > 0))
    return F.sort_array(ok, asc=not descending)


def complement(levels: Column) -> Column:
    """Bids of one outcome as asks of the other, at 1 - price to ten places."""
    return F.transform(levels, lambda x: F.struct(F.round(1 - x["price"], 10).alias("price"), x["size"].alias("size")))


def observation(books: DataFrame) -> DataFrame:
    """bids and asks ladders flattened: best quotes, mid, spread, top levels and a JSON payload; other columns stay."""
    b, a = best(F.col("bids")), best(F.col("asks"))
    flat = [F.get(F.col(side), F.lit(i))[f].alias(f"{name}_{short}_{i + 1}") for side, name in (("bids", "bid"), ("asks", "ask")) for i in range(LEVELS) for f, short in (("price", "px"), ("size", "sz"))]
    return books.select("*", b.alias("best_bid"), a.alias("best_ask"), ((b + a) / 2).alias("mid"), (a - b).alias("spread"), *flat, F.to_json(F.struct("bids", "asks")).alias("book_json"))


def two_sided(books: DataFrame) -> DataFrame:
    """Books with both sides, and the explicit empty book; one-sided ones are rejected."""
    n, m = F.size("bids"), F.size("asks")
    return books.filter(((n > 0) & (m > 0)) | ((n == 0) & (m == 0)))


def unswapped(rows: DataFrame) -> DataFrame:
    """Bid and ask columns exchanged where they cross; every row is stamped, and doing it again changes nothing."""
    crossed = F.coalesce(F.col("best_bid") > F.col("best_ask"), F.lit(False))
    names = [("best_bid", "best_ask"), *((f"bid_{f}_{i}", f"ask_{f}_{i}") for f in ("px", "sz") for i in range(1, LEVELS + 1))]
    new = {x: F.when(crossed, F.col(y)).otherwise(F.col(x)) for b, a in names for x, y in ((b, a), (a, b))}
    out = rows.withColumns(new | {"legacy_book_fix": F.lit(True)})
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def freshness(capture_ts: Column, venue_ts: Column, bid: Column, ask: Column, threshold: float = P.FRESH_SECONDS) -> tuple[Column, Column]:
    """(staleness in seconds, status): missing book, missing stamp, stale (over the threshold) or fresh."""
    age = (F.unix_micros(capture_ts) - F.unix_micros(venue_ts)) / 1e6
    status = F.when(bid.isNull() & ask.isNull(), "missing_book").when(age.isNull(), "missing_venue_timestamp").when(age > threshold, "stale").otherwise("fresh")
    return age, status


def worst(a: Column, b: Column) -> Column:
    """The worse of two freshness labels."""
    order = ("missing_book", "missing_venue_timestamp", "stale", "fresh")
    out = F.lit("unknown")
    for name in reversed(order):
        out = F.when((a == name) | (b == name), name).otherwise(out)
    return out


def gaps(rows: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Adds gap (seq is not the one before plus 1) and epoch (gaps so far): books of another epoch are invalid."""
    out = tiles.previous(tiles.tiled(rows, by, F.col(seq), SEQUENCES), by, [seq], {"_seq": F.col(seq)})
    out = out.withColumn("gap", F.coalesce(F.col(seq) != F.col("_seq") + 1, F.lit(False)))
    return tiles.running(out, by, [seq], {"epoch": F.col("gap").cast("int")}).drop("_seq", "_tile")


def last_written(changes: DataFrame, by: list[str], price: str, size: str, seq: str) -> DataFrame:
    """Book levels from last-write-wins changes: the last size at each price, gone where it is 0."""
    return changes.groupBy(*by, price).agg(F.max_by(size, seq).alias(size)).filter(F.col(size) > 0)


def summed(deltas: DataFrame, by: list[str], price: str, delta: str, seq: str) -> DataFrame:
    """Book levels from additive deltas, a level being removed (and starting from 0 again) whenever it falls to 0 or less.

    Clamped running sum without a fold: the size is the running sum less its least value so far (at most 0).
    """
    w = Window.partitionBy(*by, price).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    running = deltas.withColumn("_s", F.sum(delta).over(w))
    out = running.groupBy(*by, price).agg((F.max_by("_s", seq) - F.least(F.lit(0.0), F.min("_s"))).alias("size"))
    return out.filter("size > 0")


def latest_rows(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """W2: one row for each key, that with the earliest `at`."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), at).alias("_x")).select("_x.*")
