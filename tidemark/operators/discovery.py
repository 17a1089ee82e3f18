"""Market discovery: raw pages to normal markets with an ordered reason for each that is turned away, ranks and indexes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.matching import activity


@dataclass(frozen=True)
class Filters:
    min_volume_24h: float = 1.0
    min_total_volume: float = 1.0
    min_depth: float = 1.0
    max_spread: float = 0.25
    require_rules: bool = True
    require_two_sided: bool = False
    exclude_multivariate: bool = True

    def __post_init__(self) -> None:
        if min(self.min_volume_24h, self.min_total_volume, self.min_depth) < 0:
            raise ValueError("minimums cannot be negative")
        if not 0 <= self.max_spread <= 1:
            raise ValueError("max_spread must be between 0 and 1")


#: Shortest question and rules that count as clear, and the prefix of multivariate tickers of venue A.
QUESTION, RULES = 8, 20
LEVEL = "array<struct<price:double,size:double>>"


def number(c: str) -> Column:
    return F.coalesce(T.strict_number(F.col(c).cast("string")), F.lit(0.0))


def price(c: Column) -> Column:
    """A price strictly between 0 and 1, else null."""
    x = T.strict_number(c.cast("string"))
    return F.when((x > 0) & (x < 1), x)


def spread(bid: Column, ask: Column) -> Column:
    """Ask less bid; null unless both are there and the book is not crossed."""
    return F.when(ask >= bid, F.round(ask - bid, 10))


def joined(*parts: str) -> Column:
    """Trimmed texts on lines of their own, empty ones left out."""
    texts = F.array(*(F.trim(F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in parts))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def depth(levels: str | Column) -> Column:
    """Sum of the sizes of a ladder."""
    x = F.col(levels) if isinstance(levels, str) else levels
    return F.coalesce(F.aggregate(x, F.lit(0.0), lambda n, l: n + F.coalesce(l["size"], F.lit(0.0))), F.lit(0.0))


def book_metrics(bids: Column, asks: Column) -> Column:
    """Struct of best bid, best ask and ask depth; levels without a price between 0 and 1 or without size do not count."""
    good = lambda x: F.filter(x, lambda l: (l["price"] > 0) & (l["price"] < 1) & (l["size"] > 0))
    prices = lambda x: F.transform(good(x), lambda l: l["price"])
    return F.struct(F.array_max(prices(bids)).alias("best_bid"), F.array_min(prices(asks)).alias("best_ask"), depth(good(asks)).alias("ask_depth"))


def _thin(f: Filters) -> Column:
    yes, no = F.col("yes_depth"), F.col("no_depth")
    return ((yes < f.min_depth) | (no < f.min_depth)) if f.require_two_sided else F.greatest(yes, no) < f.min_depth


def _reasons(f: Filters, now: Column, open_: Column, ids: Column, more: list[tuple[Column, str]]) -> Column:
    """The first reason against a market, in order; null for an accepted one."""
    c = F.col
    out = F.when(~ids, "missing_identifiers").when(~open_, "not_open").when(c("close_time").isNull() | (c("close_time") <= now), "stale_or_expired")
    if f.exclude_multivariate:
        out = out.when(c("is_multivariate"), "multivariate")
    out = out.when(F.length("question") < QUESTION, "unclear_question")
    if f.require_rules:
        out = out.when(F.length("rules") < RULES, "unclear_rules")
    for when, name in more:
        out = out.when(when, name)
    return (
        out.when(c("volume_24h") < f.min_volume_24h, "low_24h_volume").when(c("volume_total") < f.min_total_volume, "low_total_volume")
        .when(c("spread").isNull(), "empty_quotes").when(c("spread") > f.max_spread, "wide_spread").when(_thin(f), "insufficient_depth")
    )


MARKET = (
    "market_id", "event_id", "series_id", "slug", "question", "yes_label", "no_label", "close_time", "rules", "volume_24h", "volume_total", "open_interest", "liquidity", "spread",
    "best_yes_bid", "best_yes_ask", "best_no_bid", "best_no_ask", "yes_depth", "no_depth", "is_multivariate", "recent_trade_count", "recent_trade_volume",
)


def venue_a(raw: DataFrame, trades: DataFrame, now: Column, f: Filters = Filters()) -> DataFrame:
    """MARKET and reject_reason for records of venue A.

    raw: ticker, event_ticker, title, yes_sub_title, no_sub_title, status, close_time, rules_primary, rules_secondary,
    mve (whether the record names legs), volume_24h, volume, open_interest, the four best prices and sizes. trades:
    (ticker, trades, volume). Absent texts are empty, absent numbers 0.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = raw.join(trades.select(F.col("ticker").alias("_t"), "trades", F.col("volume").alias("_v")), F.col("ticker") == F.col("_t"), "left")
    bids = {k: price(F.col(k)) for k in ("yes_bid", "yes_ask", "no_bid", "no_ask")}
    rows = rows.select(
        text("ticker").alias("market_id"), text("event_ticker").alias("event_id"), F.element_at(F.split(text("event_ticker"), "-"), 1).alias("series_id"), F.lower(text("ticker")).alias("slug"),
        F.coalesce(F.nullif(text("title"), F.lit("")), text("yes_sub_title")).alias("question"), F.coalesce(F.nullif(F.col("yes_sub_title"), F.lit("")), F.lit("Yes")).alias("yes_label"),
        F.coalesce(F.nullif(F.col("no_sub_title"), F.lit("")), F.lit("No")).alias("no_label"), F.col("close_time"), joined("rules_primary", "rules_secondary").alias("rules"),
        number("volume_24h").alias("volume_24h"), number("volume").alias("volume_total"), number("open_interest").alias("open_interest"), F.lit(0.0).alias("liquidity"),
        F.least(spread(bids["yes_bid"], bids["yes_ask"]), spread(bids["no_bid"], bids["no_ask"])).alias("spread"), *(bids[k].alias(f"best_{k}") for k in bids),
        number("yes_ask_size").alias("yes_depth"), number("no_ask_size").alias("no_depth"), (F.coalesce("mve", F.lit(False)) | F.coalesce(F.col("ticker").startswith("KXMVE"), F.lit(False))).alias("is_multivariate"),
        F.coalesce("trades", F.lit(0)).cast("long").alias("recent_trade_count"), F.coalesce("_v", F.lit(0.0)).alias("recent_trade_volume"), F.lower(F.coalesce("status", F.lit(""))).alias("_status"),
    )
    ids = (F.col("market_id") != "") & (F.col("event_id") != "")
    return rows.select(*MARKET, _reasons(f, now, F.col("_status").isin("active", "open"), ids, []).alias("reject_reason"))


def venue_b(events: DataFrame, now: Column, f: Filters = Filters()) -> DataFrame:
    """MARKET, the two token ids and reject_reason for events of venue B with their markets.

    events: id, slug, series, end_date, neg_risk, markets: an array of structs (condition_id, slug, question, active,
    closed, accepting, end_date, description, source, neg_risk, outcomes and tokens as JSON text, book, volume_24h,
    volume, liquidity, open_interest, best_bid, best_ask, yes_depth, no_depth).
    """
    rows = events.select(F.col("id").alias("e_id"), F.col("slug").alias("e_slug"), "series", F.col("end_date").alias("e_end"), F.col("neg_risk").alias("e_neg"), F.explode("markets").alias("m")).select("e_id", "e_slug", "series", "e_end", "e_neg", "m.*")
    text = lambda *cs: F.trim(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in cs), F.lit("")))
    listed = lambda c: F.from_json(c, "array<string>")
    bid, ask = price(F.col("best_bid")), price(F.col("best_ask"))
    rows = rows.select(
        text("condition_id").alias("market_id"), text("e_id", "e_slug").alias("event_id"), text("series").alias("series_id"), text("slug").alias("slug"), text("question").alias("question"), listed("outcomes").alias("_outcomes"),
        listed("tokens").alias("_tokens"), F.coalesce("end_date", "e_end").alias("close_time"), joined("description", "source").alias("rules"), number("volume_24h").alias("volume_24h"), number("volume").alias("volume_total"),
        number("open_interest").alias("open_interest"), number("liquidity").alias("liquidity"), spread(bid, ask).alias("spread"), bid.alias("best_yes_bid"), ask.alias("best_yes_ask"),
        F.round(1 - ask, 10).alias("best_no_bid"), F.round(1 - bid, 10).alias("best_no_ask"), number("yes_depth").alias("yes_depth"), number("no_depth").alias("no_depth"),
        (F.coalesce("neg_risk", F.lit(False)) | F.coalesce("e_neg", F.lit(False))).alias("is_multivariate"), F.lit(0).cast("long").alias("recent_trade_count"), F.lit(0.0).alias("recent_trade_volume"),
        (F.coalesce("active", F.lit(False)) & ~F.coalesce("closed", F.lit(False)) & F.coalesce("accepting", F.lit(False))).alias("_open"), F.coalesce("book", F.lit(False)).alias("_book"),
    )
    two = F.coalesce((F.size("_tokens") == 2) & F.forall("_tokens", lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(False))
    yes_no = F.coalesce(F.transform("_outcomes", F.lower) == F.array(F.lit("yes"), F.lit("no")), F.lit(False))
    rows = rows.withColumns({"yes_label": F.get("_outcomes", F.lit(0)), "no_label": F.get("_outcomes", F.lit(1)), "yes_token_id": F.get("_tokens", F.lit(0)), "no_token_id": F.get("_tokens", F.lit(1))})
    ids = (F.col("market_id") != "") & (F.col("event_id") != "") & (F.col("slug") != "")
    more = [(~yes_no, "unsupported_outcomes"), (~two, "missing_token_ids"), (~F.col("_book"), "orderbook_disabled")]
    return rows.select(*MARKET, "yes_token_id", "no_token_id", _reasons(f, now, F.col("_open"), ids, more).alias("reject_reason"))


def histogram(rows: DataFrame) -> DataFrame:
    """(reason, n) of those turned away."""
    return rows.filter("reject_reason IS NOT NULL").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


def ranked(rows: DataFrame) -> DataFrame:
    """Accepted markets with activity, the most active first, ties by volumes and id."""
    score = activity(F.col("volume_24h"), F.col("recent_trade_volume"), F.col("open_interest"), F.col("liquidity"))
    out = rows.filter("reject_reason IS NULL").withColumn("activity", F.round(score, 6))
    return out.orderBy(F.desc("activity"), F.desc("volume_24h"), F.desc("volume_total"), F.desc("market_id"))


def universe(found: DataFrame, most: int, least_activity: float = 0.0) -> DataFrame:
    """The `most` active distinct (venue, market_id) with at least that activity: of repeats the most active counts."""
    own = Window.partitionBy("venue", "market_id").orderBy(F.desc("activity"))
    rows = found.filter(F.col("activity") >= least_activity).withColumn("_rn", F.row_number().over(own)).filter("_rn = 1")
    return rows.orderBy(F.desc("activity"), "venue", "market_id").limit(most).select("venue", "market_id", "activity")


def listed(spark: SparkSession, items: list[tuple[str, str]]) -> DataFrame:
    """A universe from an explicit list of (venue, market_id)."""
    return spark.createDataFrame(items, "venue string, market_id string").distinct()


def index(records: DataFrame, order: str) -> DataFrame:
    """One record for each market_id that is there: the last in the given order."""
    kept = records.filter(F.coalesce("market_id", F.lit("")) != "")
    return kept.groupBy("market_id").agg(F.max_by(F.struct(*(c for c in records.columns if c != "market_id")), order).alias("_x")).select("market_id", "_x.*")


def exact(records: DataFrame, keys: DataFrame, by: str, limit: int) -> DataFrame:
    """Records of the wanted series or events, one for each market_id, `limit` of them in the order of the id."""
    return records.join(keys.select(by).distinct(), by, "left_semi").dropDuplicates(["market_id"]).orderBy("market_id").limit(limit)


def pages(fetch: Callable[[str | None], tuple[list[dict], str]], most: int) -> list[dict]:
    """Records of pages that name the next by a cursor; a cursor that comes again is an error. Reading pages is the driver's."""
    out, cursor, seen = [], None, set()
    for _ in range(most):
        records, cursor = fetch(cursor)
        out += records
        if not cursor:
            break
        if cursor in seen:
            raise ValueError("pagination cursor repeated")
        seen.add(cursor)
    return out


def offset_pages(fetch: Callable[[int], list[dict]], size: int, most: int) -> list[dict]:
    """Records of pages by offset, up to the first that is not full."""
    out: list[dict] = []
    for k in range(most):
        records = fetch(k * size)
        out += records
        if len(records) < size:
            break
    return out
