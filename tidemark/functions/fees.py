"""Fees of both venues as column expressions.

Venue A charges a multiplier x count x P x (1 - P), rounded up to the cent for each order, in exact decimal arithmetic
over the shortest text of P. Prices are taken as integers of 10^-18 and the product is split so that every intermediate
fits DECIMAL(38, 0); doubles are a cent off on some prices.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multipliers by 10^4 and the basis points of an unknown rate.
TAKER_E4, MAKER_E4, MAKER_SERIES_E4 = 700, 0, 175
FALLBACK_BPS = 1000
#: The only rounding rule there is, the hours a looked-up rate stays good, and the reason of rates that passed the check.
ROUNDING, TTL_HOURS, VERIFIED = "ceil_cent_per_order", 6.0, "public_fee_metadata_verified"
PRICE_MIN, PRICE_MAX = 0.01, 0.99


def _dec(c: Column, digits: int) -> Column:
    return c.cast(f"decimal({digits},0)")


def _number(n: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({len(str(n))},0)")


def _whole(a: Column, b: int) -> Column:
    """Exact quotient of non-negative integers, as a long."""
    return F.call_function("div", a, _number(b))


def _rest(a: Column, b: int) -> Column:
    return a % _number(b)


def order_cents(multiplier_e4: Column, price: Column, count: Column) -> Column:
    """Cents of one order, 0 < price < 1: ceil(multiplier x count x P x (1 - P) x 100)."""
    # The digits behind the point of the price's shortest text, as an integer of 10^-18.
    p = F.substring(price.cast("string").cast("decimal(20,18)").cast("string"), 3, 18).cast("long")
    x = _dec(p, 18) * _dec(F.lit(10**18) - p, 19)
    q, r = _whole(x, 10**18), _rest(x, 10**18)
    m = _dec(multiplier_e4.cast("long") * count.cast("long"), 18)
    t, u = m * _dec(q, 18), m * _dec(r, 18)
    hi, rest = _whole(t, 10**20), _rest(t, 10**20)
    over, more = _dec(rest, 21) + _dec(_whole(u, 10**18), 19), _rest(u, 10**18) > 0
    top = _number(10**20)
    extra = F.when((rest == 0) & (u == 0), 0).when((over < top) | ((over == top) & ~more), 1).otherwise(2)
    return (hi + extra).cast("long")


def rate_fee(bps: Column, price: Column, size: Column) -> Column:
    """Venue B: size x bps / 10^4 x min(P, 1 - P); an unknown or negative rate is the fallback."""
    known = F.when(bps >= 0, bps).otherwise(F.lit(FALLBACK_BPS))
    return size * (F.coalesce(known, F.lit(FALLBACK_BPS)) / 10000.0) * F.least(price, F.lit(1.0) - price)


def clamped(price: Column) -> Column:
    return F.least(F.greatest(price, F.lit(PRICE_MIN)), F.lit(PRICE_MAX))


def leg_a_fee(multiplier_e4: Column, price: Column, size: Column) -> Column:
    """Dollars for a possibly fractional size: whole contracts are charged."""
    count = F.greatest(F.lit(1), F.ceil(size)).cast("long")
    return order_cents(multiplier_e4, clamped(price), count) / 100.0


def round_trip(multiplier_e4: Column, bps: Column, price_a: Column, price_b: Column, size: Column) -> Column:
    """Taker fees of both legs."""
    return leg_a_fee(multiplier_e4, price_a, size) + rate_fee(bps, clamped(price_b), size)


def round_trip_per_unit(multiplier_e4: Column, bps: Column, price_a: Column, price_b: Column, size: Column) -> Column:
    """What one more unit costs in taker fees at the prices of a depth chunk of `size` units.

    The rate of venue B is that of the recorded token for both directions: min(P, 1 - P) is the same for its complement.
    """
    return round_trip(multiplier_e4, bps, price_a, price_b, size) / size


@dataclass(frozen=True)
class Schedule:
    """Multipliers of venue A by 10^4; overrides (series or dashed ticker prefix, taker, maker) in order, the first that fits wins."""

    taker_e4: int = TAKER_E4
    maker_e4: int = MAKER_E4
    overrides: tuple[tuple[str, int, int], ...] = ()
    rounding: str = ROUNDING
    source_urls: tuple[str, ...] = ("recorded",)

    def __post_init__(self) -> None:
        if self.taker_e4 <= 0:
            raise ValueError("the general taker multiplier must be above 0")
        if self.rounding != ROUNDING:
            raise ValueError(f"unsupported rounding {self.rounding!r}")
        if not self.source_urls:
            raise ValueError("a schedule needs its sources")

    @staticmethod
    def load(document: dict) -> "Schedule":
        """A schedule document: general (taker_multiplier, maker_multiplier, rounding), series_overrides, source_urls.

        An override without a taker fee is an error.
        """
        e4 = lambda x: int((Decimal(str(x)) * 10_000).to_integral_exact())
        general, own = document["general"], document.get("series_overrides") or {}
        overrides = tuple((str(k), e4(v["taker_multiplier"]), e4(v.get("maker_multiplier", 0))) for k, v in own.items())
        if any(t <= 0 for _, t, _ in overrides):
            raise ValueError("an override pins a zero fee")
        return Schedule(e4(general["taker_multiplier"]), e4(general["maker_multiplier"]), overrides, str(general.get("rounding", "")), tuple(document.get("source_urls") or ()))


def multipliers(ticker: Column, schedule: Schedule) -> Column:
    """Struct (taker_e4, maker_e4) for a ticker SERIES-EVENT-STRIKE. A schedule has few rules, so they are one expression."""
    of = lambda t, m: F.struct(F.lit(t).cast("int").alias("taker_e4"), F.lit(m).cast("int").alias("maker_e4"))
    out = None
    for key, taker, maker in schedule.overrides:
        fits = (ticker == key) | ticker.startswith(key + "-") if "-" in key else F.element_at(F.split(ticker, "-"), 1) == key
        out = F.when(fits, of(taker, maker)) if out is None else out.when(fits, of(taker, maker))
    plain = of(schedule.taker_e4, schedule.maker_e4)
    return plain if out is None else out.otherwise(plain)


def cross_checked(rows: DataFrame) -> DataFrame:
    """Adds reason, verified and fee_rate: venue B's two endpoints must agree, anything else fails closed.

    rows: market_ok and rate_ok (whether each endpoint answered), base_fee, taker_fee and curve_rate as text.
    """
    b, r = F.col("base_fee").try_cast("int"), F.col("curve_rate").try_cast("double")
    t = F.coalesce(F.col("taker_fee").try_cast("int"), b)
    reason = (
        F.when(~F.col("market_ok"), "market_info_unavailable").when(~F.col("rate_ok"), "fee_rate_unavailable").when(b.isNull(), "invalid_fee_payload").when((b < 0) | (t < 0), "negative_fee_metadata")
        .when(b != t, "fee_endpoint_mismatch").when((b != 0) & (F.coalesce(r, F.lit(0.0)) <= 0), "missing_fee_curve_rate").otherwise(VERIFIED)
    )
    out = rows.withColumn("reason", reason).withColumn("verified", F.col("reason") == VERIFIED)
    return out.withColumn("fee_rate", F.when(F.col("verified"), F.when(b == 0, 0.0).otherwise(r)))


def recorded_rate(rates: DataFrame, key: str, asked_at: str, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """rates (key, asked_at in seconds, base_fee as text) with bps: the lookup's own answer, or the last good one within
    the time to live, or the fallback. Failures are not remembered."""
    fresh = F.when(F.col("base_fee").try_cast("int") >= 0, F.struct(F.col(asked_at).alias("at"), F.col("base_fee").try_cast("int").alias("bps")))
    before = Window.partitionBy(key).orderBy(asked_at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(fresh, ignorenulls=True).over(before)
    live = F.col(asked_at) - F.col("_last.at") < ttl_hours * 3600
    return rates.withColumn("_last", last).withColumn("bps", F.when(live, F.col("_last.bps")).otherwise(FALLBACK_BPS)).withColumn("source", F.when(live, "api").otherwise("fallback")).drop("_last")


def override_columns(raw_edge: Column, multiplier_e4: Column, bps: Column, price_a: Column, price_b: Column, target: Column, version: str) -> dict[str, Column]:
    """Columns of an edge under real fees: the edge after them, their model's version and dollars at the target size."""
    unit = round_trip_per_unit(multiplier_e4, bps, price_a, price_b, target)
    return {"fee_adj_edge": raw_edge - unit, "fee_model_version": F.lit(version), "fee_usd_at_target": unit * target}
