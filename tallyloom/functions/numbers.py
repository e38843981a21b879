"""Rounding, unit economics and geography as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.8
ROAD_FACTOR = 1.3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use names it, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^k + 0.5) / 10^k: halves go up, toward positive infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def r2(x: Column) -> Column:
    return round_half_up(x, 2)


def r4(x: Column) -> Column:
    return round_half_up(x, 4)


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def positive(x: Column) -> Column:
    return F.coalesce(finite(x) & (x > 0), F.lit(False))


def per_gram(price: Column, grams: Column) -> Column:
    return F.when(price.isNotNull() & (grams > 0), r2(price / grams))


def per_item(price: Column, pack: Column) -> Column:
    return F.when(price.isNotNull() & (pack > 0), r2(price / pack))


def approx_equal(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) <= tolerance), F.lit(False))


def price_of_record(special: Column, base: Column) -> Column:
    """The special price where there is one, zero included; else the base price."""
    return F.coalesce(special, base)


def spread(low: Column, high: Column) -> Column:
    return r2(high - low)


def spread_share(low: Column, high: Column) -> Column:
    return r2((high - low) / low)


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    d = F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return F.when(finite(lat1) & finite(lng1) & finite(lat2) & finite(lng2), d)


def road_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_miles(lat1, lng1, lat2, lng2) * ROAD_FACTOR


def round_trip_gas_cost(miles: Column, gas_price: Column, mpg: Column) -> Column:
    cost = miles * 2 * (gas_price / mpg)
    return F.when(positive(miles) & positive(gas_price) & positive(mpg) & finite(cost), cost)


def drop_percent(share: Column) -> Column:
    return F.floor(F.abs(share) * 100 + 0.5)


def discount_tier(pct: Column) -> Column:
    return F.when(pct >= 30, "high").when(pct >= 15, "mid").when(pct > 0, "low")


def multiple_phrase(share: Column) -> Column:
    """1 + share as "N.N×" from a tenth up, else a whole percentage."""
    return F.when(share >= 0.1, F.concat(F.replace(F.format_number(1 + share, 1), F.lit(","), F.lit("")), F.lit("×"))).otherwise(
        F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))
    )


def usd(x: Column) -> Column:
    """Dollars and cents without thousands separators."""
    return F.concat(F.lit("$"), F.format_string("%.2f", x))
