"""Scalar feature expressions: dates, hours, amounts, bins, listing scores,
rule points and risk levels.  Each returns a ``Column``; none needs Python
at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ColumnOrName, _col, finite_or_null, to_numeric

# ---------------------------------------------------------------- dates


def weekday(ts: ColumnOrName) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(ts))


def is_weekend(dow: ColumnOrName) -> Column:
    return _col(dow).isin(5, 6).cast("int")


def date_plus_hours(date: ColumnOrName, hours: ColumnOrName) -> Column:
    """date (or timestamp) + N hours, as timestamp_ntz."""
    base = _col(date).cast("timestamp_ntz")
    h = _col(hours).cast("int")
    return base + F.make_dt_interval(F.lit(0), h, F.lit(0), F.lit(0))


def day_name(ts: ColumnOrName) -> Column:
    return F.date_format(_col(ts), "EEEE")


# ---------------------------------------------------------------- hours


def clipped_hour(hour: ColumnOrName) -> Column:
    """null/unparsable -> -1, truncate to int, then clip to 0..23."""
    h = F.coalesce(finite_or_null(hour), F.lit(-1.0)).cast("int")
    return F.least(F.greatest(h, F.lit(0)), F.lit(23))


def hour_sin(hour: ColumnOrName) -> Column:
    return F.sin(F.lit(2 * math.pi) * clipped_hour(hour) / F.lit(24.0))


def hour_cos(hour: ColumnOrName) -> Column:
    return F.cos(F.lit(2 * math.pi) * clipped_hour(hour) / F.lit(24.0))


def is_night(hour: ColumnOrName) -> Column:
    h = clipped_hour(hour)
    return ((h <= 6) | (h >= 22)).cast("int")


# ---------------------------------------------------------------- amounts


def log_amount(amount: ColumnOrName, clip_at_zero: bool = True) -> Column:
    x = to_numeric(amount)
    return F.log1p(F.greatest(x, F.lit(0.0)) if clip_at_zero else x)


def amount_per_unit(amount: ColumnOrName, quantity: ColumnOrName) -> Column:
    """amount / quantity; zero, missing or non-finite ratio -> amount."""
    a = to_numeric(amount)
    q = to_numeric(quantity)
    ratio = F.when(q != 0, a / q)
    return F.coalesce(finite_or_null(ratio), a)


def is_high_amount(amount: ColumnOrName, threshold: ColumnOrName) -> Column:
    return (to_numeric(amount) >= _col(threshold)).cast("int")


# Right-closed bin edges of the two age bucketings.
ACCOUNT_AGE_EDGES = [-1, 30, 90, 180, 365, 730, 20000]
CUSTOMER_AGE_EDGES = [0, 20, 30, 40, 50, 60, 120]


def _right_closed_bins(x: Column, edges: list, include_lowest: bool) -> Column:
    """Code i for edges[i] < x <= edges[i+1] (first bin also closed on the
    left when ``include_lowest``); values outside or null -> -1."""
    out = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (x >= lo) if (include_lowest and i == 0) else (x > lo)
        cond = cond & (x <= hi)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out.otherwise(F.lit(-1))


def account_age_bucket(days: ColumnOrName) -> Column:
    return _right_closed_bins(to_numeric(days), ACCOUNT_AGE_EDGES, include_lowest=False)


def customer_age_bucket(age: ColumnOrName) -> Column:
    return _right_closed_bins(to_numeric(age), CUSTOMER_AGE_EDGES, include_lowest=True)


def address_match(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.coalesce((_col(a) == _col(b)).cast("int"), F.lit(0))


# ---------------------------------------------------------------- listings


def price_deviation(price: ColumnOrName, original: ColumnOrName) -> Column:
    return F.try_divide(_col(price) - _col(original), _col(original))


# Weights and scales of the two credibility scores.
def seller_credibility(rating, response_rate, age_days, top_rated) -> Column:
    return ((_col(rating) / 5.0) * 0.3
            + (_col(response_rate) / 100.0) * 0.2
            + (F.least(_col(age_days) / 365.0, F.lit(5.0)) / 5.0) * 0.3
            + _col(top_rated).cast("int") * 0.2)


def product_credibility(rating, reviews, sold) -> Column:
    return ((_col(rating) / 5.0) * 0.4
            + (F.least(_col(reviews) / 100.0, F.lit(10.0)) / 10.0) * 0.3
            + (F.least(_col(sold) / 1000.0, F.lit(10.0)) / 10.0) * 0.3)


# Item locations counted as risky.
RISKY_LOCATIONS = ["China", "Hong Kong", "Overseas"]


def risk_flags(discount="discount_percentage", seller_rating="seller_rating",
               seller_age="seller_age_days", reviews="reviews_count",
               location="item_location") -> dict[str, Column]:
    return {
        "high_discount_flag": _col(discount) > 70,
        "low_seller_rating_flag": _col(seller_rating) < 4.0,
        "new_seller_flag": _col(seller_age) < 90,
        "low_reviews_flag": _col(reviews) < 10,
        "risky_location_flag": _col(location).isin(RISKY_LOCATIONS),
    }


# Points per flag.
def fraud_risk_score(high_discount, too_cheap, low_rating, new_seller, low_reviews,
                     risky_location, has_return_policy, is_verified, is_official) -> Column:
    def i(c):
        return _col(c).cast("int")

    raw = (i(high_discount) * 3 + i(too_cheap) * 3 + i(low_rating) * 2 + i(new_seller) * 2
           + i(low_reviews) * 1 + i(risky_location) * 2 + (1 - i(has_return_policy)) * 1
           + (1 - i(is_verified)) * 2 - i(is_official) * 3)
    return F.greatest(raw, F.lit(0))


# ---------------------------------------------------------------- rules


# Payment methods and device that add rule points.
RULE_PAYMENTS = ["Credit Card", "PayPal"]
RULE_DEVICE = "Mobile"


def rule_points(amount, payment, billing, shipping, device) -> Column:
    a = to_numeric(amount)
    bill = _col(billing)
    has_bill = bill.isNotNull() & (bill != "")
    return (F.when(a > 500, 30).otherwise(0)
            + F.when(a > 2000, 20).otherwise(0)
            + F.when(_col(payment).isin(RULE_PAYMENTS), 10).otherwise(0)
            + F.when(has_bill & ~F.coalesce(bill == _col(shipping), F.lit(False)), 20).otherwise(0)
            + F.when(_col(device) == RULE_DEVICE, 10).otherwise(0))


def risk_level(pct: ColumnOrName, high: float, medium: float) -> Column:
    p = _col(pct)
    return F.when(p > high, "High").when(p > medium, "Medium").otherwise("Low")


def tx_final_probability(base_pct: ColumnOrName, points: ColumnOrName) -> Column:
    return F.round(F.least(F.lit(100.0), _col(base_pct) + _col(points)), 2)
