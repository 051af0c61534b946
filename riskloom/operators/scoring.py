"""Batch scoring: request records -> model feature columns -> probabilities.

The reference scores one HTTP payload at a time; here a table (or a
micro-batch) of requests is projected onto the model's ordered feature list
with column expressions only, then scored by a fitted model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import normalize_name, normalize_name_col, to_numeric
from ..functions.features import account_age_bucket, customer_age_bucket
from .boosting import BoostedModel
from .ml import positive_probability
from .splits import with_positions


def _num(c: Column) -> Column:
    return F.coalesce(to_numeric(c), F.lit(0.0))


def align_features(requests: DataFrame, feature_names: list[str], map_col: str = "features",
                   keep: list[str] | None = None) -> DataFrame:
    """Project a ``map<string,double>`` payload onto exactly ``feature_names``
    (in order): the original name first, then any key equal after name
    normalisation; missing / null / unparsable -> 0.0; extra keys dropped."""
    m = F.col(map_col)

    def same_name(norm: str):
        # one-argument lambda: a second parameter would receive the index
        return lambda e: normalize_name_col(e.getField("key")) == F.lit(norm)

    cols = []
    for n in feature_names:
        by_norm = F.filter(F.map_entries(m), same_name(normalize_name(n)))
        v = F.coalesce(F.element_at(m, F.lit(n)), F.get(by_norm, 0).getField("value"), F.lit(0.0))
        cols.append(v.cast("double").alias(n))
    return requests.select(*(keep or []), *cols)


def pad_trim(values: Column, width: int) -> Column:
    """Array of unknown width -> exactly ``width`` values (0.0 padding)."""
    padded = F.concat(F.coalesce(values, F.array().cast("array<double>")),
                      F.array_repeat(F.lit(0.0), width))
    return F.slice(padded, 1, width)


def _same(x: Column) -> Column:
    return x


@dataclass(frozen=True)
class Derived:
    """How a model feature follows from a request: the first present of
    ``sources`` as a number, through ``rule``; ``needs`` names features of which
    the model must have one."""

    sources: tuple[str, ...]
    rule: Callable[[Column], Column] = _same
    needs: tuple[str, ...] = ()


def _log1p_positive(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


_ACCOUNT = ("account_age", "account_age_days")
_QUANTITY = ("quantity", "qty")
#: One rule per feature; features without one, or without a source in the request, are 0.0.
DERIVED = {
    "transaction_amount": Derived(("amount",)),
    "log_amount": Derived(("amount",), _log1p_positive),
    "amount_per_unit": Derived(("amount_per_unit",)),
    "account_age_days": Derived(_ACCOUNT),
    "account_age_bucket": Derived(_ACCOUNT, account_age_bucket),
    "customer_age": Derived(("age",)),
    "customer_age_bucket": Derived(("age",), customer_age_bucket),
    "transaction_hour": Derived(("transaction_hour",), lambda h: h.cast("int")),
    "hour_sin": Derived(("transaction_hour",), lambda h: F.sin(F.lit(2 * math.pi) * h.cast("int") / 24.0)),
    "hour_cos": Derived(("transaction_hour",), lambda h: F.cos(F.lit(2 * math.pi) * h.cast("int") / 24.0)),
    "is_night": Derived(("transaction_hour",), lambda h: ~h.cast("int").between(7, 21)),
    "cust_total_txn": Derived(("cust_total_txn",)),
    "cust_total_txn_log": Derived(("cust_total_txn",), _log1p_positive, needs=("cust_total_txn",)),
    "quantity": Derived(_QUANTITY, lambda q: q.cast("long"), needs=_QUANTITY),
}


def infer_features_from_request(requests: DataFrame, feature_names: list[str],
                                keep: list[str] | None = None) -> DataFrame:
    """User-facing request columns -> model features by ``DERIVED``; anything not
    derivable is 0.0."""
    def value(name: str) -> Column:
        how = DERIVED.get(name)
        source = next((c for c in how.sources if c in requests.columns), None) if how else None
        if source is None or how.needs and not set(how.needs) & set(feature_names):
            return F.lit(0.0)
        return how.rule(_num(F.col(source))).cast("double")
    return requests.select(*(keep or []), *[value(n).alias(n) for n in feature_names])


# Keyword rules, first match wins: the words a feature name must all hold (any of a group), and the input it reads.
KEYWORD_RULES = [
    ((("amount",),), "amount"),
    ((("quantity", "qty"),), "quantity"),
    ((("customer",), ("age",)), "customer_age"),
    ((("account",), ("age",)), "account_age"),
    ((("hour",),), "hour"),
    ((), "amount"),
]
# Input fields of the two request kinds, with their defaults.
INPUTS = {
    "tx": {"amount": ("amount_input", 0.0), "quantity": ("cust_total_txn_tx", 1),
           "customer_age": ("customer_age_input", 0), "account_age": ("account_age_input", 0),
           "hour": ("transaction_hour_input", 12)},
    "user": {"amount": ("avg_order_input", 0.0), "quantity": ("total_tx_input", 1),
             "customer_age": ("age_input", 0), "account_age": ("account_age_input", 0),
             "hour": ("transaction_hour_input", 12)},
}


def input_for_feature(name: str, kind: str) -> tuple[str, float | int]:
    """(input field, default) of a feature name by ``KEYWORD_RULES``."""
    words = name.lower()
    rule = next(r for groups, r in KEYWORD_RULES if all(any(w in words for w in g) for g in groups))
    return INPUTS["tx" if kind == "tx" else "user"][rule]


def map_inputs_by_keyword(inputs: DataFrame, feature_names: list[str], kind: str = "tx",
                          keep: list[str] | None = None) -> DataFrame:
    """One column per feature name from the matching input field.  A missing
    or null input takes the field's default; a given 0 stays 0."""
    cols = []
    for n in feature_names:
        field, default = input_for_feature(n, kind)
        src = F.col(field) if field in inputs.columns else F.lit(None)
        v = F.coalesce(to_numeric(src), F.lit(float(default)))
        v = v if isinstance(default, float) else v.cast("long")
        cols.append(v.cast("double").alias(n))
    return inputs.select(*(keep or []), *cols)


def batch_score(model: BoostedModel | PipelineModel, features: DataFrame, feature_cols: list[str], threshold: float = 0.5,
                keep: list[str] | None = None) -> DataFrame:
    """Probability of fraud in percent (2 decimals) and the decision at the
    model's saved threshold."""
    p = positive_probability(model, features, feature_cols, "__p")
    return p.select(*(keep or []), F.round(F.col("__p") * 100, 2).alias("fraud_probability"),
                    (F.col("__p") >= threshold).cast("int").alias("prediction"))


def blend_score(models: dict[str, BoostedModel | PipelineModel], features: DataFrame, feature_cols: list[str],
                weights: dict[str, float], keep: list[str]) -> DataFrame:
    """Weighted blend of several models' positive-class probabilities."""
    out = features
    blended = None
    for name, m in models.items():
        out = positive_probability(m, out, feature_cols, f"__p_{name}")
        term = F.col(f"__p_{name}") * weights[name]
        blended = term if blended is None else blended + term
    return out.select(*keep, blended.alias("prob"))


def with_row_ids(rows: DataFrame, id_col: str, order_cols: list[str]) -> DataFrame:
    """``rows`` with an id each: the column ``id_col`` where there is one, else the row's place (from 0) in the order of
    ``order_cols``, found by range partitions and offsets."""
    if id_col.lower() in (c.lower() for c in rows.columns):
        return rows
    return with_positions(rows, order_cols, id_col)
