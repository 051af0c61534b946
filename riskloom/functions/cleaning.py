"""Value-level cleaning expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: ColumnOrName) -> Column:
    """Strip leading/trailing whitespace of every kind (tabs, newlines too).

    Spark's ``trim`` only removes spaces, pandas ``str.strip`` removes all.
    """
    return F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", "")


def normalize_key(c: ColumnOrName, null_token: str | None = "nan") -> Column:
    """lower + strip; a null key becomes the literal ``nan`` (so null keys
    still match each other in joins, as string-casting a missing value does).
    Pass ``null_token=None`` to keep nulls."""
    out = F.lower(strip_ws(c))
    return F.coalesce(out, F.lit(null_token)) if null_token is not None else out


def to_numeric(c: ColumnOrName) -> Column:
    """Coerce to double; unparsable strings become null."""
    return _col(c).try_cast("double")


def is_finite(c: ColumnOrName) -> Column:
    x = _col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_null(c: ColumnOrName) -> Column:
    """inf / -inf / NaN -> null."""
    x = to_numeric(c)
    return F.when(is_finite(x), x)


def safe_int(c: ColumnOrName, fill_value: int = 0) -> Column:
    """Numeric-coerce, inf -> null, fill, truncate to long."""
    return F.coalesce(finite_or_null(c), F.lit(float(fill_value))).cast("long")


def to_datetime(c: ColumnOrName) -> Column:
    """Parse to timestamp_ntz; unparsable values become null."""
    x = _col(c)
    return F.coalesce(
        x.try_cast("timestamp_ntz"),
        F.try_to_timestamp(x.cast("string")).cast("timestamp_ntz"),
    )


# Spellings the target coercion maps to 1 / 0.
TRUE_TOKENS = ["1", "true", "yes", "y"]
FALSE_TOKENS = ["0", "false", "no", "n"]


def coerce_binary_target(c: ColumnOrName) -> Column:
    """1/0, true/false, yes/no, y/n (any case, padded) -> 1/0; other text
    parsed as a number; anything else 0.  Result is int."""
    s = F.lower(strip_ws(c))
    num = s.try_cast("double")
    return (F.when(s.isin(TRUE_TOKENS), F.lit(1))
            .when(s.isin(FALSE_TOKENS), F.lit(0))
            .when(is_finite(num), num.cast("int"))
            .otherwise(F.lit(0)))


def normalize_name(name: str) -> str:
    """Driver-side name normaliser for column names (metadata, not data): the
    lower-case runs of letters and digits, joined by ``_``."""
    return "_".join(re.findall("[0-9a-z]+", name.lower())) if isinstance(name, str) else name


def normalize_name_col(c: ColumnOrName) -> Column:
    """Same normalisation applied to column *values*."""
    s = F.regexp_replace(F.lower(strip_ws(c)), r"[^0-9a-z]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def label_text(c: ColumnOrName) -> Column:
    """1/true -> Fraud, 0/false -> Legit, anything else its text."""
    s = _col(c).cast("string")
    low = F.lower(s)
    return (F.when(low.isin("1", "true", "1.0"), F.lit("Fraud"))
            .when(low.isin("0", "false", "0.0"), F.lit("Legit"))
            .otherwise(s))
