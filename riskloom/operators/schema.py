"""Schema-driven helpers.  They read ``df.schema`` / ``df.columns`` (driver
metadata only) and return a projected DataFrame; no data is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.cleaning import normalize_name

# Header -> snake_case names applied when present.
HEADER_MAP = {
    "Transaction_Amount": "transaction_amount",
    "Transaction_Date": "transaction_date",
    "Customer_ID": "customer_id",
    "Customer_Age": "customer_age",
    "Customer_Location": "customer_location",
    "Payment_Method": "payment_method",
    "Product_Category": "product_category",
    "Device_Used": "device_used",
    "IP_Address": "ip_address",
    "Shipping_Address": "shipping_address",
    "Billing_Address": "billing_address",
    "Account_Age_Days": "account_age_days",
    "Transaction_Hour": "transaction_hour",
    "Is_Fraudulent": "is_fraudulent",
}


def rename_clean_headers(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """strip; ' ' and '-' -> '_'; then the known-name map (only if present)."""
    mapping = HEADER_MAP if mapping is None else mapping
    ren = {}
    for c in df.columns:
        c2 = c.strip().replace(" ", "_").replace("-", "_")
        ren[c] = mapping.get(c2, c2)
    return df.withColumnsRenamed({k: v for k, v in ren.items() if k != v})


def normalize_columns(df: DataFrame) -> DataFrame:
    """Every column name through ``normalize_name``."""
    return df.withColumnsRenamed({c: normalize_name(c) for c in df.columns if normalize_name(c) != c})


def rename_prefix(df: DataFrame, old: str = "id-", new: str = "id_") -> DataFrame:
    return df.withColumnsRenamed({c: new + c[len(old):] for c in df.columns if c.startswith(old)})


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``a`` (in its order) also present in ``b``."""
    bs = set(b.columns)
    return [c for c in a.columns if c in bs]


def align_to(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns_if_present(df: DataFrame, cols: list[str], drop_unnamed: bool = True) -> DataFrame:
    extra = [c for c in df.columns if drop_unnamed and c.lower().startswith("unnamed")]
    return df.drop(*[c for c in cols if c in df.columns], *extra)


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric (not boolean) columns except ``exclude``."""
    ex = set(exclude or [])
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
            and f.name not in ex]


def select_numeric(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.select(*numeric_columns(df, [target] if target else []))


def detect_target(df: DataFrame, preferred: str = "is_fraudulent") -> str:
    if preferred in df.columns:
        return preferred
    for c in df.columns:
        if "fraud" in c.lower():
            return c
    raise ValueError(f"Target column '{preferred}' not found")


def detect_amount_column(df: DataFrame) -> str | None:
    """First non-string column whose name starts with 'transaction'."""
    for f in df.schema.fields:
        if f.name.lower().startswith("transaction") and f.dataType.typeName() != "string":
            return f.name
    return None


# Name fragments that mark a label-like column.
TARGET_LIKE = ["fraud", "label", "target"]


def drop_target_like(names: list[str]) -> list[str]:
    return [n for n in names if not any(t in n.lower() for t in TARGET_LIKE)]


def with_default_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add constant columns for optional inputs that are missing."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})
