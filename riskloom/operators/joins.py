"""Enrichment joins and lookups.

Broadcast policy: derived side tables are written once (``written_side``);
their files tell the planner their size, and it broadcasts those within
``autoBroadcastJoinThreshold``.  Others are joined by shuffle, where AQE can
still switch to a broadcast once it has measured the shuffle output, and splits
skewed partitions.  Raw dimension scans (nation, ranges read from parquet) carry
file sizes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import normalize_key, strip_ws
from ..session import materialize
from . import ranges as rg

#: Rows of exploded ranges above which facts and ranges are merged.
MERGE_BLOCKS = 2_000_000


def written_side(side: DataFrame) -> DataFrame:
    """Compute a derived side table once, as a table whose size the planner knows."""
    return materialize(side)


def enrich_left(df: DataFrame, side: DataFrame, left_on: list[str], right_on: list[str] | None = None,
                keep_right_keys: bool = False) -> DataFrame:
    """LEFT JOIN keeping every left row.  Same-named keys are merged; with
    different names the right key is kept only when asked (reference keeps
    it)."""
    right_on = right_on or left_on
    side = written_side(side)
    if left_on == right_on:
        return df.join(side, on=left_on, how="left")
    cond = None
    renamed = side
    for lk, rk in zip(left_on, right_on):
        c = df[lk] == renamed[rk]
        cond = c if cond is None else cond & c
    out = df.join(renamed, cond, "left")
    if not keep_right_keys:
        out = out.drop(*[renamed[rk] for rk in right_on])
    return out


def map_lookup(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str,
               out: str, default=None) -> DataFrame:
    """Map ``col`` through a keyed table; misses get ``default``."""
    m = written_side(mapping.select(F.col(key).alias("__k"), F.col(value).alias("__v")))
    j = df.join(m, df[col] == m["__k"], "left").drop("__k")
    v = F.col("__v") if default is None else F.coalesce(F.col("__v"), F.lit(default))
    return j.withColumn(out, v).drop("__v")


def cross_join_scalar(df: DataFrame, scalar_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (quantile, mean ...) to every row.  A global
    aggregate has exactly one row, so broadcasting it is bounded."""
    return df.crossJoin(F.broadcast(scalar_row))


def write_colocated(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """Store ``df`` as table ``name`` in ``buckets`` sorted buckets of ``key``, one file each.  Tables of the same number of
    buckets join on the key without moving a row, however often."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option(
        "path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def left_join_identity(txn: DataFrame, identity: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Transactions LEFT JOIN identity; every transaction kept.  Both sides
    are large, so the planner picks the strategy (SMJ / AQE broadcast)."""
    return txn.join(identity, on=key, how="left")


def match_coverage(txn: DataFrame, identity: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Rows of ``txn`` having a match in ``identity`` and their percentage,
    in one pass: distinct identity keys, left join, conditional count."""
    keys = identity.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__m", F.lit(1))
    j = txn.select(key).join(keys, on=key, how="left")
    return j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("__m").alias("n_matched"),
        F.round(F.try_divide(F.count("__m") * 100.0, F.count(F.lit(1))), 6).alias("pct_matched"),
    )


def lookup_missing_keys(keys_df: DataFrame, key: str, order_col: str, cache: DataFrame,
                        cache_key: str = "ip", max_per_run: int | None = None) -> DataFrame:
    """Keys still to resolve, one row each with its first appearance: distinct,
    non-empty, absent from the cache (a key cached with a null value counts as
    cached).  ``max_per_run`` is for callers with a rate limit: the first so
    many by first appearance."""
    first_seen = (keys_df.where(F.col(key).isNotNull() & (strip_ws(key) != ""))
                  .groupBy(key).agg(F.min(order_col).alias("first_seen")))
    todo = first_seen.join(cache.select(F.col(cache_key).alias(key)), on=key, how="left_anti")
    return todo.orderBy("first_seen", key).limit(max_per_run) if max_per_run else todo


def merge_cache(cache: DataFrame, resolved: DataFrame, key: str = "ip") -> DataFrame:
    """One row per key: cache rows, overridden by newly resolved rows of the same
    key; of several rows of one key on a side the largest (nulls are smallest)."""
    def single(df: DataFrame) -> DataFrame:
        rest = [c for c in cache.columns if c != key]
        return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("__r")).select(
            *[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in cache.columns])
    return single(cache.join(resolved.select(key), on=key, how="left_anti")).unionByName(single(resolved))


# ------------------------------------------------------------ IP ranges


def ipv4_to_long(c: Column | str) -> Column:
    """Dotted quad -> 0 .. 2^32-1; malformed -> null."""
    s = F.col(c) if isinstance(c, str) else c
    parts = F.split(strip_ws(s), r"\.")
    octs = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    valid = (F.size(parts) == 4)
    for o in octs:
        valid = valid & o.isNotNull() & (o >= 0) & (o <= 255)
    value = (octs[0] * 16777216 + octs[1] * 65536 + octs[2] * 256 + octs[3])
    return F.when(valid, value)


def ip_range_join(df: DataFrame, ip_col: str, ranges: DataFrame, lo: str = "ip_lo", hi: str = "ip_hi",
                  prefix_bits: int = 16, how: str = "left", strategy: str = "auto") -> DataFrame:
    """Range join ``lo <= ip <= hi``; of nested or overlapping ranges the most specific one (``ranges.flatten_ranges``).

    ``blocks``: every range is exploded into the ``2^(32-prefix_bits)``-sized blocks it overlaps, facts join on (block)
    and the residual predicate keeps exact matches.  The fact side is never replicated; the exploded dimension is
    broadcast when its written size allows it.  ``merge``: facts and ranges are sorted together and each fact takes the
    last range before it.  ``auto`` merges above ``MERGE_BLOCKS`` exploded rows, where a broadcast would not do.
    ``how`` is left or inner; a null ip matches nothing.
    """
    shift = 32 - prefix_bits

    def exploded(r: DataFrame, start: str, stop: str) -> DataFrame:
        return r.withColumn("__blk", F.explode(F.sequence(F.shiftright(F.col(start), shift),
                                                          F.shiftright(F.col(stop), shift))))

    own = ranges.where(F.col(lo) <= F.col(hi))
    before = Window.partitionBy("__blk").orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    r = written_side(exploded(own, lo, hi).withColumn("__over", F.max(hi).over(before) >= F.col(lo)))
    start, stop = lo, hi
    if not r.where("__over").isEmpty():
        start, stop = "__from", "__to"
        own = written_side(rg.flatten_ranges(own, lo, hi, start, stop))
        r = written_side(exploded(own, start, stop))
    else:
        r = r.drop("__over")
    if strategy == "merge" or strategy == "auto" and r.count() > MERGE_BLOCKS:
        keep = [c for c in dict.fromkeys([*ranges.columns, start, stop]) if c not in (start, stop)]
        side = own.select(*keep, F.col(start).alias("__start"), F.col(stop).alias("__stop"))
        met = rg.asof_join(df, ip_col, side, "__start", [*keep, "__stop"] + (["__start"] if start == lo else []))
        hit = F.coalesce(F.col(ip_col) <= F.col("__stop"), F.lit(False))
        back = {c: F.col(c) for c in keep} | ({lo: F.col("__start"), hi: F.col("__stop")} if start == lo else {})
        met = met if how == "left" else met.where(hit)
        return met.select(*df.columns, *[F.when(hit, back[c]).alias(c) for c in ranges.columns])
    facts = df.withColumn("__blk", F.shiftright(F.col(ip_col), shift))
    cond = ((facts["__blk"] == r["__blk"]) & (facts[ip_col] >= r[start]) & (facts[ip_col] <= r[stop]))
    return facts.join(r, cond, how).drop(facts["__blk"]).drop(r["__blk"]).drop("__from", "__to")


# ------------------------------------------------------------ countries

# Spellings beside the display names of the locale data.
COUNTRY_ALIASES = {
    "united states of america": "USA",
    "u.s.": "USA",
    "uk": "GBR",
    "russian federation": "RUS",
    "viet nam": "VNM",
    "czech republic": "CZE",
    "hong kong": "HKG",
    "macao": "MAC",
    "republic of korea": "KOR",
    "korea, republic of": "KOR",
    "iran, islamic republic of": "IRN",
    "syrian arab republic": "SYR",
    "lao people's democratic republic": "LAO",
    "bolivia, plurinational state of": "BOL",
    "venezuela, bolivarian republic of": "VEN",
    "tanzania, united republic of": "TZA",
    "moldova, republic of": "MDA",
    "brunei darussalam": "BRN",
    "turkey": "TUR",
    "ivory coast": "CIV",
    "myanmar": "MMR",
    "palestine": "PSE",
    "congo": "COG",
    "cape verde": "CPV",
    "swaziland": "SWZ",
    "united states": "USA",
    "united kingdom of great britain and northern ireland": "GBR",
    "democratic republic of the congo": "COD",
    "congo, the democratic republic of the": "COD",
    "democratic people's republic of korea": "PRK",
    "korea, democratic people's republic of": "PRK",
    "republic of china": "TWN",
    "taiwan, province of china": "TWN",
    "french republic": "FRA",
    "italian republic": "ITA",
    "hellenic republic": "GRC",
    "portuguese republic": "PRT",
    "slovak republic": "SVK",
    "kyrgyz republic": "KGZ",
    "argentine republic": "ARG",
    "gabonese republic": "GAB",
    "togolese republic": "TGO",
    "lebanese republic": "LBN",
    "swiss confederation": "CHE",
    "united mexican states": "MEX",
    "micronesia, federated states of": "FSM",
    "republic of the union of myanmar": "MMR",
    "republic of moldova": "MDA",
    "holy see (vatican city state)": "VAT",
    "state of palestine": "PSE",
}
# Official names are a form of state and the name: "Kingdom of Spain", "Arab Republic of Egypt".
OFFICIAL = (r"^(the )?([a-z'\- ]+ )?(republic|kingdom|states?|duchy|principality|commonwealth|sultanate|union|federation) of "
            r"(the )?")
# Names that mean "no country".
NO_COUNTRY = ["unknown", "local network", "nan", ""]


def country_names(spark) -> dict[str, str]:
    """Lower-case name or code -> ISO 3166-1 alpha-3 for every country the JVM's
    locale data knows: English display name, alpha-2, alpha-3, and the aliases."""
    locale = spark._jvm.java.util.Locale
    rows = {}
    for code in locale.getISOCountries():
        place = locale("", code)
        iso3 = place.getISO3Country()
        for name in (place.getDisplayCountry(locale.ENGLISH), code, iso3):
            rows[name.lower()] = iso3
            # the locale data write "St." and "&"; both spellings are in use
            rows.setdefault(name.lower().replace("st. ", "saint ").replace(" & ", " and "), iso3)
    return {**rows, **COUNTRY_ALIASES}


def country_dimension(spark) -> DataFrame:
    """(name_lower, iso3) of all countries."""
    return spark.createDataFrame(sorted(country_names(spark).items()), "name_lower string, iso3 string")


def country_to_iso3(df: DataFrame, col: str, out: str = "iso3", names: DataFrame | None = None) -> DataFrame:
    """Country name, official name or code -> ISO3 (null for unknown / local / empty names).

    A value is looked up as it is, then without the form of state before the name.  ``names`` (name, iso3) adds further
    keys, such as numeric codes, which locale data do not hold; its own entries come first.
    """
    spark = df.sparkSession
    dim = country_dimension(spark)  # three names for each ISO country
    if names is not None:
        extra = names.select(normalize_key("name", null_token=None).alias("name_lower"), "iso3").groupBy("name_lower").agg(
            F.min("iso3").alias("iso3"))
        dim = written_side(extra.unionByName(dim.join(extra, "name_lower", "left_anti")))
    else:
        dim = F.broadcast(dim)
    low = normalize_key(col, null_token=None)
    keyed = df.withColumn("__nl", F.when(~low.isin(NO_COUNTRY), low)).withColumn(
        "__short", F.regexp_replace("__nl", OFFICIAL, ""))
    short = dim.select(F.col("name_lower").alias("__name"), F.col("iso3").alias("__iso3"))
    j = keyed.join(dim, keyed["__nl"] == dim["name_lower"], "left").join(
        short, F.when(dim["iso3"].isNull(), F.col("__short")) == F.col("__name"), "left")
    return j.withColumn("__found", F.coalesce(dim["iso3"], F.col("__iso3"))).drop(
        "__nl", "__short", "__name", "__iso3", "name_lower").drop(dim["iso3"]).withColumnRenamed("__found", out)
