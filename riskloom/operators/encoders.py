"""Category encoders fitted on the training split only (no label leakage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def hash_bucket(key: Column | str, n: int, salt: str = "") -> Column:
    """Deterministic bucket 0..n-1 from md5 of the key (same in SQL:
    ``('0x' || substr(md5(k), 1, 8))::bigint % n``)."""
    k = F.col(key) if isinstance(key, str) else key
    s = k.cast("string") if not salt else F.concat(k.cast("string"), F.lit(salt))
    return F.pmod(F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def hash_unit(key: Column | str, salt: str = "") -> Column:
    """Deterministic uniform value in [0, 1) from md5 of the key."""
    k = F.col(key) if isinstance(key, str) else key
    s = k.cast("string") if not salt else F.concat(k.cast("string"), F.lit(salt))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def frequency_table(train: DataFrame, col: str, name: str) -> DataFrame:
    return train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("double").alias(name))


def apply_frequency(df: DataFrame, table: DataFrame, col: str, is_train: bool) -> DataFrame:
    """Join a fitted frequency table; non-train rows map unseen/null to 0."""
    out = df.join(table, on=col, how="left")
    return out if is_train else out.fillna({f"{col}_freq": 0.0})


def frequency_encode(train: DataFrame, others: list[DataFrame], col: str) -> tuple[DataFrame, list[DataFrame]]:
    """``col_freq`` = count of the value in *train*.  Train keeps null for a
    null value; other splits map unseen / null values to 0."""
    freq = frequency_table(train, col, f"{col}_freq")
    return apply_frequency(train, freq, col, True), [apply_frequency(o, freq, col, False) for o in others]


def frequency_encode_missing(train: DataFrame, others: list[DataFrame], cols: list[str],
                             token: str = "missing") -> tuple[DataFrame, list[DataFrame]]:
    """Nulls first become ``missing``; then frequency-encode on train and
    drop the original columns (unseen values -> 0 everywhere).  All tables
    are fitted on the same filled train, then joined in a linear chain."""
    fill = {c: token for c in cols}
    tr0 = train.fillna(fill)
    tables = {c: frequency_table(tr0, c, f"{c}_freq") for c in cols}
    tr = tr0
    outs = [o.fillna(fill) for o in others]
    for c in cols:
        tr = apply_frequency(tr, tables[c], c, False)
        outs = [apply_frequency(o, tables[c], c, False) for o in outs]
    return tr.drop(*cols), [o.drop(*cols) for o in outs]


def fit_target_kfold(train: DataFrame, col: str, label: str, id_col: str, n_splits: int = 5,
                     smoothing: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fitted tables of the out-of-fold target encoding:

    * ``oof``  (col, __fold, col_te): for a train row in fold f, category c,
      ``(S_c - S_cf + m g) / (N_c - N_cf + m)`` (S/N label sum/count, g the
      train mean, m the smoothing); a category absent from the other folds
      gets g.
    * ``full`` (col, col_te): mean of train's OOF values per category, for
      valid / test.
    * ``g``    one row, the train mean.
    One ``groupBy(cat, fold)`` feeds all three.
    """
    name = f"{col}_te"
    m = float(smoothing)
    tr = train.withColumn("__fold", hash_bucket(id_col, n_splits))
    g = tr.agg(F.avg(F.col(label).cast("double")).alias("__g"))
    per_fold = (tr.where(F.col(col).isNotNull()).groupBy(col, "__fold")
                  .agg(F.sum(F.col(label).cast("double")).alias("__sf"), F.count(F.lit(1)).alias("__nf")))
    tot = Window.partitionBy(col)  # <= n_splits rows per category
    oof = (per_fold.withColumn("__sc", F.sum("__sf").over(tot))
                   .withColumn("__nc", F.sum("__nf").over(tot))
                   .crossJoin(F.broadcast(g))
                   .withColumn(name, (F.col("__sc") - F.col("__sf") + m * F.col("__g"))
                               / (F.col("__nc") - F.col("__nf") + m))
                   .select(col, "__fold", "__nf", name))
    full = oof.groupBy(col).agg((F.sum(F.col(name) * F.col("__nf")) / F.sum("__nf")).alias(name))
    return oof.drop("__nf"), full, g


def apply_target_train(df: DataFrame, oof: DataFrame, g: DataFrame, col: str, id_col: str,
                       n_splits: int = 5) -> DataFrame:
    name = f"{col}_te"
    return (df.withColumn("__fold", hash_bucket(id_col, n_splits))
              .join(oof, on=[col, "__fold"], how="left")
              .crossJoin(F.broadcast(g))
              .withColumn(name, F.coalesce(F.col(name), F.col("__g")))
              .drop("__fold", "__g"))


def apply_target_other(df: DataFrame, full: DataFrame, g: DataFrame, col: str) -> DataFrame:
    name = f"{col}_te"
    return (df.join(full, on=col, how="left").crossJoin(F.broadcast(g))
              .withColumn(name, F.coalesce(F.col(name), F.col("__g"))).drop("__g"))


def target_encode_kfold(train: DataFrame, others: list[DataFrame], col: str, label: str,
                        id_col: str, n_splits: int = 5, smoothing: float = 100.0
                        ) -> tuple[DataFrame, list[DataFrame]]:
    """Out-of-fold smoothed target mean on train; valid/test get the mean of
    train's OOF values for their category (train mean when unseen / null)."""
    oof, full, g = fit_target_kfold(train, col, label, id_col, n_splits, smoothing)
    return (apply_target_train(train, oof, g, col, id_col, n_splits),
            [apply_target_other(o, full, g, col) for o in others])


def encode_by_split(df: DataFrame, cols: list[str], label: str | None = None, id_col: str | None = None,
                    split: str = "split", n_splits: int = 5, smoothing: float = 100.0) -> DataFrame:
    """Frequency and, given a label, K-fold target encoding of ``cols`` on one
    table with a ``split`` column, fitted on its ``train`` rows.

    Each column has one fitted table with a row per category: its count, its
    out-of-fold means by fold (at most ``n_splits``) and their weighted mean.
    It is written, so the planner broadcasts it when its files are small, and
    joined once; the row's split chooses the value.  Same values as
    ``frequency_encode`` and ``target_encode_kfold``."""
    train = df.where(F.col(split) == "train")
    is_train = F.col(split) == "train"
    out = df
    if label:
        g = materialize(train.agg(F.avg(F.col(label).cast("double")).alias("__g")))
        fold = hash_bucket(id_col, n_splits)
        out = out.crossJoin(F.broadcast(g)).withColumn("__fold", fold)  # one row
    for c in cols:
        rows = train.where(F.col(c).isNotNull())
        if label:
            y = F.col(label).cast("double")
            per = rows.groupBy(F.col(c).alias("__c"), fold.alias("__f")).agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"))
            every = per.groupBy("__c").agg(F.collect_list(F.struct("__f", "s", "n")).alias("__p"))  # a row per fold
            sums = every.crossJoin(F.broadcast(g)).withColumn("__n", F.aggregate(
                "__p", F.lit(0).cast("long"), lambda a, p: a + p["n"])).withColumn("__s", F.aggregate(
                    "__p", F.lit(0.0), lambda a, p: a + p["s"]))
            te = F.transform("__p", lambda p: F.struct(p["__f"].alias("f"), (
                (F.col("__s") - p["s"] + float(smoothing) * F.col("__g")) / (F.col("__n") - p["n"] + float(smoothing))
            ).alias("te"), p["n"].alias("n")))
            table = sums.select("__c", F.col("__n").cast("double").alias("__freq"), te.alias("__te")).withColumn(
                "__full", F.aggregate("__te", F.lit(0.0), lambda a, p: a + p["te"] * p["n"]) / F.col("__freq"))
        else:
            table = rows.groupBy(F.col(c).alias("__c")).agg(F.count(F.lit(1)).cast("double").alias("__freq"))
        out = out.join(materialize(table), F.col(c) == F.col("__c"), "left")
        out = out.withColumn(f"{c}_freq", F.when(is_train, F.col("__freq")).otherwise(F.coalesce("__freq", F.lit(0.0))))
        if label:
            own = F.get(F.transform(F.filter("__te", lambda p: p["f"] == F.col("__fold")), lambda p: p["te"]), 0)
            out = out.withColumn(f"{c}_te", F.coalesce(F.when(is_train, own).otherwise(F.col("__full")), F.col("__g")))
        out = out.drop("__c", "__freq", "__te", "__full")
    return out.drop("__g", "__fold")


#: Columns of dummies that a table can reasonably have; ``one_hot_index`` is the form for any number of levels.
MAX_LEVELS = 20_000


def distinct_levels(df: DataFrame, col: str) -> list:
    """Distinct non-null levels, sorted.  They become column names, so they are
    driver metadata, of ``MAX_LEVELS`` entries at most; more are an error."""
    rows = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{col} has more than {MAX_LEVELS} levels: use one_hot_index")
    return [r[0] for r in rows]


def one_hot(df: DataFrame, cols: list[str], prefixes: list[str], levels: dict[str, list] | None = None) -> DataFrame:
    """Dummy int columns ``<prefix>_<level>``, originals dropped.  ``levels`` are
    those fitted on a training table (a level that is not among them is all 0);
    without it they come from ``df``."""
    out = df
    for c, p in zip(cols, prefixes):
        names = {f"{p}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
                 for v in ((levels or {}).get(c) or distinct_levels(df, c))}
        out = out.select("*", *[e.alias(n) for n, e in names.items()]).drop(c)
    return out


def one_hot_index(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same as sparse indices: ``<col>_code`` is the place of the 1 (null: none).
    Any number of levels; nothing reaches the driver."""
    for c in cols:
        df = label_encode(df, c)
    return df


def label_encode(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Integer code of the value in sorted order of distinct values.  Codes
    are distributed positions of the sorted distinct values (range
    partitions + per-partition offsets), so any cardinality works."""
    from .splits import with_positions
    name = name or f"{col}_code"
    levels = df.where(F.col(col).isNotNull()).select(col).distinct()
    # written: the planner broadcasts it when it is small
    codes = materialize(with_positions(levels, [col], "__pos").select(col, F.col("__pos").cast("int").alias(name)))
    return df.join(codes, on=col, how="left")
