"""Model fitting and scoring: boosted trees of ``boosting`` (one barrier job a
model), the forest of ``forest``, and logistic regression of Spark ML.

Settings mirror the reference's: rounds, leaves, depth, minimum rows or hessian
of a leaf, L1 / L2, row and column sampling, class weight.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import is_finite
from . import boosting, forest
from .boosting import BoostedModel, Boosting
from .forest import Forest, ForestModel

SEED = 42


# ------------------------------------------------------------ weights


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: positive rate and (1 - p) / max(p, 1e-6)."""
    p = F.avg(F.col(label).cast("double"))
    return df.agg(p.alias("pos_rate"),
                  ((1 - p) / F.greatest(p, F.lit(1e-6))).alias("scale_pos_weight"))


def with_weights(df: DataFrame, label: str, mode: str = "scale_pos", name: str = "weight") -> DataFrame:
    """Per-row weight column.  ``scale_pos``: positives get (1-p)/p, negatives
    1.  ``balanced``: class c gets n / (2 n_c).  The statistics are one
    aggregate row broadcast to every row."""
    y = F.col(label).cast("int")
    stats = df.agg(F.count(F.lit(1)).alias("__n"), F.count_if(y == 1).alias("__np"))
    j = df.crossJoin(F.broadcast(stats))
    n, npos = F.col("__n").cast("double"), F.col("__np").cast("double")
    if mode == "scale_pos":
        p = npos / n
        w = F.when(y == 1, (1 - p) / F.greatest(p, F.lit(1e-6))).otherwise(F.lit(1.0))
    else:
        w = F.when(y == 1, n / (2 * npos)).otherwise(n / (2 * (n - npos)))
    return j.withColumn(name, w).drop("__n", "__np")


# ------------------------------------------------------------ features


def clean_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast to double; inf / NaN / null -> 0.0."""
    return df.withColumns({c: F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double"))
                           .otherwise(F.lit(0.0)) for c in cols})


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def assemble_features(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return assembler(cols, out).transform(clean_numeric(df, cols))


# ------------------------------------------------------------ estimators
# The reference's training settings.


def gbt_a(label: str, rounds: int = 1200) -> Boosting:
    """Boosted trees, model A: best-first to 96 leaves of 40 rows and more, unweighted."""
    return Boosting(rounds, 0.05, max_leaves=96, min_rows=40, l1=1.0, l2=3.0, rows=0.9, columns=0.8, label=label,
                    seed=SEED)


def gbt_b(label: str, rounds: int = 900) -> Boosting:
    """Boosted trees, model B: depth 7, hessian of a leaf at least 4, positives weighted by (1-p)/p."""
    return Boosting(rounds, 0.05, max_depth=7, min_hessian=4.0, l1=0.5, l2=3.0, rows=0.9, columns=0.8,
                    positive_weight=True, label=label, seed=SEED)


def gbt_time(label: str, rounds: int = 800) -> Boosting:
    """Time-split benchmark model: best-first to 128 leaves of 40 rows and more, positives weighted."""
    return Boosting(rounds, 0.05, max_leaves=128, min_rows=40, l1=1.0, l2=2.0, rows=0.8, columns=0.8,
                    positive_weight=True, label=label, seed=SEED)


def gbt_simple(label: str, rounds: int = 200) -> Boosting:
    """Notebook baseline: depth 4."""
    return Boosting(rounds, 0.1, max_depth=4, min_hessian=1.0, l2=1.0, rows=0.9, columns=0.9, label=label, seed=SEED)


def gbt_engineered(label: str, rounds: int = 400) -> Boosting:
    """Notebook model on engineered features: depth 6, positives weighted."""
    return Boosting(rounds, 0.05, max_depth=6, min_hessian=1.0, l2=1.0, rows=0.9, columns=0.9, positive_weight=True,
                    label=label, seed=SEED)


def random_forest(label: str, trees: int = 300) -> Forest:
    """300 trees grown until leaves are pure, balanced class weights."""
    return Forest(trees, label=label, seed=SEED)


def logistic(label: str, max_iter: int = 1000, c: float = 1.0, n_rows: int | None = None) -> LogisticRegression:
    """L2 logistic regression, up to 1000 iterations.  scikit-learn's
    ``C`` (loss summed) maps to MLlib's ``regParam = 1 / (C n)`` (loss
    averaged); without ``n_rows`` the fit is unregularised."""
    reg = 1.0 / (c * n_rows) if n_rows else 0.0
    return LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter, regParam=reg,
                              elasticNetParam=0.0, standardization=False)


def fit(train: DataFrame, feature_cols: list[str], estimator, valid: DataFrame | None = None,
        row_id: str | None = None, at_once: int = 1) -> BoostedModel | ForestModel | PipelineModel:
    """A boosted model or forest for ``Boosting`` or ``Forest`` settings, else assembler + estimator as one PipelineModel
    (cleaning is a plain projection applied when scoring).  ``row_id`` is what the draws of trees go by; ``at_once``
    boosted fits that run side by side share the slots."""
    if isinstance(estimator, Boosting):
        return boosting.fit(train, feature_cols, estimator, valid, row_id, at_once=at_once)
    if isinstance(estimator, Forest):
        return forest.fit(train, feature_cols, estimator, row_id)
    pipe = Pipeline(stages=[assembler(feature_cols), estimator])
    return pipe.fit(clean_numeric(train, feature_cols))


def positive_probability(model: BoostedModel | ForestModel | PipelineModel, df: DataFrame, feature_cols: list[str],
                         name: str = "prob") -> DataFrame:
    if isinstance(model, (BoostedModel, ForestModel)):
        return model.probabilities(df, name)
    out = model.transform(clean_numeric(df, feature_cols))
    keep = [c for c in df.columns]
    return out.select(*keep, vector_to_array("probability")[1].alias(name))


def blend(p_a: Column | str, p_b: Column | str, w_a: float = 0.6, w_b: float = 0.4) -> Column:
    a = F.col(p_a) if isinstance(p_a, str) else p_a
    b = F.col(p_b) if isinstance(p_b, str) else p_b
    return a * w_a + b * w_b


# ------------------------------------------------------------ persistence


def save_bundle(spark, path: str, models: dict[str, BoostedModel], metadata: dict) -> None:
    """Each model under ``path/<name>``; metadata as one JSON row."""
    for name, m in models.items():
        m.save(f"{path}/{name}")
    meta = spark.createDataFrame([(json.dumps(metadata),)], "metadata string")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_bundle(spark, path: str, names: list[str]) -> tuple[dict[str, BoostedModel], dict]:
    models = {n: BoostedModel.load(spark, f"{path}/{n}") for n in names}
    row = spark.read.json(f"{path}/metadata").first()
    return models, json.loads(row["metadata"])


def metadata_frame(spark, feature_cols: list[str], threshold: float, weights=(0.6, 0.4),
                   metrics: dict | None = None) -> DataFrame:
    """One-row metadata: feature names, blend weights, threshold, metrics."""
    m = metrics or {}
    return spark.createDataFrame(
        [(feature_cols, list(weights), float(threshold), json.dumps(m))],
        "feature_names array<string>, weights array<double>, threshold double, metrics string")
