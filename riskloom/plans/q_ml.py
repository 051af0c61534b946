"""Registered queries: metrics, blending, request projections and model
jobs (SURVEY 2.10).  Model-fitting queries are randomised/iterative and
have no SQL oracle (rows-only check); everything around them is exact."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import ml, scoring, splits
from ..session import materialize
from ..sources import files
from ..sources import fixtures as fx
from . import baselines
from .common import TXN_E_CTE, TXN_O_CTE, finalize, register

# ------------------------------------------------------------ scored fixture

SCORED_CTE = "WITH " + TXN_E_CTE + """,
sc AS (SELECT transaction_id, is_fraudulent AS y, least(transaction_amount / 500.0, 1.0) AS p FROM txn_e)"""


def scored_events(spark, sf):
    """Events with a deterministic score in [0, 1] (value / 500) and the label."""
    e = fx.transactions_events(spark, sf)
    return e.select("transaction_id", F.col("is_fraudulent").alias("y"),
                    F.least(F.col("transaction_amount") / 500.0, F.lit(1.0)).alias("p"))


@register("class_weight", f"""
WITH {TXN_O_CTE}
SELECT round(avg(CAST(is_fraudulent AS DOUBLE)), 8) AS pos_rate,
       round((1 - avg(CAST(is_fraudulent AS DOUBLE))) / greatest(avg(CAST(is_fraudulent AS DOUBLE)), 1e-6), 8)
         AS scale_pos_weight FROM txn_o""")
def q_class_weight(spark, sf):
    return finalize(ml.class_weight(fx.transactions_orders(spark, sf), "is_fraudulent"), digits=8)


@register("ensemble_score", f"""
WITH {TXN_E_CTE}, e AS (SELECT e.event_id, TRY_CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / 100.0 AS pb
                        FROM events e)
SELECT t.transaction_id, round(least(t.transaction_amount / 500.0, 1.0) * 0.6 + e.pb * 0.4, 8) AS prob
FROM txn_e t JOIN e ON t.transaction_id = e.event_id""")
def q_ensemble_score(spark, sf):
    e = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("p_a"),
        (fx.events_k(F.col("props")).cast("double") / 100.0).alias("p_b"))
    return finalize(e.select("transaction_id", ml.blend("p_a", "p_b").alias("prob")), digits=8)


def _sweep_sql(start: str, steps: int) -> str:
    # doubles, spaced by the rounded difference of the first two grid values
    first, step = f"CAST({start} AS DOUBLE)", f"(CAST({start} AS DOUBLE) + CAST(0.01 AS DOUBLE) - CAST({start} AS DOUBLE))"
    return SCORED_CTE + f""",
grid AS (SELECT CAST(i AS INTEGER) AS i, {first} + i * {step} AS threshold FROM range({steps}) t(i)),
tot AS (SELECT count(*) FILTER (WHERE y = 1) AS P FROM sc),
c AS (SELECT g.i, g.threshold, count(*) FILTER (WHERE sc.y = 1) AS tp, count(*) FILTER (WHERE sc.y <> 1) AS fp
      FROM grid g LEFT JOIN sc ON sc.p >= g.threshold GROUP BY 1, 2),
sw AS (SELECT c.i, c.threshold, c.tp, c.fp, tot.P - c.tp AS fn,
              CASE WHEN c.tp + c.fp = 0 THEN 0.0 ELSE c.tp / (c.tp + c.fp) END AS precision,
              CASE WHEN tot.P = 0 THEN 0.0 ELSE c.tp / tot.P END AS recall,
              CASE WHEN 2 * c.tp + c.fp + (tot.P - c.tp) = 0 THEN 0.0
                   ELSE 2 * c.tp / (2 * c.tp + c.fp + (tot.P - c.tp)) END AS f1
       FROM c CROSS JOIN tot)"""


SWEEP_SQL = _sweep_sql("0.1", 81)
SWEEP_ROWS = """
SELECT i, round(threshold, 8) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, round(precision, 8) AS precision, round(recall, 8) AS recall,
       round(f1, 8) AS f1 FROM sw"""


@register("threshold_sweep_05_50", _sweep_sql("0.05", 46) + SWEEP_ROWS)
def q_threshold_sweep_05_50(spark, sf):
    """The grid of the time-split benchmark model: .05 to .50."""
    return finalize(mt.threshold_sweep(scored_events(spark, sf), "y", "p", 0.05, 0.50), digits=8)


@register("threshold_sweep", SWEEP_SQL + SWEEP_ROWS)
def q_threshold_sweep(spark, sf):
    return finalize(mt.threshold_sweep(scored_events(spark, sf), "y", "p"), digits=8)


@register("best_f1_threshold", SWEEP_SQL + """
SELECT round(threshold, 8) AS best_threshold, round(f1, 8) AS best_f1 FROM sw ORDER BY f1 DESC, i LIMIT 1""")
def q_best_f1_threshold(spark, sf):
    return finalize(mt.best_f1_threshold(scored_events(spark, sf), "y", "p"), digits=8)


AUC_SQL = """
per AS (SELECT p AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
        FROM sc WHERE p IS NOT NULL GROUP BY 1),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM per),
auc AS (SELECT sum(pos * (nb + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM r)"""


@register("roc_auc", SCORED_CTE + "," + AUC_SQL + "\nSELECT round(auc, 8) AS auc FROM auc")
def q_roc_auc(spark, sf):
    return finalize(mt.roc_auc(scored_events(spark, sf), "y", "p"), digits=8)


@register("eval_metrics", SCORED_CTE + "," + AUC_SQL + """,
cm AS (SELECT count(*) AS n, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp,
              count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn,
              count(*) FILTER (WHERE p < 0.5 AND y <> 1) AS tn FROM sc)
SELECT round(auc.auc, 8) AS auc,
       round(CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END, 8) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 8) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 8) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 8) AS f1
FROM auc CROSS JOIN cm""")
def q_eval_metrics(spark, sf):
    return finalize(mt.eval_metrics(scored_events(spark, sf), "y", "p", 0.5), digits=8)


@register("classification_report", SCORED_CTE + """,
pr AS (SELECT y, CAST(p >= 0.3 AS INTEGER) AS pred FROM sc),
cls AS (SELECT DISTINCT y AS c FROM pr UNION SELECT DISTINCT pred FROM pr),
per AS (SELECT cls.c, count(*) FILTER (WHERE pr.y = cls.c AND pr.pred = cls.c) AS tp,
               count(*) FILTER (WHERE pr.pred = cls.c) AS pp, count(*) FILTER (WHERE pr.y = cls.c) AS support
        FROM cls CROSS JOIN pr GROUP BY cls.c),
rows_ AS (SELECT CAST(c AS VARCHAR) AS row,
                 CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS precision,
                 CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
                 CASE WHEN pp + support = 0 THEN 0.0 ELSE 2 * tp / (pp + support) END AS f1, support, tp FROM per)
SELECT row, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1,
       CAST(support AS BIGINT) AS support FROM rows_
UNION ALL
SELECT 'accuracy', round(sum(tp) / sum(support), 8), round(sum(tp) / sum(support), 8), round(sum(tp) / sum(support), 8),
       CAST(sum(support) AS BIGINT) FROM rows_
UNION ALL
SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8), CAST(sum(support) AS BIGINT)
FROM rows_
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8), round(sum(recall * support) / sum(support), 8),
       round(sum(f1 * support) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM rows_""")
def q_classification_report(spark, sf):
    s = scored_events(spark, sf).withColumn("pred", (F.col("p") >= 0.3).cast("int"))
    return finalize(mt.classification_report(s, "y", "pred"), digits=8)


# ------------------------------------------------------------ request projections

ALIGN_NAMES = ["Transaction Amount", "customer_age", "account_age_days", "quantity"]


@register("align_features", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, transaction_amount AS "Transaction Amount",
       CASE WHEN transaction_id % 10 = 0 THEN 0.0 ELSE CAST(customer_age AS DOUBLE) END AS customer_age,
       CAST(account_age_days AS DOUBLE) AS account_age_days, 0.0 AS quantity FROM txn_o""")
def q_align_features(spark, sf):
    t = fx.transactions_orders(spark, sf)
    payload = F.create_map(
        F.lit("Transaction Amount"), F.col("transaction_amount").cast("double"),
        F.lit("customer_age"), F.when(F.pmod("transaction_id", F.lit(10)) != 0, F.col("customer_age").cast("double")),
        F.lit("Account-Age-Days "), F.col("account_age_days").cast("double"),
        F.lit("unused_extra"), F.lit(1.0))
    req = t.select("transaction_id", payload.alias("features"))
    return finalize(scoring.align_features(req, ALIGN_NAMES, keep=["transaction_id"]), digits=None)


INFER_NAMES = ["transaction_amount", "log_amount", "account_age_days", "account_age_bucket", "customer_age_bucket",
               "customer_age", "hour_sin", "hour_cos", "is_night", "transaction_hour", "cust_total_txn", "quantity",
               "ip_txn_count"]


def _requests(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return t.select("transaction_id", (F.col("transaction_amount") / 100).alias("amount"),
                    F.col("account_age_days").alias("account_age"), (F.col("customer_age") * 2 - 30).alias("age"),
                    (F.col("transaction_hour") + F.pmod("transaction_id", F.lit(3)) * 12).alias("transaction_hour"),
                    F.col("quantity"))


@register("infer_features_from_request", f"""
WITH {TXN_O_CTE},
r AS (SELECT transaction_id, transaction_amount / 100 AS amount, CAST(account_age_days AS DOUBLE) AS acc,
             CAST(customer_age * 2 - 30 AS DOUBLE) AS age,
             CAST(transaction_hour + (transaction_id % 3) * 12 AS INTEGER) AS hr, quantity FROM txn_o)
SELECT transaction_id, round(coalesce(amount, 0.0), 8) AS transaction_amount,
       round(ln(1 + greatest(coalesce(amount, 0.0), 0.0)), 8) AS log_amount, acc AS account_age_days,
       CAST(CASE WHEN acc > -1 AND acc <= 30 THEN 0 WHEN acc > 30 AND acc <= 90 THEN 1 WHEN acc > 90 AND acc <= 180 THEN 2
            WHEN acc > 180 AND acc <= 365 THEN 3 WHEN acc > 365 AND acc <= 730 THEN 4
            WHEN acc > 730 AND acc <= 20000 THEN 5 ELSE -1 END AS DOUBLE) AS account_age_bucket,
       CAST(CASE WHEN age >= 0 AND age <= 20 THEN 0 WHEN age > 20 AND age <= 30 THEN 1 WHEN age > 30 AND age <= 40 THEN 2
            WHEN age > 40 AND age <= 50 THEN 3 WHEN age > 50 AND age <= 60 THEN 4
            WHEN age > 60 AND age <= 120 THEN 5 ELSE -1 END AS DOUBLE) AS customer_age_bucket,
       age AS customer_age, round(sin(2 * pi() * hr / 24.0), 8) AS hour_sin, round(cos(2 * pi() * hr / 24.0), 8) AS hour_cos,
       CAST(hr <= 6 OR hr >= 22 AS DOUBLE) AS is_night, CAST(hr AS DOUBLE) AS transaction_hour,
       0.0 AS cust_total_txn, CAST(CAST(trunc(coalesce(quantity, 0)) AS BIGINT) AS DOUBLE) AS quantity,
       0.0 AS ip_txn_count
FROM r""")
def q_infer_features_from_request(spark, sf):
    out = scoring.infer_features_from_request(_requests(spark, sf), INFER_NAMES, keep=["transaction_id"])
    return finalize(out, digits=8)


KEYWORD_NAMES = ["Transaction Amount", "Quantity", "Customer Age", "Account Age Days", "Transaction Hour",
                 "Payment Method"]


@register("map_inputs_by_keyword", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, transaction_amount AS "Transaction Amount",
       CAST(CAST(trunc(coalesce(quantity, 1)) AS BIGINT) AS DOUBLE) AS "Quantity",
       CAST(customer_age AS DOUBLE) AS "Customer Age", CAST(account_age_days AS DOUBLE) AS "Account Age Days",
       CAST(CASE WHEN transaction_id % 5 = 0 THEN 12 ELSE transaction_hour END AS DOUBLE) AS "Transaction Hour",
       transaction_amount AS "Payment Method"
FROM txn_o""")
def q_map_inputs_by_keyword(spark, sf):
    t = fx.transactions_orders(spark, sf)
    inputs = t.select("transaction_id", F.col("transaction_amount").alias("amount_input"),
                      F.col("quantity").alias("cust_total_txn_tx"), F.col("customer_age").alias("customer_age_input"),
                      F.col("account_age_days").alias("account_age_input"),
                      F.when(F.pmod("transaction_id", F.lit(5)) != 0, F.col("transaction_hour"))
                       .alias("transaction_hour_input"))
    return finalize(scoring.map_inputs_by_keyword(inputs, KEYWORD_NAMES, "tx", keep=["transaction_id"]), digits=None)


# ------------------------------------------------------------ model jobs (rows-only)
# All with the reference's rounds, trees, depths and iterations.


def _predict(model, df, feats, keep=("transaction_id", "is_fraudulent")):
    return ml.positive_probability(model, df.select(*dict.fromkeys((*keep, *feats))), feats).select(*keep, "prob")


def _bundle(spark, sf, **rounds):
    from .training import trained_bundle
    path = trained_bundle(spark, sf, **rounds)
    models, meta = ml.load_bundle(spark, path, ["a", "b"])
    return models, meta, spark.read.parquet(f"{path}/test")


@register("fit_boosted_a")
def q_fit_boosted_a(spark, sf, **rounds):
    models, meta, test = _bundle(spark, sf, **rounds)
    return _predict(models["a"], test, meta["feature_names"])


@register("fit_boosted_b")
def q_fit_boosted_b(spark, sf, **rounds):
    models, meta, test = _bundle(spark, sf, **rounds)
    return _predict(models["b"], test, meta["feature_names"])


TIME_FEATS = ["transaction_amount", "transaction_hour", "hour_sin", "hour_cos", "is_night", "is_weekend",
              "tx_count_1d", "amount_sum_1d", "amount_mean_1d"]


def _event_features(spark, sf):
    from ..functions import features as ff
    from ..operators.windows import velocity
    e = velocity(fx.transactions_events(spark, sf))
    return materialize(e.withColumns({
        "hour_sin": ff.hour_sin("transaction_hour"), "hour_cos": ff.hour_cos("transaction_hour"),
        "is_night": ff.is_night("transaction_hour"), "is_weekend": ff.is_weekend(ff.weekday("transaction_ts"))}))


def _time_split(spark, sf):
    return materialize(splits.time_split(_event_features(spark, sf), "transaction_ts", "transaction_id"))


def _refit(e, rounds):
    """The time model fitted on every labelled row, weighed by the positive rate of all of them."""
    return ml.fit(e, TIME_FEATS, ml.gbt_time("is_fraudulent", rounds), row_id="transaction_id")


@register("fit_boosted_time")
def q_fit_boosted_time(spark, sf, rounds=800):
    """Fit on the first 70 % of the time, the next 15 % giving the AUC of every round, then refit on all labelled rows.
    The rows of the last 15 % with the score of both: ``prob`` of the first fit, ``refit_prob`` of the final one."""
    e = _time_split(spark, sf)
    m = ml.fit(e.where(F.col("split") == "train"), TIME_FEATS, ml.gbt_time("is_fraudulent", rounds),
               e.where(F.col("split") == "valid"), "transaction_id")
    scored = _predict(m, e.where(F.col("split") == "test"), TIME_FEATS,
                      keep=("transaction_id", "is_fraudulent", *TIME_FEATS))
    return ml.positive_probability(_refit(e, rounds), scored, TIME_FEATS, "refit_prob").select(
        "transaction_id", "is_fraudulent", "prob", "refit_prob")


@register("validation_curve")
def q_validation_curve(spark, sf, **rounds):
    """AUC of the validation rows after every round of both stored models."""
    models, _meta, _test = _bundle(spark, sf, **rounds)
    return reduce(DataFrame.unionByName, [m.curve().select(F.lit(n).alias("model"), "round", "valid_auc")
                                          for n, m in models.items()])


@register("feature_importance")
def q_feature_importance(spark, sf, **rounds):
    """Splits and gain per feature of both stored models."""
    models, _meta, _test = _bundle(spark, sf, **rounds)
    return reduce(DataFrame.unionByName, [m.importance().select(F.lit(n).alias("model"), "name", "splits", "gain")
                                          for n, m in models.items()])


@register("holdout_predict")
def q_holdout_predict(spark, sf, rounds=800):
    """Fit on every labelled row, score the table as one without labels whose columns are aligned to the model's.  The
    holdout rows are those of the last 15 % of the time; they come without an id, which is their place in time."""
    e = _time_split(spark, sf)
    m = _refit(e, rounds)
    holdout = e.where(F.col("split") == "test").select("transaction_ts", *TIME_FEATS)
    return _predict(m, scoring.with_row_ids(holdout, "transaction_id", ["transaction_ts", *TIME_FEATS]), TIME_FEATS,
                    keep=("transaction_id",))


def _baseline(spark, sf, frame, estimator):
    """Fit on the train rows of a baseline's own frame, score its test rows; tree models weigh for themselves."""
    rows, feats = frame(fx.transactions_orders(spark, sf))
    rows = materialize(rows)
    train = rows.where(F.col("split") == "train")
    return _predict(ml.fit(train, feats, estimator(train), row_id="transaction_id"), rows.where(F.col("split") == "test"), feats)


@register("fit_gbt_simple")
def q_fit_gbt_simple(spark, sf, rounds=200):
    return _baseline(spark, sf, baselines.simple, lambda _t: ml.gbt_simple("is_fraudulent", rounds))


@register("fit_gbt_engineered")
def q_fit_gbt_engineered(spark, sf, rounds=400):
    return _baseline(spark, sf, baselines.engineered, lambda _t: ml.gbt_engineered("is_fraudulent", rounds))


@register("fit_random_forest")
def q_fit_random_forest(spark, sf, trees=300):
    return _baseline(spark, sf, baselines.simple, lambda _t: ml.random_forest("is_fraudulent", trees))


@register("fit_logistic")
def q_fit_logistic(spark, sf):
    # the row count (one number) scales the L2 penalty like C = 1
    return _baseline(spark, sf, baselines.simple, lambda t: ml.logistic("is_fraudulent", n_rows=t.count()))


@register("batch_score")
def q_batch_score(spark, sf, **rounds):
    """Requests -> inferred features, with the customer's history joined in -> blend of both stored models ->
    probability % and the decision at the stored threshold."""
    models, meta, _test = _bundle(spark, sf, **rounds)
    t = fx.transactions_orders(spark, sf)
    history = t.where("customer_id is not null").groupBy("customer_id").agg(
        F.count("transaction_amount").cast("double").alias("cust_total_txn"))
    req = _requests(spark, sf).join(t.select("transaction_id", "customer_id"), "transaction_id").join(
        history, "customer_id", "left")
    x = scoring.infer_features_from_request(req, meta["feature_names"], keep=["transaction_id"])
    p = scoring.blend_score(models, x, meta["feature_names"], meta["weights"], ["transaction_id"])
    return p.select("transaction_id", F.round(F.col("prob") * 100, 2).alias("fraud_probability"),
                    (F.col("prob") >= meta["threshold"]).cast("int").alias("prediction"))


@register("feature_names_metadata")
def q_feature_names_metadata(spark, sf, **rounds):
    _models, meta, _test = _bundle(spark, sf, **rounds)
    return ml.metadata_frame(spark, meta["feature_names"], meta["threshold"], tuple(meta["weights"].values()),
                             {"valid": meta["valid"], "test": meta["test"]})


@register("model_save_load")
def q_model_save_load(spark, sf, **rounds):
    """Both models, threshold, weights and names saved and loaded again; the reloaded blend scores the test rows."""
    models, meta, test = _bundle(spark, sf, **rounds)
    path = files.scratch_path(spark, "model")
    ml.save_bundle(spark, path, models, meta)
    again, stored = ml.load_bundle(spark, path, ["a", "b"])
    return scoring.blend_score(again, test, stored["feature_names"], stored["weights"], ["transaction_id", "is_fraudulent"])


def _feature_job_sql() -> str:
    from .common import CF_PROD_CTE, CF_TXN_CTE, norm_sql

    def hr(c):
        return f"least(greatest({c}, 0), 23)"
    dbl = ["transaction_amount", "quantity", "customer_age", "account_age_days", "cnt_txn_counterfeit_rate_pm",
           "cnt_txn_counterfeit_rate_loc_pm", "cnt_prod_counterfeit_rate_cat", "hour_sin", "hour_cos", "log_amount",
           "amount_per_unit", "cust_txn_per_day", "cust_txn_per_day_log", "cust_total_txn", "cust_total_amt",
           "cust_avg_amt", "cust_total_txn_log", "cust_total_amt_log", "ip_txn_count", "ip_txn_count_log",
           "device_txn_count", "device_txn_count_log"]
    ints = ["customer_id", "transaction_id", "transaction_hour", "is_fraudulent", "cnt_txn_count_pm",
            "cnt_txn_count_loc_pm", "cnt_prod_count_cat", "tx_dayofweek", "tx_day", "tx_month", "is_night",
            "is_weekend", "is_high_amount", "account_age_bucket", "customer_age_bucket"]
    strs = ["device_used", "ip_address", "customer_location_norm", "payment_method_norm", "payment_method",
            "product_category", "customer_location", "shipping_address", "billing_address", "product_category_norm"]
    sel = ([f"round(coalesce(CASE WHEN isfinite({c}) THEN {c} END, 0.0), 8) AS {c}" for c in dbl if c != "amount_per_unit"]
           + ["coalesce(CASE WHEN isfinite(amount_per_unit) THEN amount_per_unit END, 0.0) AS amount_per_unit"]
           + [f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ints] + strs
           + ["strftime(tx_date, '%Y-%m-%d') AS tx_date", "transaction_date"])
    acc = "CASE " + " ".join(
        f"WHEN account_age_days > {lo} AND account_age_days <= {hi} THEN {i}"
        for i, (lo, hi) in enumerate(zip([-1, 30, 90, 180, 365, 730], [30, 90, 180, 365, 730, 20000]))) + " ELSE -1 END"
    age = "CASE " + " ".join(
        f"WHEN customer_age {'>=' if i == 0 else '>'} {lo} AND customer_age <= {hi} THEN {i}"
        for i, (lo, hi) in enumerate(zip([0, 20, 30, 40, 50, 60], [20, 30, 40, 50, 60, 120]))) + " ELSE -1 END"
    return f"""
WITH {TXN_O_CTE}, {CF_TXN_CTE}, {CF_PROD_CTE},
pm AS (SELECT {norm_sql('payment_method')} AS k, count(involves_counterfeit) AS n,
              avg(CAST(involves_counterfeit AS DOUBLE)) AS r FROM cf_txn GROUP BY 1),
lp AS (SELECT {norm_sql('customer_location')} AS l, {norm_sql('payment_method')} AS p, count(involves_counterfeit) AS n,
              avg(CAST(involves_counterfeit AS DOUBLE)) AS r FROM cf_txn GROUP BY 1, 2),
ct AS (SELECT {norm_sql('category')} AS k, count(is_counterfeit) AS n, avg(CAST(is_counterfeit AS DOUBLE)) AS r
       FROM cf_prod GROUP BY 1),
e AS (SELECT t.*, {norm_sql('t.payment_method')} AS payment_method_norm,
             {norm_sql('t.product_category')} AS product_category_norm,
             {norm_sql('t.customer_location')} AS customer_location_norm,
             coalesce(pm.n, 0) AS cnt_txn_count_pm, coalesce(pm.r, 0.0) AS cnt_txn_counterfeit_rate_pm,
             coalesce(lp.n, 0) AS cnt_txn_count_loc_pm, coalesce(lp.r, 0.0) AS cnt_txn_counterfeit_rate_loc_pm,
             coalesce(ct.n, 0) AS cnt_prod_count_cat, coalesce(ct.r, 0.0) AS cnt_prod_counterfeit_rate_cat
      FROM txn_o t
      LEFT JOIN pm ON {norm_sql('t.payment_method')} = pm.k
      LEFT JOIN lp ON {norm_sql('t.customer_location')} = lp.l AND {norm_sql('t.payment_method')} = lp.p
      LEFT JOIN ct ON {norm_sql('t.product_category')} = ct.k),
b AS (SELECT * REPLACE (CAST(trunc(coalesce(CAST(transaction_hour AS DOUBLE), -1.0)) AS INTEGER) AS transaction_hour,
                        coalesce(transaction_amount, 0.0) AS transaction_amount,
                        CAST(account_age_days AS DOUBLE) AS account_age_days,
                        CAST(customer_age AS DOUBLE) AS customer_age),
             CAST(transaction_date AS DATE) AS tx_date, isodow(transaction_date) - 1 AS tx_dayofweek,
             day(transaction_date) AS tx_day, month(transaction_date) AS tx_month FROM e),
c AS (SELECT *, sin(2 * pi() * {hr('transaction_hour')} / 24.0) AS hour_sin,
             cos(2 * pi() * {hr('transaction_hour')} / 24.0) AS hour_cos,
             CAST({hr('transaction_hour')} <= 6 OR {hr('transaction_hour')} >= 22 AS INTEGER) AS is_night,
             CAST(tx_dayofweek IN (5, 6) AS INTEGER) AS is_weekend,
             ln(1 + greatest(transaction_amount, 0.0)) AS log_amount,
             coalesce(CASE WHEN quantity <> 0 AND isfinite(transaction_amount / quantity)
                           THEN transaction_amount / quantity END, transaction_amount) AS amount_per_unit FROM b),
s AS (SELECT quantile_cont(transaction_amount, 0.95) AS q95, quantile_cont(account_age_days, 0.5) AS m_acc,
             quantile_cont(customer_age, 0.5) AS m_age FROM c),
d AS (SELECT c.* REPLACE (coalesce(c.account_age_days, s.m_acc) AS account_age_days,
                          coalesce(c.customer_age, s.m_age) AS customer_age),
             CAST(c.transaction_amount >= s.q95 AS INTEGER) AS is_high_amount FROM c CROSS JOIN s),
d2 AS (SELECT *, {acc} AS account_age_bucket, {age} AS customer_age_bucket FROM d),
g1 AS (SELECT customer_id, tx_date, count(transaction_amount) AS n FROM c
       WHERE customer_id IS NOT NULL AND tx_date IS NOT NULL GROUP BY 1, 2),
g2 AS (SELECT customer_id, count(transaction_amount) AS n, sum(transaction_amount) AS s FROM c
       WHERE customer_id IS NOT NULL GROUP BY 1),
g3 AS (SELECT ip_address, count(transaction_amount) AS n FROM c WHERE ip_address IS NOT NULL GROUP BY 1),
g4 AS (SELECT device_used, count(transaction_amount) AS n FROM c WHERE device_used IS NOT NULL GROUP BY 1),
f AS (SELECT d2.*,
             CAST(coalesce(g1.n, 0) AS DOUBLE) AS cust_txn_per_day, ln(1 + coalesce(g1.n, 0)) AS cust_txn_per_day_log,
             CAST(coalesce(g2.n, 0) AS DOUBLE) AS cust_total_txn, coalesce(g2.s, 0.0) AS cust_total_amt,
             coalesce(CASE WHEN coalesce(g2.n, 0) > 0 THEN coalesce(g2.s, 0.0) / g2.n END, d2.transaction_amount)
               AS cust_avg_amt,
             ln(1 + coalesce(g2.n, 0)) AS cust_total_txn_log, ln(1 + coalesce(g2.s, 0.0)) AS cust_total_amt_log,
             CAST(coalesce(g3.n, 0) AS DOUBLE) AS ip_txn_count, ln(1 + coalesce(g3.n, 0)) AS ip_txn_count_log,
             CAST(coalesce(g4.n, 0) AS DOUBLE) AS device_txn_count, ln(1 + coalesce(g4.n, 0)) AS device_txn_count_log
      FROM d2
      LEFT JOIN g1 ON d2.customer_id = g1.customer_id AND d2.tx_date = g1.tx_date
      LEFT JOIN g2 ON d2.customer_id = g2.customer_id
      LEFT JOIN g3 ON d2.ip_address = g3.ip_address
      LEFT JOIN g4 ON d2.device_used = g4.device_used)
SELECT {", ".join(sel)}
FROM f"""


@register("feature_job", _feature_job_sql())
def q_feature_job(spark, sf):
    """The whole offline feature job (side rates, enrichment joins, date /
    hour / amount / age features, exact quantiles, entity counts)."""
    from .feature_job import build_features
    f = build_features(spark, sf).withColumn("tx_date", F.date_format("tx_date", "yyyy-MM-dd"))
    return finalize(f, digits=8, exact=("amount_per_unit",))


ASSEMBLED = ["transaction_amount", "quantity", "customer_age", "account_age_days", "transaction_hour", "hour_sin",
             "hour_cos", "is_night", "is_weekend", "log_amount", "is_high_amount", "cust_txn_per_day", "cust_total_txn",
             "cust_total_amt", "cust_avg_amt", "ip_txn_count", "device_txn_count", "account_age_bucket",
             "customer_age_bucket", "cnt_txn_counterfeit_rate_pm", "cnt_prod_count_cat"]


def _assembled_sql() -> str:
    values = ", ".join(f"coalesce(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END, 0.0)"
                       for c in ASSEMBLED)
    return f"""
SELECT transaction_id, len(x) AS n_features,
       array_to_string(list_transform(x, lambda v: CAST(round(v * 1e8) AS BIGINT)), ',') AS scaled
FROM (SELECT transaction_id, [{values}] AS x FROM ({_feature_job_sql()}))"""


@register("assemble_features", _assembled_sql())
def q_assemble_features(spark, sf):
    """The numeric features of the offline job as one vector a row, in a stated order, missing values 0; the vector is
    shown in whole hundred-millionths, which engines write alike."""
    from .feature_job import build_features
    f = ml.assemble_features(build_features(spark, sf), ASSEMBLED).select(
        "transaction_id", vector_to_array("features").alias("x"))
    shown = F.transform("x", lambda v: F.round(v * F.lit(1e8)).cast("long").cast("string"))
    return f.select("transaction_id", F.size("x").cast("long").alias("n_features"),
                    F.array_join(shown, ",").alias("scaled"))
