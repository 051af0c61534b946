"""Rows-only operators (model fits, scoring): shape, ranges, repeatability."""

from pyspark.sql import functions as F

from riskloom.operators import ml, scoring
from riskloom.plans import baselines, q_ml
from riskloom.sources import fixtures as fx

from conftest import SF_SMALL


def _probs_ok(df, col="prob"):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r.n > 0 and 0.0 <= r.lo <= r.hi <= 1.0


def test_gbt_time_model_and_holdout(spark):
    a = q_ml.q_fit_boosted_time(spark, SF_SMALL, rounds=5)
    assert _probs_ok(a)
    h = q_ml.q_holdout_predict(spark, SF_SMALL, rounds=5)
    n = fx.table(spark, SF_SMALL, "events").count()
    assert a.count() == h.count() == n - int(n * 0.85)
    # the holdout rows had no id: theirs is their place
    assert sorted(r[0] for r in h.select("transaction_id").collect()) == list(range(h.count()))


def test_time_model_is_refitted_on_all_rows(spark):
    out = q_ml.q_fit_boosted_time(spark, SF_SMALL, rounds=4).collect()
    h = q_ml.q_holdout_predict(spark, SF_SMALL, rounds=4).collect()  # the refit, on the same rows without their ids
    assert sorted(r.refit_prob for r in out) == sorted(r.prob for r in h)
    assert sorted(r.refit_prob for r in out) != sorted(r.prob for r in out)
    # the first fit has only seen the first 70 % of the time
    e = q_ml._time_split(spark, SF_SMALL)
    m = ml.fit(e.where("split = 'train'"), q_ml.TIME_FEATS, ml.gbt_time("is_fraudulent", 4), row_id="transaction_id")
    first = {r.transaction_id: r.prob for r in q_ml._predict(m, e.where("split = 'test'"), q_ml.TIME_FEATS).collect()}
    assert {r.transaction_id: r.prob for r in out} == first


def test_ids_are_kept_or_generated(spark):
    rows = spark.createDataFrame([(3.0, 9), (1.0, 7), (2.0, None)], "x double, id long")
    assert scoring.with_row_ids(rows, "ID", ["x"]) is rows
    made = scoring.with_row_ids(rows.drop("id"), "id", ["x"]).collect()
    assert sorted((r.x, r.id) for r in made) == [(1.0, 0), (2.0, 1), (3.0, 2)]


def test_baselines_on_their_own_features(spark):
    t = fx.transactions_orders(spark, SF_SMALL)
    n = t.count()
    for frame, query, rounds in ((baselines.simple, q_ml.q_fit_gbt_simple, {"rounds": 3}),
                                 (baselines.engineered, q_ml.q_fit_gbt_engineered, {"rounds": 3}),
                                 (baselines.simple, q_ml.q_fit_random_forest, {"trees": 3}),
                                 (baselines.simple, q_ml.q_fit_logistic, {})):
        out = query(spark, SF_SMALL, **rounds)
        assert _probs_ok(out) and abs(out.count() - 0.3 * n) <= 2
    rows, names = baselines.engineered(t)
    assert rows.count() == n and {"tx_count_7d", "PM_1-URGENT", "address_match"} <= set(names)


def test_engineered_steps_start_from_written_tables(spark, monkeypatch):
    """A plan that holds the earlier steps repeats them, and their shuffles, in each later one."""
    plans, tables = [], []
    for module, name in ((baselines.windows, "velocity"), (baselines.windows, "customer_tx_count_ratio"),
                         (baselines.splits, "stratified_split")):
        def step(df, *args, _run=getattr(module, name), **more):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            tables.append(df.columns)
            return _run(df, *args, **more)
        monkeypatch.setattr(module, name, step)
    t = fx.transactions_orders(spark, SF_SMALL)
    rows, _ = baselines.engineered(t)
    assert len(plans) == 4 and not any("Window" in p for p in plans)
    assert not any("Join" in p for p in plans[1:])  # the first one has the medians beside the rows
    assert not any({"ip_address", "shipping_address", "customer_location"} & set(c) for c in tables)
    # what is left behind still reads: the split has a table of its own
    assert rows.count() == t.count()


def test_estimators_have_the_stated_settings():
    def of(s):
        return (s.rounds, s.learning_rate, s.max_leaves, s.max_depth, s.min_rows, s.min_hessian, s.l1, s.l2, s.rows,
                s.columns, s.positive_weight)
    assert of(ml.gbt_a("y")) == (1200, 0.05, 96, 0, 40, 1e-3, 1.0, 3.0, 0.9, 0.8, False)
    assert of(ml.gbt_b("y")) == (900, 0.05, 0, 7, 1, 4.0, 0.5, 3.0, 0.9, 0.8, True)
    assert of(ml.gbt_time("y")) == (800, 0.05, 128, 0, 40, 1e-3, 1.0, 2.0, 0.8, 0.8, True)
    assert of(ml.gbt_simple("y")) == (200, 0.1, 0, 4, 1, 1.0, 0.0, 1.0, 0.9, 0.9, False)
    assert of(ml.gbt_engineered("y")) == (400, 0.05, 0, 6, 1, 1.0, 0.0, 1.0, 0.9, 0.9, True)
    f = ml.random_forest("y")
    assert (f.trees, f.columns, f.balanced) == (300, 0, True)
    assert ml.logistic("y").getMaxIter() == 1000


def test_fit_is_repeatable(spark):
    t = fx.transactions_events(spark, SF_SMALL).withColumn("h", F.col("transaction_hour").cast("double"))
    feats = ["transaction_amount", "h"]
    m1 = ml.fit(t, feats, ml.gbt_simple("is_fraudulent", 5))
    m2 = ml.fit(t, feats, ml.gbt_simple("is_fraudulent", 5))
    p1 = ml.positive_probability(m1, t, feats).select("transaction_id", "prob")
    p2 = ml.positive_probability(m2, t, feats).select("transaction_id", F.col("prob").alias("prob2"))
    diff = p1.join(p2, "transaction_id").agg(F.max(F.abs(F.col("prob") - F.col("prob2")))).first()[0]
    assert diff == 0.0


def test_batch_score_percent_and_decision(spark):
    t = fx.transactions_events(spark, SF_SMALL)
    feats = ["transaction_amount", "transaction_hour"]
    m = ml.fit(t.withColumn("transaction_hour", F.col("transaction_hour").cast("double")), feats,
               ml.logistic("is_fraudulent", 50))
    req = t.select("transaction_id", F.col("transaction_amount").alias("amount"), "transaction_hour")
    x = scoring.infer_features_from_request(req, feats, keep=["transaction_id"])
    s = scoring.batch_score(m, x, feats, 0.3, keep=["transaction_id"])
    r = s.agg(F.min("fraud_probability"), F.max("fraud_probability"), F.count(F.lit(1))).first()
    assert 0 <= r[0] <= r[1] <= 100 and r[2] == t.count()


def test_pad_trim(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],), (None,)], "v array<double>")
    out = [r[0] for r in df.select(scoring.pad_trim(F.col("v"), 3)).collect()]
    assert out == [[1.0, 2.0, 0.0], [1.0, 2.0, 3.0], [0.0, 0.0, 0.0]]


def test_bundle_scores_alike_after_reload(spark):
    small = {"rounds_a": 3, "rounds_b": 2}
    out = q_ml.q_model_save_load(spark, SF_SMALL, **small)
    assert _probs_ok(out)
    a = {r.transaction_id: r.prob for r in q_ml.q_fit_boosted_a(spark, SF_SMALL, **small).collect()}
    b = {r.transaction_id: r.prob for r in q_ml.q_fit_boosted_b(spark, SF_SMALL, **small).collect()}
    assert all(abs(r.prob - 0.6 * a[r.transaction_id] - 0.4 * b[r.transaction_id]) < 1e-12 for r in out.collect())
    assert len(a) == len(b) == out.count()
    curve = q_ml.q_validation_curve(spark, SF_SMALL, **small).collect()
    assert sorted((r.model, r.round) for r in curve) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    gains = q_ml.q_feature_importance(spark, SF_SMALL, **small).where("splits > 0")
    assert gains.where("gain <= 0").isEmpty() and not gains.isEmpty()
    meta = q_ml.q_feature_names_metadata(spark, SF_SMALL, **small).first()
    assert list(meta.weights) == [0.6, 0.4] and 0.1 <= meta.threshold <= 0.91 and "cust_total_txn" in meta.feature_names
    scored = q_ml.q_batch_score(spark, SF_SMALL, **small)
    r = scored.agg(F.min("fraud_probability"), F.max("fraud_probability"), F.count(F.lit(1)),
                   F.countDistinct("transaction_id")).first()
    assert 0 <= r[0] <= r[1] <= 100 and r[2] == r[3] == fx.table(spark, SF_SMALL, "orders").count()
    cut = round(100 * meta.threshold, 2)
    assert scored.where(f"fraud_probability > {cut} + 0.01 and prediction = 0").isEmpty()
    assert scored.where(f"fraud_probability < {cut} - 0.01 and prediction = 1").isEmpty()


def test_streaming_model_score_equals_batch(spark):
    from riskloom.sources.files import scratch_path
    from riskloom.streaming.scoring import model_score, score_directory_once
    t = fx.transactions_events(spark, SF_SMALL)
    feats = ["transaction_amount", "transaction_hour"]
    m = ml.fit(t.withColumn("transaction_hour", F.col("transaction_hour").cast("double")), feats,
               ml.gbt_simple("is_fraudulent", 5))
    req = t.select("transaction_id", F.col("transaction_amount").alias("amount"), "transaction_hour")
    src = scratch_path(spark, "test-stream-src")
    req.repartition(4).write.parquet(src)
    streamed = score_directory_once(spark, src, req.schema, model_score(m, feats))
    batch = model_score(m, feats)(req)
    a = sorted(tuple(r) for r in streamed.collect())
    b = sorted(tuple(r) for r in batch.collect())
    assert a == b and len(a) == t.count()


def test_models_with_summary_score_after_written_side(spark):
    # regression: session-level state left by helper jobs must not make
    # models that keep a training summary (LR) unserializable
    from riskloom.operators.joins import written_side
    written_side(spark.range(5)).count()
    t = fx.transactions_events(spark, SF_SMALL).withColumn("h", F.col("transaction_hour").cast("double"))
    feats = ["transaction_amount", "h"]
    m = ml.fit(t, feats, ml.logistic("is_fraudulent", 20))
    assert _probs_ok(ml.positive_probability(m, t, feats))


def test_logistic_meets_its_first_order_condition(spark):
    # at the minimum of summed log loss + |w|^2 / 2 the gradient is zero, and the intercept is not penalised
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] + 0.3)))).astype(int)
    t = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    m = ml.fit(t, ["a", "b"], ml.logistic("y", n_rows=400)).stages[-1]
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05
