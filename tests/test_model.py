import pytest
from pyspark.sql import functions as F

from giftlens.operators import features as FE
from giftlens.operators import model as M
from giftlens.operators import split as SP
from giftlens.plans.q_training import training

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    tf = training(spark, SF).cache()
    split = SP.company_split(tf)
    train = SP.apply_split(tf, split, "train")
    val = SP.apply_split(tf, split, "validation")
    return tf, FE.company_features(train), FE.company_features(val, source=train)


@pytest.mark.parametrize("opts", [dict(encoding="target"), dict(encoding="label", scaling="standard"),
                                  dict(encoding="onehot", scaling="minmax", max_features=5),
                                  dict(encoding="target", scaling="robust", interaction_features=96)])
def test_pipeline_variants_train_and_clamp(spark, parts, opts):
    _, train, val = parts
    model, preds = M.train_model(train, val, max_iter=2, **opts)
    r = preds.agg(F.min("predicted_rate").alias("lo"), F.max("predicted_rate").alias("hi"),
                  F.count(F.lit(1)).alias("n")).first()
    assert r.n == val.count() and 0.0 <= r.lo <= r.hi <= 1.0


def test_save_load_and_model_scoring(spark, parts, tmp_path):
    _, train, val = parts
    model, _ = M.train_model(train, val, max_iter=2)
    M.save_model(model, str(tmp_path), {"r2": 0.1}, ["a"], ["a"], spark)
    loaded, meta = M.load_model(str(tmp_path), spark)
    info = M.model_info(spark, loaded, meta).first()
    assert info.model_loaded and info.target == "selection_rate"
    none, _ = M.load_model(str(tmp_path / "absent"), spark)
    assert none is None
    req = spark.createDataFrame([("r1", "10000001", 3, 0, "1", "pizza oven")],
                                "request_id string, cvr string, male_count int, female_count int, "
                                "product_id string, description string")
    s = M.score_requests(req, loaded, FE.company_stats(train)).first()
    assert s.female_rate == 0.0 and s.expected_qty >= 0


def test_trees_train_score_and_are_stored(spark, parts, tmp_path):
    _, train, val = parts
    model, preds = M.train_model(train, val, iterations=2, depth=2)
    r = preds.agg(F.min("predicted_rate").alias("lo"), F.max("predicted_rate").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert r.n == val.count() and 0.0 <= r.lo <= r.hi <= 1.0
    assert len(model.pipeline.validation_rmse) == 3 and model.pipeline.validation_rmse[-1] < model.pipeline.validation_rmse[0]
    M.save_model(model, str(tmp_path), {"r2": 0.1}, ["a"], ["a"], spark)
    loaded, meta = M.load_model(str(tmp_path), spark)
    assert meta["engine"] == "trees" and loaded.pipeline == model.pipeline
    req = spark.createDataFrame([("r1", "10000001", 3, 0, "1", "pizza oven")],
                                "request_id string, cvr string, male_count int, female_count int, product_id string, description string")
    s = M.score_requests(req, loaded, FE.company_stats(train)).first()
    assert s.female_rate == 0.0 and s.expected_qty >= 0
    with pytest.raises(TypeError):
        M.train_model(train, val, engine="mllib", iterations=3)


def test_grid_search_over_company_folds(spark, parts):
    tf, _, _ = parts
    out = M.grid_search(tf, SP.cv_folds(tf), [{"max_depth": 2}, {"max_depth": 3}], max_iter=2).collect()
    assert len(out) == 2 and all(r.folds >= 1 for r in out)


def test_cross_validation_scores_the_model(spark, parts):
    tf, _, _ = parts
    out = M.cross_validate(tf, SP.cv_folds(tf), max_iter=2).collect()
    assert sorted(r.fold for r in out) == sorted({r.fold for r in SP.cv_folds(tf).select("fold").distinct().collect()})
    assert all(r.n > 0 and r.r2 is not None for r in out)


def test_encodings_are_smoothed_training_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "k string, label double")
    e = M.TargetEncodings.fit(df, ["k"], smoothing=2.0)
    got = {r.k: r.k__te for r in e.apply(spark.createDataFrame([("a",), ("b",), ("new",)], "k string"), ["k"]).collect()}
    prior = 2 / 3
    assert got == pytest.approx({"a": (1 + 2 * prior) / 4, "b": (1 + 2 * prior) / 3, "new": prior})


def test_a_gift_listed_twice_keeps_both_rows(spark, parts):
    _, train, val = parts
    model, _ = M.train_model(train, val, max_iter=2)
    req = spark.createDataFrame([("r1", "10000001", 3, 4, "1", "pizza oven")] * 2,
                                "request_id string, cvr string, male_count int, female_count int, "
                                "product_id string, description string")
    rows = M.score_requests(req, model, FE.company_stats(train)).collect()
    assert len(rows) == 2 and all(r.total_exposure == 7 for r in rows)


def test_poisson_with_exposure_offset(spark, parts):
    _, train, val = parts
    _, _, scored = M.fit_poisson(train, val)
    r = scored.agg(F.sum("label").alias("y"), F.sum("expected_count").alias("p"), F.min("expected_count").alias("lo")).first()
    assert r.lo >= 0 and r.y > 0 and 0.2 < r.p / r.y < 5


def test_feature_scores_equal_formulas(spark):
    import math
    from collections import Counter
    rows = [("a", "p", 0.0), ("a", "q", 0.0), ("a", "p", 1.0), ("b", "q", 1.0), ("b", "p", 1.0), (None, "q", 0.0), ("b", "p", 0.0)]
    got = {r.feature: r for r in M.feature_scores(spark.createDataFrame(rows, "f string, g string, label double"), ["f", "g"], bins=2).collect()}
    for k, name in enumerate(("f", "g")):
        n, cut = len(rows), 0.0
        xy = Counter((r[k], r[2] > cut) for r in rows)
        x, y = Counter(r[k] for r in rows), Counter(r[2] > cut for r in rows)
        chi2 = sum((xy[a, b] - x[a] * y[b] / n) ** 2 / (x[a] * y[b] / n) for a in x for b in y)
        mi = sum(c / n * math.log(c * n / (x[a] * y[b])) for (a, b), c in xy.items())
        assert got[name].chi2 == pytest.approx(chi2) and got[name].mutual_information == pytest.approx(mi) and got[name].n == n


def test_queries_train_until_patience_or_the_trainers_own_limit(spark, monkeypatch):
    import random

    from giftlens import constants as K
    from giftlens.plans import q_model as QM
    rng = random.Random(1)
    rows = [(f"shop{c % 2}", str(10000001 + c), f"g{g}", gender, int(rng.random() < 0.4), 10.0, rng.random() * (g % 5) / 5,
             *[f"{column[-3:]}{g % 3}" for column in K.PRODUCT_COLUMNS]) for c in range(10) for g in range(12) for gender in K.GENDERS]
    frame = spark.createDataFrame(rows, [*K.GROUP_KEYS, "selection_count", "exposure", "selection_rate", *K.PRODUCT_COLUMNS])
    monkeypatch.setattr(QM, "training", lambda spark, sf: frame)
    model, preds, _ = QM._fit(spark, "none")
    tried, kept = len(model.pipeline.validation_rmse) - 1, len(model.pipeline.trees)
    assert tried == K.GBT_ITERATIONS or tried - kept == K.GBT_EARLY_STOP_ROUNDS
    assert tried > 5 and preds.count() == 48
