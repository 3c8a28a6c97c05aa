import math

import pytest

from giftlens.operators import quality as Q


def test_key_violations_counts(spark):
    presents = spark.createDataFrame([("H1",), ("H1",), ("H2",)], "present_hash string")
    users = spark.createDataFrame([(1, "a", "k1"), (2, "a", "k2"), (3, "b", "k2")], "id long, username string, api_key string")
    log = spark.createDataFrame([(1,), (9,), (9,)], "user_id long")
    got = {r.check: r.violations for r in Q.key_violations(presents, users, log).collect()}
    assert got == {"present_hash_unique": 1, "username_unique": 1, "api_key_unique": 1, "log_user_fk": 2}


def test_data_profile_checks(spark):
    rows = [("x", None)] * 6 + [("y", "v")] * 4
    prof = {r.column_name: r for r in Q.data_profile(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).collect()}
    assert prof["a"].n_distinct == 2 and prof["a"].min_category_count == 4 and not prof["a"].min_records_ok
    assert prof["b"].n_missing == 6 and prof["b"].missing_ratio == pytest.approx(0.6) and not prof["b"].missing_ok


def test_regression_metrics_formulas(spark):
    ys, ps = [0.0, 1.0, 2.0, 4.0], [0.5, 1.0, 1.5, 5.0]
    df = spark.createDataFrame(list(zip(ys, ps)), "y double, p double")
    m = Q.regression_metrics(df).first()
    n = len(ys)
    ybar = sum(ys) / n
    sse = sum((y - p) ** 2 for y, p in zip(ys, ps))
    sst = sum((y - ybar) ** 2 for y in ys)
    assert m.r2 == pytest.approx(1 - sse / sst)
    assert m.mae == pytest.approx(sum(abs(y - p) for y, p in zip(ys, ps)) / n)
    assert m.rmse == pytest.approx(math.sqrt(sse / n))
    assert m.mape == pytest.approx(sum(abs(y - p) / (y + 1e-8) for y, p in zip(ys, ps)) / n * 100, rel=1e-9)
    assert m.mape_nonzero == pytest.approx((0 + 0.25 + 0.25) / 3 * 100)
    d = Q.poisson_deviance(df, "y", "p").first()
    exp = 2 * sum((y * math.log(y / p) if y > 0 else 0.0) - (y - p) for y, p in zip(ys, ps))
    assert d.deviance == pytest.approx(exp)


def test_exposure_mismatch_full_outer(spark):
    tf = spark.createDataFrame([("c1", "male", 3.0), ("c1", "female", 4.0), ("c2", "male", 1.0)],
                               "company_cvr string, employee_gender string, exposure double")
    emp = spark.createDataFrame([("c1", 3.0, 5.0), ("c3", 1.0, 1.0)], "company_cvr string, male_count double, female_count double")
    got = {r.company_cvr: r.abs_difference for r in Q.exposure_mismatch(tf, emp).collect()}
    assert got == {"c1": 1.0, "c2": 1.0, "c3": 2.0}
