import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from giftlens.operators.features import fold_shop_features, ordered_target_stats
from giftlens.operators.quality import baseline_predict, cv_fold_metrics, outlier_report, regression_metrics
from giftlens.operators.ranges import order_statistics, prefix_sums, quantiles, ranks_within


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def grouped(spark):
    """A third of the rows in one group, long runs of ties, a null group and null order values."""
    rng = random.Random(2)
    rows = [("hot", rng.choice([1, 1, 1, 2, 3, rng.randrange(500)]), k) for k in range(400)]
    rows += [(rng.choice(["a", "b", None, "hot2"]), rng.choice([None, 5, 5, rng.randrange(9)]), 400 + k) for k in range(800)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, o long, id long").repartition(7)


def test_ranks_equal_brute_force(grouped):
    rows, df = grouped
    key = lambda o: (o is not None, o or 0)  # noqa: E731  nulls first
    by = defaultdict(list)
    for g, o, _ in rows:
        by[g].append(key(o))
    want = {i: (1 + sum(x < key(o) for x in by[g]), 1 + len({x for x in by[g] if x < key(o)})) for g, o, i in rows}
    got = ranks_within(df, ["g"], ["o"], "r", "d")
    found = [(r.id, (r.r, r.d)) for r in got.collect()]
    assert len(found) == len(rows) and dict(found) == want


def test_prefix_sums_equal_brute_force_over_many_ranges(spark, grouped):
    rows, df = grouped
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 23)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = prefix_sums(df.withColumn("m", F.col("id") % 10), ["g"], ["id"], ["m"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {i: sum(k % 10 for h, _, k in rows if h == g and k < i) for g, _, i in rows}
    assert {r.id: r.m_before for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("kind", ["ties", "spread", "edges", "few"])
def test_order_statistics_equal_sorting(spark, kind):
    rng = random.Random(7)
    x = {"ties": [rng.choice([0.0, 1.0, 1.0, 2.5]) for _ in range(6000)] + [1e9],
         "spread": [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(9000)],
         "edges": [-1.7e308, 1.7e308, 5e-324, -0.0, 0.0] * 2 + [rng.random() for _ in range(5000)],
         "few": [3.0, 1.0, 2.0]}[kind]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double").repartition(5)
    places = sorted({0, 1, len(x) // 4, len(x) // 2, len(x) - 2, len(x) - 1})
    assert order_statistics(df, "v", places) == [sorted(x)[p] for p in places]
    assert quantiles(df, "v", [0.25, 0.75]) == pytest.approx(np.quantile(x, [0.25, 0.75]).tolist(), rel=1e-12)
    with pytest.raises(ValueError):
        order_statistics(df, "v", [len(x)])


def test_outliers_by_hand(spark):
    x = [1.0, 2.0, 3.0, 4.0] * 30 + [50.0, -40.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    r = outlier_report(df, "v").first()
    assert (r.q1, r.q3) == tuple(np.quantile(x, [0.25, 0.75])) and r.iqr_outliers == 3
    assert r.zscore_outliers == 1 + sum(abs(v - np.mean(x)) > 3 * np.std(x) for v in x)
    none = outlier_report(df.where("v is null"), "v").first()
    assert none.q1 is None and none.iqr_outliers == 0 and none.zscore_outliers == 0


FRAME = "company_cvr string, shop_id string, gift_id string, employee_gender string, selection_rate double, selection_count long, " \
        "product_brand string, product_main_category string, product_utility_type string"


def frame(spark, seed=3, n=400):
    rng = random.Random(seed)
    rows = [(f"c{rng.randrange(12)}", f"s{rng.randrange(3)}", rng.choice([None, *"abcdef"]), rng.choice(["male", "female"]),
             rng.choice([None, round(rng.random(), 3)]), rng.randrange(3), rng.choice("xyz"), rng.choice([None, "m", "n", "o"]), rng.choice("uv"))
            for _ in range(n)]
    folds = [(f"c{k}", k % 3 if k != 11 else 1) for k in range(12)]
    return rows, folds, spark.createDataFrame(rows, FRAME), spark.createDataFrame(folds, "company_cvr string, fold int")


def test_folds_in_one_pass_equal_a_fit_per_fold(spark):
    rows, folds, tf, folds_df = frame(spark)
    tf = tf.where("selection_rate is not null and gift_id is not null")
    got = {r.fold: (r.n, r.r2) for r in cv_fold_metrics(tf, folds_df).collect()}
    tagged = tf.join(folds_df, "company_cvr")
    for k in range(3):
        scored = baseline_predict(tagged.where(f"fold <> {k}"), tagged.where(f"fold = {k}")).selectExpr("selection_rate as y", "prediction as p")
        m = regression_metrics(scored).first()
        assert got[k][0] == m.n and got[k][1] == pytest.approx(m.r2, abs=1e-9)
    assert cv_fold_metrics(tf, folds_df.where("fold < 2")).count() == 2


def test_fold_shop_features_equal_a_pass_per_fold(spark):
    rows, folds, tf, folds_df = frame(spark, 5)
    fold = dict(folds)
    got = {(r.shop_id, r.fold): tuple(r)[2:] for r in fold_shop_features(tf, folds_df).collect()}
    pos = [r for r in rows if r[5] > 0]
    for shop in {r[1] for r in pos}:
        for k in range(3):
            rest = [r for r in pos if r[1] == shop and fold[r[0]] != k]
            want = (sum(r[5] for r in rest), *[len({r[i] for r in rest} - {None}) for i in (2, 7, 6, 8)])
            assert got.pop((shop, k)) == want
    assert not got


def test_ordered_statistics_never_see_their_own_label(spark):
    rng = random.Random(6)
    rows = [(str(k), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([0.0, 0.25, 1.0, None])) for k in range(500)]
    df = spark.createDataFrame(rows, "id string, cat string, y double")
    one = {r.id: r.cat_ts for r in ordered_target_stats(df, ["cat"], "y", ["id"]).collect()}
    assert len(one) == len(rows)
    for k in (3, 77, 410):  # another label for one row moves later rows only, never the row itself
        other = df.withColumn("y", F.when(F.col("id") == str(k), 9.0).otherwise(F.col("y")))
        two = {r.id: r.cat_ts for r in ordered_target_stats(other, ["cat"], "y", ["id"]).collect()}
        assert two[str(k)] == one[str(k)]
    import hashlib
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0]))
    total, count = Counter(), Counter()
    for i, c, y in order:
        assert one[i] == pytest.approx((total[c] + 0.5) / (count[c] + 1), abs=1e-12)
        total[c] += y or 0.0
        count[c] += 1
    text = plan_of(ordered_target_stats(df, ["cat"], "y", ["id"]))
    # rows meet in (range, column, category); a window by category alone sees one total per range
    assert "windowspecdefinition(_range" in text
    assert all(re.match(r"#\d+, value#\d+, _range#\d+ ASC", t) for t in text.split("windowspecdefinition(cat")[1:])
