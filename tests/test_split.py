from pyspark.sql import functions as F

from giftlens.operators import split as SP


def test_global_rank_matches_sorted_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    r = SP.global_rank(df, [F.col("k")]).collect()
    assert sorted((x.k, x.rank) for x in r) == [(i, i) for i in range(1000)]
    assert {x.n for x in r} == {1000}


def test_company_split_sizes_and_no_overlap(spark):
    df = spark.createDataFrame([(str(10000000 + i),) for i in range(23)], "company_cvr string")
    s = SP.company_split(df)
    assert s.filter("split = 'validation'").count() == 5  # ceil(0.2 * 23)
    train = SP.apply_split(df, s, "train")
    val = SP.apply_split(df, s, "validation")
    assert SP.split_overlap(train, val).first().overlap_companies == 0
    folds = {r.fold: 0 for r in SP.cv_folds(df).collect()}
    assert set(folds) == {0, 1, 2}


def test_stratified_split_per_stratum(spark):
    rows = [(str(10000000 + i), "big" if i < 40 else "small") for i in range(47)]
    df = spark.createDataFrame(rows, "company_cvr string, size_band string")
    out = SP.stratified_split(df, "size_band").groupBy("size_band", "split").count().collect()
    got = {(r.size_band, r.split): r["count"] for r in out}
    assert got[("big", "validation")] == 8 and got[("small", "validation")] == 2  # ceil(.2*40), ceil(.2*7)
    assert got[("big", "train")] == 32 and got[("small", "train")] == 5
