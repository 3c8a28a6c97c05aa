import pytest
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.functions.text import md5_mod
from giftlens.operators import products as P
from giftlens.operators import scoring as S

RATES = [("Home & Kitchen", "unisex", "male", 38, 0.426), ("Home & Kitchen", "unisex", "female", 27, 0.404),
         ("Bags", "female", "male", 55, 0.255), ("Bags", "female", "female", 52, 0.529),
         ("General", "unisex", "male", 16, 0.232), ("General", "unisex", "female", 48, 0.296)]


def test_noise_and_rule_rates(spark):
    df = spark.createDataFrame(RATES, "cat string, tgt string, g string, h int, rate double")
    out = df.select("h", "rate", md5_mod(F.concat("cat", "g", "tgt")).alias("h2"),
                    S.rule_rate(F.col("cat"), F.col("tgt"), F.col("g")).alias("rate2")).collect()
    for r in out:
        assert r.h == r.h2
        assert r.rate2 == pytest.approx(r.rate, abs=1e-9)


def test_product_hash_constants(spark):
    df = spark.createDataFrame([("Tisvilde Pizzaovn", "Tisvilde Pizzaovn", "", K.HOUSE_VENDOR.upper()),
                                ("Test Mug", "Ceramic Blue", "CM-001", "MugCo")],
                               "n string, m string, no string, v string")
    got = [r.h for r in df.select(P.present_hash(F.col("n"), F.col("m"), F.col("no"), F.col("v")).alias("h")).collect()]
    assert got == ["BF9A4C7D817852C5EB270C7386DB6070", "F53A61D2DF859665EF41FE73E0DF6F54"]


def test_description_rules_substring_and_order(spark):
    df = spark.createDataFrame([("Woven basket",), ("Toiletry bag",), ("Pizza BAG",), ("Lamp",)], "d string")
    got = [r.c for r in df.select(S.classify_description(F.col("d"))["product_main_category"].alias("c")).collect()]
    assert got == ["Home & Kitchen", "Bags", "Home & Kitchen", "General"]


def test_score_fallback_zero_exposure_and_confidence(spark):
    req = spark.createDataFrame([("r1", "12345678", 0, 10, "1", "Tisvilde Pizzaovn")],
                                "request_id string, cvr string, male_count int, female_count int, "
                                "product_id string, description string")
    r = S.score_fallback(req).first()
    assert r.male_rate == 0.0 and r.female_rate == pytest.approx(0.404)
    assert r.expected_qty == pytest.approx(4.04)
    assert r.confidence_score == 0.95


def test_validation_rules(spark):
    rows = [("a", "123456789", 1, 1, "1", "x"), ("b", " 12345678 ", 0, 0, "1", "x"),
            ("c", "12345678", 20000, 0, "1", "x")] + [("d", "12345678", 1, 1, str(i), "x") for i in range(101)]
    req = spark.createDataFrame(rows, "request_id string, cvr string, male_count int, female_count int, "
                                      "product_id string, description string")
    got = {r.request_id: r.errors for r in S.validate_requests(req).collect()}
    assert got["a"] == "cvr_format"
    assert got["b"] == "total_zero"
    assert got["c"] == "count_too_high,total_too_high"
    assert got["d"] == "too_many_presents"
