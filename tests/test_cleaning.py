from pyspark.sql import functions as F

from giftlens.functions import cleaning as C


def test_strip_quotes_then_whitespace(spark):
    df = spark.createDataFrame([('"ab" ',), ('  "x"',), ("\tNONE\n",)], "v string")
    got = [r.v for r in df.select(C.strip_text(F.col("v")).alias("v")).collect()]
    assert got == ['ab"', '"x', "NONE"]


def test_na_tokens_and_none_text(spark):
    df = spark.createDataFrame([("NA",), ("NONE",), ("n/a",), ("",), ("ok",)], "v string")
    got = [r.v for r in df.select(C.na_to_null(F.col("v")).alias("v")).collect()]
    assert got == [None, "NONE", None, None, "ok"]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("abc",), ("nan",), ("",), ("12",), (None,)], "v string")
    got = [r.v for r in df.select(C.lenient_double(F.col("v")).alias("v")).collect()]
    assert got == [0.0, 0.0, 0.0, 12.0, 0.0]


def test_clean_selections_lowercases_and_fills(spark):
    df = spark.createDataFrame([(" MALE ", None, "Brand")], "employee_gender string, product_color string, product_brand string")
    r = C.clean_selections(df).first()
    assert (r.employee_gender, r.product_color, r.product_brand) == ("male", "NONE", "Brand")


def test_align_schema(spark):
    df = spark.createDataFrame([("a", "3", "x")], "shop_id string, company_total_selections string, extra string")
    out = C.align_schema(df, ["shop_id", "gift_id", "company_total_selections"])
    assert out.columns == ["shop_id", "gift_id", "company_total_selections"]
    assert out.first().asDict() == {"shop_id": "a", "gift_id": "NONE", "company_total_selections": 3.0}


def test_strip_text_equals_trimming_by_sets_of_characters(spark):
    texts = ["a", "", " a", "a\n", "a\nb", '"a"', '" a "', "æble", "a ", "\x1ca", "~x!", None, '""', "a b", "a\x7f", "\U0001f600 "]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    full = F.btrim(F.btrim("v", F.lit('"')), F.lit(C.WHITESPACE))
    found = df.select(C.strip_text(F.col("v")).alias("a"), full.alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]
