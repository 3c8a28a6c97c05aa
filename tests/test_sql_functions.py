from pyspark.sql import functions as F

from giftlens.functions.sql import register_sql_functions
from giftlens.functions.text import first_name, md5_mod, normalize_name
from giftlens.operators.products import present_hash
from giftlens.operators.scoring import rule_rate

NAMES = ["FREJA HANSEN", "bo jensen", "Anne-Marie Hansen", " clara  Lund ", "", None, "Julie Østby-Svendsen"]


def test_sql_functions_equal_dataframe_expressions(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    df.createOrReplaceTempView("gl_names")
    got = spark.sql("SELECT name, normalize_name(name) AS n, first_name(name) AS f FROM gl_names").collect()
    exp = df.select("name", normalize_name(F.col("name")).alias("n"), first_name(F.col("name")).alias("f")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, exp), key=repr)
    r = spark.sql("SELECT md5_mod100('Home & Kitchenmaleunisex') AS h, "
                  "rule_rate('Bags', 'female', 'female') AS r, "
                  "present_hash('Test Mug', 'Ceramic Blue', 'CM-001', 'MugCo') AS k").first()
    assert r.h == 38 and abs(r.r - 0.529) < 1e-12 and r.k == "F53A61D2DF859665EF41FE73E0DF6F54"
    one = spark.range(1).select(md5_mod(F.lit("Bagsmalefemale")).alias("h"),
                                rule_rate(F.lit("Bags"), F.lit("female"), "male").alias("r"),
                                present_hash(F.lit("a"), F.lit("b"), F.lit(None), F.lit("")).alias("k")).first()
    sql = spark.sql("SELECT md5_mod100('Bagsmalefemale') AS h, rule_rate('Bags', 'female', 'male') AS r, "
                    "present_hash('a', 'b', NULL, '') AS k").first()
    assert tuple(one) == tuple(sql)
