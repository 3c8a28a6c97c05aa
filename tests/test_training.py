"""Training frame on the literal three-file example and the edge cases."""

import pytest
from pyspark.sql import functions as F

from giftlens.operators import training as TR

EMP = [("12233445", "12600", "12", "34"), ("34446505", "12601", "10", "3"), ("14433445", "12600", "22", "12")]
CAT = [("shop123", "gift789"), ("shop123", "gift234"), ("shop123", "gift567"), ("shop456", "gift789"),
       ("shop456", "gift111")]
SEL_COLS = ("shop_id string, company_cvr string, employee_gender string, gift_id string, "
            "product_main_category string, product_sub_category string, product_brand string, product_color string, "
            "product_durability string, product_target_gender string, product_utility_type string, "
            "product_type string, event_seq long")
SEL = [("shop123", "12233445", "male", "gift789", "Home & Kitchen", "Cookware", "Fiskars", "NONE", "durable",
        "unisex", "practical", "individual", 1),
       ("shop123", "12233445", "female", "gift234", "Bags", "Toiletry Bag", "Markberg", "black", "durable",
        "female", "practical", "individual", 2)]


def frames(spark, sel=SEL, emp=EMP, cat=CAT):
    return (spark.createDataFrame(sel, SEL_COLS),
            spark.createDataFrame(cat, "shop_id string, gift_id string"),
            spark.createDataFrame(emp, "company_cvr string, branch_code string, male_count string, female_count string"))


def all_links(spark):
    return spark.createDataFrame([(c, s) for c, *_ in EMP for s in ("shop123", "shop456")],
                                 "company_cvr string, shop_id string")


def test_every_company_with_every_catalog_gives_30_rows(spark):
    sel, cat, emp = frames(spark)
    tf = TR.training_frame(sel, cat, emp, links=all_links(spark)).cache()
    assert tf.count() == 30
    assert tf.filter("selection_count > 0").count() == 2
    rates = {r.gift_id: r.selection_rate for r in tf.filter("selection_count > 0").collect()}
    assert rates["gift789"] == pytest.approx(1 / 12)
    assert rates["gift234"] == pytest.approx(1 / 34)
    z = tf.filter("selection_count = 0")
    assert {r.product_main_category for r in z.filter("gift_id = 'gift789'").collect()} == {"Home & Kitchen"}
    assert {r.product_brand for r in z.filter("gift_id in ('gift567', 'gift111')").collect()} == {"NONE"}


def test_default_links_use_shops_the_company_selected_in(spark):
    sel, cat, emp = frames(spark)
    tf = TR.training_frame(sel, cat, emp)
    # one company linked to shop123 (3 gifts) x 2 genders
    assert tf.count() == 6
    assert tf.select("company_cvr").distinct().count() == 1


def test_unisex_gender_and_unknown_company_are_rejected(spark):
    extra = [("shop123", "12233445", "unisex", "gift567") + SEL[0][4:12] + (3,),
             ("shop123", "99999999", "male", "gift567") + SEL[0][4:12] + (4,)]
    sel, cat, emp = frames(spark, sel=SEL + extra)
    tf = TR.training_frame(sel, cat, emp, links=all_links(spark))
    assert tf.filter("selection_count > 0").count() == 2
    rej = TR.selection_rejects(TR.selection_groups(sel), emp).collect()
    assert sorted(r.reason for r in rej) == ["gender", "unknown_company"]


def test_duplicate_catalog_row_duplicates_zero_rows(spark):
    sel, cat, emp = frames(spark, cat=CAT + [("shop123", "gift567")])
    tf = TR.training_frame(sel, cat, emp, links=all_links(spark))
    assert tf.count() == 36


def test_first_value_follows_event_order_and_zero_exposure_rate_is_zero(spark):
    later = ("shop123", "34446505", "male", "gift789", "Other", "x", "y", "red", "durable", "unisex",
             "practical", "individual", 0)
    first = ("shop123", "34446505", "male", "gift789", "Home & Kitchen", "x", "y", "blue", "durable",
             "unisex", "practical", "individual", 10)
    emp = EMP[:1] + [("34446505", "12601", "0", "3")] + EMP[2:]
    sel, cat, emp = frames(spark, sel=[first, later], emp=emp)
    g = TR.selection_groups(sel).collect()[0]
    assert g.product_color == "red" and g.selection_count == 2
    tf = TR.training_frame(sel, cat, emp)
    row = tf.filter("selection_count > 0").collect()[0]
    assert row.exposure == 0.0 and row.selection_rate == 0.0


def test_invariants(spark):
    sel, cat, emp = frames(spark)
    tf = TR.training_frame(sel, cat, emp, links=all_links(spark))
    # exposure constant per (company, gender); selections preserved
    assert tf.groupBy("company_cvr", "employee_gender").agg(F.countDistinct("exposure").alias("n")) \
        .filter("n > 1").count() == 0
    assert tf.agg(F.sum("selection_count")).first()[0] == 2


def test_groups_take_one_shuffle_and_order_is_three_numbers(spark, tmp_path):
    from giftlens.sources import fixtures as FX
    sel, _, _ = frames(spark)
    plan = TR.selection_groups(sel, non_null=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double"
    rows = [(1, 7, 3, 2, 10.55), (1, 7, 3, 1, 10.56), (None, 1, 1, 1, 1.0)]
    found = [r.o for r in spark.createDataFrame(rows, line).select(FX.event_order().alias("o")).collect()]
    assert [tuple(o) if o else None for o in found] == [(12, 700000003, 1055), (11, 700000003, 1056), None]


def test_small_stored_tables_are_broadcast_by_their_size(spark):
    from giftlens.session import cut_lineage
    sel, cat, emp = frames(spark)
    small = cut_lineage(emp.select("company_cvr", "male_count"))
    assert small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10_000
    assert sorted(map(tuple, small.collect())) == sorted((c, m) for c, _, m, _ in EMP)


def test_null_order_gives_way_to_the_same_event_with_an_order(spark):
    a, b = SEL[0], SEL[0][:6] + ("Other",) + SEL[0][7:]
    rows = [a[:-1] + (None,), a[:-1] + (5,), b[:-1] + (4,)]
    g = TR.selection_groups(spark.createDataFrame(rows, SEL_COLS), non_null=True).collect()
    assert [(r.product_brand, r.first_seq, r.selection_count) for r in g] == [("Other", 4, 3)]


def test_cleaned_groups_take_the_whole_first_row_in_one_aggregate(spark):
    from giftlens.functions.cleaning import clean_selections
    a, b = SEL[0], SEL[0][:6] + ("Other",) + SEL[0][7:]
    sel, _, _ = frames(spark, sel=[a[:-1] + (None,), b[:-1] + (4,), a[:-1] + (6,), SEL[1][:-1] + (None,)])
    g = TR.selection_groups(clean_selections(sel))
    plan = g.select("gift_id", "product_brand", "product_color")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(") == 1
    # an event without an order value is nobody's first value, but its whole row comes first
    found = {r.gift_id: (r.product_brand, r.product_color, r.selection_count, r.first_row.product_brand) for r in g.collect()}
    assert found == {"gift789": ("Other", "NONE", 3, "Fiskars"), "gift234": (None, None, 1, "Markberg")}


def test_frame_carries_only_the_product_columns_asked_for(spark):
    sel, cat, emp = frames(spark)
    whole = TR.training_frame(sel, cat, emp, links=all_links(spark))
    keys = whole.columns[:7]
    for asked in ([], ["product_brand", "product_color"]):
        some = TR.training_frame(sel, cat, emp, links=all_links(spark), products=asked)
        assert some.columns == keys + asked
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(some.columns).collect()))
    groups = TR.selection_groups(sel, products=False)
    assert groups.columns == keys[:4] + ["selection_count"]
    assert "product_" not in groups._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
