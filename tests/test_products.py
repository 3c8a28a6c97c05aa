import datetime as dt

from pyspark.sql import functions as F

from giftlens.operators import products as P
from giftlens.operators import usage as U

GOOD = ('{"itemMainCategory": "Home", "itemSubCategory": "Mug", "color": "blue", "brand": "B", "vendor": "V", '
        '"valuePrice": 10.5, "targetDemographic": "unisex", "utilityType": "practical", "durability": "durable", '
        '"usageType": "individual"}')


def test_clean_llm_json(spark):
    cases = [("```json\n" + GOOD + "\n```", GOOD), ('"' + GOOD.replace('"', '\\"') + '"', GOOD), ("", "{}"),
             ("  {\\n\"a\": 1}\t", '{"a": 1}')]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    got = [r.c for r in df.select(P.clean_llm_json(F.col("t")).alias("c")).collect()]
    assert got == [b for _, b in cases]


def test_parse_attributes_errors(spark):
    bad_enum = GOOD.replace('"practical"', '"robotic"')
    extra = GOOD[:-1] + ', "x": 1}'
    missing = GOOD.replace(', "usageType": "individual"', "")
    df = spark.createDataFrame([(GOOD,), (bad_enum,), (extra,), (missing,), ("not json",)], "reply string")
    got = [(r.attributes_ok, r.attributes_error) for r in P.parse_attributes(df).collect()]
    assert got == [(True, None), (False, "bad_enum:utilityType"), (False, "extra:x"),
                   (False, "missing:usageType"), (False, "invalid_json")]


def _table(spark):
    rows = [(1, "H1", "a", None, "m", "1", None, None, None, None, None, None, None, None, None, None, None, None,
             dt.datetime(2024, 1, 1), "success"),
            (2, "H2", "b", None, "m", "2", None, None, None, None, None, None, None, None, None, None, None, None,
             None, "error_openai_api")]
    schema = ", ".join(f"{c} {'bigint' if c == 'id' else 'double' if c == 'value_price' else 'timestamp_ntz' if c == 'classified_at' else 'string'}"
                       for c in P.PRESENT_COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_upsert_last_write_wins_and_new_ids(spark):
    t = _table(spark)
    batch = spark.createDataFrame([("H1", "first", 1), ("H1", "second", 2), ("H9", "new", 3)],
                                  "present_hash string, color string, batch_seq int")
    out = {r.present_hash: r for r in P.upsert_presents(t, batch, now="2024-02-01").collect()}
    assert out["H1"].color == "second" and out["H1"].id == 1
    assert out["H9"].id == 3 and out["H2"].color is None


def test_import_skips_existing_and_duplicates(spark):
    t = _table(spark)
    batch = spark.createDataFrame([("H1", "x", 0), ("H5", "y", 1), ("H5", "z", 2)],
                                  "present_hash string, present_name string, line_no long")
    new, outcome = P.import_presents(t, batch, now="2024-02-01")
    assert [(r.present_hash, r.present_name, r.classification_status) for r in new.collect()] == [("H5", "y", "success")]
    rep = P.import_report(outcome).first()
    assert (rep.imported_count, rep.skipped_count, rep.total_processed) == (1, 2, 3)


def test_reset_and_retention_keep_null_timestamps(spark):
    t = _table(spark)
    reset = {r.present_hash: (r.classification_status, r.thread_id) for r in P.reset_failed(t).collect()}
    assert reset["H2"] == ("pending_classification", None)
    kept = U.keep_recent(t, "classified_at", "2025-01-01", days=30).collect()
    assert [r.present_hash for r in kept] == ["H2"]
