import math

import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "company_cvr" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def _canon(pdf):
    cols = sorted(pdf.columns)
    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    return cols, sorted((tuple(n(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


def test_oracle_sample(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in ["training_frame", "company_features", "score_fallback", "system_api_stats", "classify_gender",
                 "upsert_presents", "parse_attributes", "cv_summary"]:
        s = _canon(q[name](spark, SF).toPandas())
        d = _canon(con.execute(o[name]).df())
        assert s == d, name
