import json
import tempfile

import pytest

from pyspark.sql import functions as F

from giftlens.sources import files as S
from giftlens.sources import tables as T


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_three_files_strings_and_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="gl-src-")
    _write(f"{d}/sel.csv", "shop_id,company_cvr,employee_gender,gift_id,product_main_category,product_sub_category,"
                           "product_brand,product_color,product_durability,product_target_gender,"
                           "product_utility_type,product_type\n"
                           'shop1,007,male,g1,"Home, Kitchen",NA,NONE,,durable,unisex,practical,individual\n')
    _write(f"{d}/cat.csv", "shop_id,gift_id\nshop1,g1\n")
    _write(f"{d}/emp.csv", "company_cvr,branch_code,male_count,female_count\n007,1,12,abc\n")
    sel, cat, emp = S.load_three_files(spark, f"{d}/sel.csv", f"{d}/cat.csv", f"{d}/emp.csv")
    r = sel.first()
    assert r.company_cvr == "007" and r.product_main_category == "Home, Kitchen"
    assert r.product_sub_category is None and r.product_brand == "NONE" and r.product_color is None
    assert cat.count() == 1 and emp.first().female_count == "abc"
    missing = S.read_string_csv(spark, f"{d}/absent.csv", ["a"])
    assert missing.count() == 0


def product_line(h, name="n", rest="x"):
    return ",".join([h, name, "", "m", "007"] + [rest] * 9)


def test_product_csv_required_columns_rejects_and_line_numbers(spark):
    d = tempfile.mkdtemp(prefix="gl-prod-")
    header = ",".join(S.PRODUCT_CSV_COLUMNS)
    _write(f"{d}/ok.csv", header + "\n" + product_line("H1") + "\n")
    r = S.read_product_csv(spark, f"{d}/ok.csv").first()
    assert r.present_vendor is None and r.model_no == "007" and (r.line_no, r.file_line) == (0, 2)
    _write(f"{d}/short.csv", "present_hash,present_name\nH1,n\n")
    with pytest.raises(ValueError, match="missing required columns"):
        S.read_product_csv(spark, f"{d}/short.csv")
    with pytest.raises(ValueError, match="no CSV"):
        S.read_product_csv(spark, f"{d}/absent.csv")
    # columns in another order, an extra one, and lines that do not fit
    names = ["extra", *reversed(S.PRODUCT_CSV_COLUMNS)]
    good = lambda h: ",".join(["e", *["x"] * 9, "007", "m", "", "n", h])
    _write(f"{d}/bad.csv", ",".join(names) + "\n" + good("H1") + "\nonly,three,cells\n" + good("H2") + ",too,many\n" + good("H3") + "\n")
    df = S.read_product_csv(spark, f"{d}/bad.csv")
    assert [(r.present_hash, r.file_line) for r in df.filter("_corrupt_record IS NULL").orderBy("line_no").collect()] == [
        ("H1", 2), ("H3", 5)]
    assert [(r.file_line, r.line.split(",")[0]) for r in S.rejected_lines(df).orderBy("file_line").collect()] == [(3, "only"), (4, "e")]


def test_rejected_lines_reach_the_import_report(spark):
    from giftlens.operators import products as P
    d = tempfile.mkdtemp(prefix="gl-imp-")
    _write(f"{d}/p.csv", ",".join(S.PRODUCT_CSV_COLUMNS) + "\n" + product_line("H1") + "\nbroken,line\n"
           + product_line("") + "\n" + product_line("H1", "again") + "\n" + product_line("H2", "") + "\n")
    table = spark.createDataFrame([], ", ".join(
        f"{c} {'bigint' if c == 'id' else 'double' if c == 'value_price' else 'timestamp_ntz' if c == 'classified_at' else 'string'}"
        for c in P.PRESENT_COLUMNS))
    new, outcome = P.import_presents(table, S.read_product_csv(spark, f"{d}/p.csv"), now="2024-01-01 00:00:00")
    assert [r.present_hash for r in new.collect()] == ["H1"]
    got = {(r.file_line, r.outcome, r.reason) for r in outcome.collect()}
    assert got == {(2, "imported", None), (3, "error", "malformed line"), (4, "error", "missing present_hash"),
                   (5, "skipped_duplicate", None), (6, "error", "missing present_name")}
    r = P.import_report(outcome).first()
    assert (r.imported_count, r.skipped_count, r.error_count, r.total_processed) == (1, 1, 3, 5)


def test_event_order_over_several_files(spark):
    d = tempfile.mkdtemp(prefix="gl-order-")
    from giftlens import constants as K
    line = lambda g: ",".join(["s", "c", "male", g] + ["x"] * 8)
    _write(f"{d}/a.csv", ",".join(K.SELECTION_COLUMNS) + "\n" + line("first") + "\n")
    _write(f"{d}/b.csv", ",".join(K.SELECTION_COLUMNS) + "\n" + "\n".join(line(f"b{k}") for k in range(400)) + "\n")
    rows = S.read_string_csv(spark, [f"{d}/a.csv", f"{d}/b.csv"], K.SELECTION_COLUMNS, order_col="event_seq").orderBy("event_seq").collect()
    assert [r.event_seq for r in rows] == list(range(401))
    assert [r.gift_id for r in rows] == ["first", *[f"b{k}" for k in range(400)]]


def test_one_missing_file_empties_all_three(spark):
    d = tempfile.mkdtemp(prefix="gl-three-")
    _write(f"{d}/cat.csv", "shop_id,gift_id\nshop1,g1\n")
    frames = S.load_three_files(spark, f"{d}/absent.csv", f"{d}/cat.csv", f"{d}/emp.csv")
    assert [f.count() for f in frames] == [0, 0, 0] and "event_seq" in frames[0].columns


def test_employees_of_a_request(spark):
    d = tempfile.mkdtemp(prefix="gl-emp-")
    _write(f"{d}/r.json", json.dumps({"cvr": "1", "employees": [{"name": "Bo"}, {"name": "Freja"}],
                                      "presents": [{"id": "9", "order_count": 4}]}) + "\n" + json.dumps({"cvr": "2"}) + "\n")
    docs = S.read_request_documents(spark, f"{d}/r.json")
    assert [(r.company_cvr, r.position, r.name) for r in S.explode_employees(docs).collect()] == [("1", 0, "Bo"), ("1", 1, "Freja")]
    assert {(r.cvr, r.product_id, r.order_count) for r in S.explode_requests(docs).collect()} == {("1", "9", 4), ("2", None, None)}


def test_requests_json_explodes_presents(spark):
    d = tempfile.mkdtemp(prefix="gl-req-")
    req = {"cvr": "28892055", "male_count": 12, "female_count": 11,
           "presents": [{"id": "1", "description": "Tisvilde Pizzaovn", "model_name": "Tisvilde Pizzaovn",
                         "model_no": "", "vendor": "House"},
                        {"id": "2", "description": "Fiskars Knife Set", "model_name": "Professional Chef Set",
                         "model_no": "FK-2024", "vendor": "Fiskars"}]}
    _write(f"{d}/r.json", json.dumps(req) + "\n")
    rows = S.read_requests(spark, f"{d}/r.json").orderBy("position").collect()
    assert [(r.position, r.product_id) for r in rows] == [(0, "1"), (1, "2")]
    assert rows[0].cvr == "28892055" and rows[0].male_count == 12


def test_tables_bootstrap_and_append(spark):
    d = tempfile.mkdtemp(prefix="gl-tab-")
    T.create_tables(spark, d, drop=True)
    assert T.tables_exist(spark)
    calls = spark.createDataFrame(
        [(1, 7, "2024-01-02 10:00:00", "/predict", {"a": "1"}, {"ok": "y"}, 200, 12.5, None)],
        "id long, user_id long, date_time string, api_route string, request_payload map<string,string>, "
        "response_payload map<string,string>, response_status_code int, response_time_ms double, error_message string")
    T.append_calls(calls)
    r = spark.table("user_api_call_log").first()
    assert r.request_payload == '{"a":"1"}' and str(r.log_date) == "2024-01-02"
