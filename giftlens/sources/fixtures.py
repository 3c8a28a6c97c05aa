"""Input tables of the gift-demand model, derived from the TPC-H-like test data.

Every fixture is a lazy DataFrame over the parquet files of one scale factor,
so its size grows with the data. Only equi-joins and aggregates are used. The
SQL twins used by the DuckDB oracle live in ``giftlens.plans.oracle_fixtures``.

Mapping:
  company  = nation (cvr 10000000 + nation key), branch = region
  shop     = region ("shop<regionkey>")
  employee = customer (even key male, odd key female; nation 7 has no men)
  gift     = part; a shop carries the parts its region's suppliers ship
  selection event = line item (who ordered it, which part)
  API user = customer; API call = event
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from giftlens import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cvr(nation_key: Column) -> Column:
    return (F.lit(10000000) + nation_key).cast("string")


def _shop(region_key: Column) -> Column:
    return F.concat(F.lit("shop"), region_key.cast("string"))


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_employees: company_cvr, branch_code, male_count, female_count."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    even = (F.col("c_custkey") % 2 == 0).cast("int")
    odd = (F.col("c_custkey") % 2 == 1).cast("int")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .groupBy("n_nationkey", "n_regionkey")
            .agg(F.sum(even).alias("_m"), F.sum(odd).alias("_f"))
            .select(_cvr(F.col("n_nationkey")).alias("company_cvr"),
                    F.col("n_regionkey").cast("string").alias("branch_code"),
                    F.when(F.col("n_nationkey") == 7, F.lit(0)).otherwise(F.col("_m"))
                    .cast("double").alias("male_count"),
                    F.col("_f").cast("double").alias("female_count")))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shop_id, gift_id: a shop carries every part shipped by a supplier of its region."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # numbers are told apart before they become texts
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
            .join(nation, F.col("s_nationkey") == nation.n_nationkey)
            .select("n_regionkey", "l_partkey").distinct()
            .select(_shop(F.col("n_regionkey")).alias("shop_id"), F.col("l_partkey").cast("string").alias("gift_id")))


def event_order(prefix: str = "l_") -> Column:
    """Unique, total order of line items (stands for file order of events): order and line, part and supplier, price in
    cents; null if one of them is. Three long numbers, which compare many times faster than one decimal of 38 digits."""
    c = lambda name: F.col(prefix + name).cast("long")
    cents = F.round(F.col(prefix + "extendedprice") * 100).cast("long")
    line, item = c("orderkey") * 10 + c("linenumber"), c("partkey") * 100_000_000 + c("suppkey")
    parts = F.struct(line.alias("line"), item.alias("item"), cents.alias("cents"))
    return F.when(line.isNotNull() & item.isNotNull() & cents.isNotNull(), parts)


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: the ordering customer's company picked the part."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_shipdate", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # who ordered is looked up per order: lines are shuffled for their order and their part only
    placed = (orders.join(cust, F.col("o_custkey") == cust.c_custkey)
              .join(nation, F.col("c_nationkey") == nation.n_nationkey)
              .select("o_orderkey", "n_regionkey", "n_nationkey"))
    j = (li.join(placed, li.l_orderkey == F.col("o_orderkey"))
         .join(part, F.col("l_partkey") == part.p_partkey))
    size, pk = F.col("p_size"), F.col("p_partkey")
    return j.select(
        _shop(F.col("n_regionkey")).alias("shop_id"),
        _cvr(F.col("n_nationkey")).alias("company_cvr"),
        F.when(F.col("l_linenumber") % 2 == 0, "male").otherwise("female").alias("employee_gender"),
        F.col("l_partkey").cast("string").alias("gift_id"),
        F.col("p_type").alias("product_main_category"),
        F.col("p_name").alias("product_sub_category"),
        F.col("p_brand").alias("product_brand"),
        F.col("l_returnflag").alias("product_color"),
        F.when(size % 2 == 0, "durable").otherwise("consumable").alias("product_durability"),
        F.when(pk % 3 == 0, "male").when(pk % 3 == 1, "female").otherwise("unisex")
        .alias("product_target_gender"),
        F.when(size % 3 == 0, "practical").when(size % 3 == 1, "work").otherwise("status")
        .alias("product_utility_type"),
        F.when(size % 5 == 0, "shareable").otherwise("individual").alias("product_type"),
        event_order().alias("event_seq"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"user" table: id, username, api_key, created_at, updated_at, is_active, is_admin.

    created_at is the customer's first order date (null without orders)."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    first = (table(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order")))
    return (cust.join(first, cust.c_custkey == first.o_custkey, "left")
            .select(F.col("c_custkey").alias("id"),
                    F.col("c_name").alias("username"),
                    F.concat(F.lit("key-"), F.col("c_custkey").cast("string"), F.lit("-"),
                             F.col("c_name")).alias("api_key"),
                    F.col("first_order").alias("created_at"),
                    F.col("first_order").alias("updated_at"),
                    (F.col("c_acctbal") >= 0).alias("is_active"),
                    (F.col("c_custkey") % 50 == 0).alias("is_admin")))


def api_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_api_call_log from the event stream."""
    return log_from_events(table(spark, sf_dir, "events"))


def log_from_events(ev: DataFrame) -> DataFrame:
    """Map event rows to usage-log rows (works on batch and streaming frames)."""
    is_err = F.col("event_type") == "error"
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("ts").alias("date_time"),
        F.col("event_type").alias("api_route"),
        F.col("props").alias("request_payload"),
        F.col("props").alias("response_payload"),
        F.when(is_err & (F.col("event_id") % 2 == 0), 500).when(is_err, 404).otherwise(200)
        .alias("response_status_code"),
        F.col("value").alias("response_time_ms"),
        F.when(is_err, F.lit("failed")).alias("error_message"),
    )


def presents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """present_attributes: one classified product per part."""
    part = table(spark, sf_dir, "part")
    last = (table(spark, sf_dir, "lineitem").groupBy("l_partkey")
            .agg(F.max("l_shipdate").alias("l_last")))
    pk = F.col("p_partkey")
    j = part.join(last, part.p_partkey == last.l_partkey, "left")
    return j.select(
        pk.alias("id"),
        F.upper(F.md5(F.concat(F.col("p_name"), F.lit(" - "), F.col("p_type"), F.lit(" - "),
                               pk.cast("string"), F.lit(". Vendor "), F.col("p_brand"))))
        .alias("present_hash"),
        F.col("p_name").alias("present_name"),
        F.col("p_brand").alias("present_vendor"),
        F.col("p_type").alias("model_name"),
        pk.cast("string").alias("model_no"),
        F.lit(None).cast("string").alias("thread_id"),
        F.lit(None).cast("string").alias("run_id"),
        F.when(pk % 11 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("item_main_category"),
        F.col("p_name").alias("item_sub_category"),
        F.lit(None).cast("string").alias("color"),
        F.col("p_brand").alias("brand"),
        F.col("p_brand").alias("vendor"),
        F.col("p_retailprice").alias("value_price"),
        F.when(pk % 3 == 0, "male").when(pk % 3 == 1, "female").otherwise("unisex")
        .alias("target_demographic"),
        F.lit("practical").alias("utility_type"),
        F.when(F.col("p_size") % 2 == 0, "durable").otherwise("consumable").alias("durability"),
        F.lit("individual").alias("usage_type"),
        F.col("l_last").alias("classified_at"),
        F.when(pk % 7 == 0, K.STATUS_PENDING).when(pk % 7 == 1, K.STATUS_API_ERROR)
        .when(pk % 7 == 2, "failed").otherwise(K.STATUS_SUCCESS).alias("classification_status"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded prediction requests: each company asks about every gift of its
    shop, in requests of at most 100 gifts (gift ids in the same hundred)."""
    emp = employees(spark, sf_dir)
    cat = catalog(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pk = F.col("p_partkey")
    j = (emp.join(cat, cat.shop_id == F.concat(F.lit("shop"), emp.branch_code))
         .join(part, F.col("gift_id") == pk.cast("string")))
    return j.select(
        F.concat(F.col("company_cvr"), F.lit("-"), F.floor(pk / 100).cast("string")).alias("request_id"),
        F.col("company_cvr").alias("cvr"),
        F.col("male_count").cast("int").alias("male_count"),
        F.col("female_count").cast("int").alias("female_count"),
        F.col("gift_id").alias("product_id"),
        F.when(pk % 3 == 0, F.concat(F.col("p_name"), F.lit(" Pizza")))
        .when(pk % 3 == 1, F.concat(F.col("p_name"), F.lit(" toiletry BAG")))
        .otherwise(F.col("p_name")).alias("description"),
    )


NAME_CHOICES = ["FREJA HANSEN", "bo jensen", "Anne-Marie Hansen", "Magnus Ebenstrand",
                " clara  Lund ", "John Doe", "Andy Kim", ""]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee names per company (one of eight spellings by customer key)."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    pick = F.element_at(F.array(*[F.lit(n) for n in NAME_CHOICES]),
                        (F.col("c_custkey") % 8 + 1).cast("int"))
    return cust.select(F.col("c_custkey").alias("employee_id"),
                       _cvr(F.col("c_nationkey")).alias("company_cvr"),
                       pick.alias("name"))


GENERAL_NAMES = [("Anne-Marie", "any", "female"), ("John", "any", "male"),
                 ("Andy", "any", "andy"), ("Magnus", "any", "mostly_male")]


def general_names(spark: SparkSession) -> DataFrame:
    """Name dictionary (name, country, label); stands for an external name source."""
    return spark.createDataFrame(GENERAL_NAMES, "name string, country string, label string")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company registry: cvr -> industry code ('' for region 0 companies)."""
    nation = table(spark, sf_dir, "nation")
    code = F.when(F.col("n_regionkey") == 0, F.lit("")).otherwise(
        F.concat(F.col("n_regionkey").cast("string"),
                 F.lpad(F.col("n_nationkey").cast("string"), 2, "0")))
    return nation.select(_cvr(F.col("n_nationkey")).alias("cvr"), code.alias("industry_code"))


def llm_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw classifier replies per product hash, damaged five ways by id % 5:
    fenced block, quoted-and-escaped, missing key, illegal enum, intact."""
    p = presents(spark, sf_dir)
    mode = F.col("id") % 5
    enum_val = F.when(mode == 3, F.lit("robotic")).otherwise(F.col("utility_type"))
    parts = [
        F.lit('{"itemMainCategory": "'), F.coalesce(F.col("model_name"), F.lit("NONE")),
        F.lit('", "itemSubCategory": "'), F.col("present_name"),
        F.lit('", "color": "NONE", "brand": "'), F.col("brand"),
        F.lit('", "vendor": "'), F.col("vendor"),
        F.lit('", "valuePrice": '), F.col("value_price").cast("string"),
        F.lit(', "targetDemographic": "'), F.col("target_demographic"),
        F.lit('", "utilityType": "'), enum_val,
        F.lit('", "durability": "'), F.col("durability"), F.lit('"'),
    ]
    usage = F.when(mode == 2, F.lit("")).otherwise(F.lit(', "usageType": "individual"'))
    body = F.concat(*parts, usage, F.lit("}"))
    text = (F.when(mode == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(mode == 1, F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"')))
            .otherwise(body))
    return p.select("present_hash", F.concat(F.lit("thread-"), F.col("id").cast("string")).alias("thread_id"),
                    F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"),
                    text.alias("reply"))


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed quantity per (company, gift): number of selection events."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (li.join(orders, li.l_orderkey == orders.o_orderkey)
            .join(cust, F.col("o_custkey") == cust.c_custkey)
            .groupBy(_cvr(F.col("c_nationkey")).alias("cvr"),
                     F.col("l_partkey").cast("string").alias("product_id"))
            .agg(F.count(F.lit(1)).alias("order_count")))


def faulty_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All selections, and a damaged copy of each event whose gift number is a multiple of 3: by the number over 3,
    modulo 4, an unknown company, a gender outside the model, quotes and spaces around texts, or no gift."""
    r = selections(spark, sf_dir)
    number = F.floor(F.col("gift_id").cast("long") / 3)
    kind = number % 4
    quoted = lambda c: F.concat(F.lit('" \t'), F.upper(c) if c == "employee_gender" else F.col(c), F.lit(' "'))
    columns = {c: F.when(kind == 2, quoted(c)).otherwise(F.col(c)) for c in ("shop_id", "employee_gender", "product_brand", "product_main_category")}
    columns["employee_gender"] = F.when(kind == 1, F.lit(" unisex ")).otherwise(columns["employee_gender"])
    columns["company_cvr"] = F.when(kind == 0, F.concat(F.lit("99"), F.substring("company_cvr", 3, 6))).otherwise(F.col("company_cvr"))
    columns["gift_id"] = F.when(kind == 3, F.lit(None)).otherwise(F.col("gift_id"))
    return r.unionByName(r.where(F.col("gift_id").cast("long") % 3 == 0).withColumns(columns))


def employees_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies (``line`` 0), and a second row (``line`` 1) with other counts for companies whose number is a multiple of 5."""
    r = employees(spark, sf_dir).withColumn("line", F.lit(0))
    again = r.where(F.col("company_cvr").cast("long") % 5 == 0).withColumns(
        {"male_count": F.col("male_count") + 3, "female_count": F.col("female_count") + 1, "line": F.lit(1)})
    return r.unionByName(again)


def name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name classification requests as (request_id, name): one per company, one per first digit of the customer
    number, and one with no name per region."""
    n = names(spark, sf_dir)
    per = [n.select(F.concat(F.lit("company-"), "company_cvr").alias("request_id"), "name"),
           n.select(F.concat(F.lit("digit-"), F.substring(F.col("employee_id").cast("string"), 1, 1)).alias("request_id"), "name"),
           table(spark, sf_dir, "region").select(F.concat(F.lit("empty-"), F.col("r_regionkey").cast("string")).alias("request_id"),
                                                 F.lit(None).cast("string").alias("name"))]
    return per[0].unionByName(per[1]).unionByName(per[2])
