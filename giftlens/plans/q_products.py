"""Queries: product hash, classifier replies, product-table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.operators import products as P
from giftlens.plans.oracle_fixtures import FIXTURES
from giftlens.plans.registry import register
from giftlens.sources import fixtures as FX

AS_OF = "2024-01-31 00:00:00"
# product classification dates lie in the line-item ship years
RETAIN_CACHE_AS_OF = "2001-09-01 00:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"
_WS = "||".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace())
PCOLS = P.PRESENT_COLUMNS


# ----------------------------------------------------------------- derived inputs

def all_replies(spark, sf):
    """A classifier reply for every product."""
    return FX.llm_replies(spark, sf).select("present_hash", "thread_id", "run_id", "reply")


def replies(spark, sf):
    """Replies as the job meets them: the classifier left products of the largest sizes
    unanswered (the missing reply is what ``classification_outcome`` labels)."""
    part = FX.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    r = FX.llm_replies(spark, sf)
    p = FX.presents(spark, sf).select("id", "present_hash")
    return (r.join(p, "present_hash").join(part, "id").filter(F.col("p_size") <= 45)
            .select("present_hash", "thread_id", "run_id", "reply"))


FIXTURES["fx_replies_all"] = """
SELECT present_hash, 'thread-' || CAST(id AS VARCHAR) AS thread_id, 'run-' || CAST(id AS VARCHAR) AS run_id,
       CASE WHEN id % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
            WHEN id % 5 = 1 THEN '"' || replace(body, '"', '\\"') || '"'
            ELSE body END AS reply
FROM (SELECT id, present_hash,
             '{"itemMainCategory": "' || coalesce(model_name, 'NONE') || '", "itemSubCategory": "' || present_name
             || '", "color": "NONE", "brand": "' || brand || '", "vendor": "' || vendor
             || '", "valuePrice": ' || CAST(value_price AS VARCHAR)
             || ', "targetDemographic": "' || target_demographic
             || '", "utilityType": "' || CASE WHEN id % 5 = 3 THEN 'robotic' ELSE utility_type END
             || '", "durability": "' || durability || '"'
             || CASE WHEN id % 5 = 2 THEN '' ELSE ', "usageType": "individual"' END || '}' AS body
      FROM fx_presents) b"""

FIXTURES["fx_replies"] = """
SELECT r.* FROM fx_replies_all r JOIN fx_presents p ON r.present_hash = p.present_hash
JOIN part ON p.id = p_partkey WHERE p_size <= 45"""

FIXTURES["fx_reply_clean"] = f"""
SELECT present_hash, thread_id, run_id, reply,
       CASE WHEN reply IS NULL OR reply = '' THEN '{{}}' ELSE trim(s4, {_WS}) END AS cleaned
FROM (SELECT *, CASE WHEN ends_with(s3, '```') THEN substring(s3, 1, length(s3) - 3) ELSE s3 END AS s4
  FROM (SELECT *, CASE WHEN starts_with(s2, '```json') THEN substring(s2, 8) ELSE s2 END AS s3
    FROM (SELECT *, CASE WHEN starts_with(s1, '"') AND ends_with(s1, '"') AND length(s1) >= 2
                         THEN substring(s1, 2, length(s1) - 2) ELSE s1 END AS s2
      FROM (SELECT *, replace(replace(replace(replace(replace(replace(replace(trim(reply, {_WS}),
                 '\\"', '"'), '\\n', ''), '\\r', ''), '\\t', ''), chr(10), ''), chr(13), ''), chr(9), '') AS s1
            FROM fx_replies_all) a) b) c) d"""

_REQ = ["itemMainCategory", "itemSubCategory", "color", "brand", "vendor", "valuePrice",
        "targetDemographic", "utilityType", "durability", "usageType"]
_REQ_LIST = "[" + ", ".join(f"'{k}'" for k in _REQ) + "]"
_ENUM_SQL = {k: "(" + ", ".join(f"'{x}'" for x in v) + ")" for k, v in P.ENUMS.items()}


def _val(k):
    if k == "valuePrice":
        return "TRY_CAST(json_extract(cleaned, '$.valuePrice') AS DOUBLE)"
    return f"json_extract_string(cleaned, '$.{k}')"


FIXTURES["fx_parsed"] = f"""
SELECT present_hash, thread_id, run_id, reply,
       {", ".join(f"CASE WHEN keys IS NOT NULL THEN {_val(k)} END AS {v}" for k, v in K.ATTRIBUTE_COLUMNS.items())},
       err IS NULL AS attributes_ok, err AS attributes_error
FROM (SELECT *, coalesce(
        CASE WHEN keys IS NULL THEN 'invalid_json' END,
        CASE WHEN len(list_filter({_REQ_LIST}, lambda x: NOT list_contains(keys, x))) > 0
             THEN 'missing:' || array_to_string(list_filter({_REQ_LIST}, lambda x: NOT list_contains(keys, x)), ',') END,
        CASE WHEN len(list_filter(keys, lambda x: NOT list_contains({_REQ_LIST}, x))) > 0
             THEN 'extra:' || array_to_string(list_filter(keys, lambda x: NOT list_contains({_REQ_LIST}, x)), ',') END,
        {", ".join(f"CASE WHEN {_val(k)} IS NULL THEN 'bad_type:{k}' END" for k in _REQ)},
        {", ".join(f"CASE WHEN {_val(k)} NOT IN {_ENUM_SQL[k]} THEN 'bad_enum:{k}' END" for k in P.ENUMS)}) AS err
      FROM (SELECT *, CASE WHEN json_valid(cleaned) AND json_type(cleaned) = 'OBJECT' THEN json_keys(cleaned) END AS keys
            FROM fx_reply_clean) a) b"""


def batch(spark, sf, dup_tag: str):
    """A change batch derived from the parts: even sizes name the stored vendor
    (same key as the table), odd sizes the house vendor (a new key). Parts of
    size <= 2 appear twice; the second copy carries a different colour."""
    part = FX.table(spark, sf, "part")
    vendor = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(K.HOUSE_VENDOR.upper()))
    base = part.select(
        F.col("p_name").alias("present_name"), vendor.alias("present_vendor"),
        F.col("p_type").alias("model_name"), F.col("p_partkey").cast("string").alias("model_no"),
        F.upper(F.col("p_type")).alias("item_main_category"), F.col("p_name").alias("item_sub_category"),
        F.lit("NONE").alias("color"), F.col("p_brand").alias("brand"), F.col("p_brand").alias("vendor"),
        F.lit("unisex").alias("target_demographic"), F.lit("practical").alias("utility_type"),
        F.lit("durable").alias("durability"), F.lit("individual").alias("usage_type"),
        (F.col("p_partkey") * 2).alias("seq"), F.col("p_size"))
    dup = (base.filter(F.col("p_size") <= 2)
           .withColumn("color", F.lit(dup_tag)).withColumn("seq", F.col("seq") + 1))
    both = base.unionByName(dup).drop("p_size")
    return both.withColumn("present_hash", P.present_hash(F.col("present_name"), F.col("model_name"),
                                                          F.col("model_no"), F.col("present_vendor")))


FIXTURES["fx_batch"] = f"""
SELECT upper(md5(present_name || ' - ' || model_name || ' - ' || model_no || '.'
                 || CASE WHEN present_vendor <> '' AND lower(present_vendor) <> '{K.HOUSE_VENDOR}'
                         THEN ' Vendor ' || present_vendor ELSE '' END)) AS present_hash, *
FROM (SELECT p_name AS present_name,
             CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '{K.HOUSE_VENDOR.upper()}' END AS present_vendor,
             p_type AS model_name, CAST(p_partkey AS VARCHAR) AS model_no,
             upper(p_type) AS item_main_category, p_name AS item_sub_category,
             CASE WHEN copy = 1 THEN 'second' ELSE 'NONE' END AS color, p_brand AS brand, p_brand AS vendor,
             'unisex' AS target_demographic, 'practical' AS utility_type, 'durable' AS durability,
             'individual' AS usage_type, p_partkey * 2 + copy AS seq
      FROM part JOIN (VALUES (0), (1)) c(copy) ON copy = 0 OR p_size <= 2) x"""


# ----------------------------------------------------------------- keys and text

@register("present_hash", sql="SELECT model_no, present_vendor, color, present_hash FROM fx_batch")
def q_present_hash(spark, sf):
    return batch(spark, sf, "second").select("model_no", "present_vendor", "color", "present_hash")


@register("present_description", sql="""
SELECT present_hash, concat_ws(' | ', nullif(present_name, ''), nullif(model_name, ''), nullif(model_no, ''),
                               CASE WHEN present_vendor <> '' THEN 'Vendor: ' || present_vendor END) AS description
FROM fx_presents""")
def q_present_description(spark, sf):
    t = FX.presents(spark, sf)
    return t.select("present_hash", P.present_description(F.col("present_name"), F.col("model_name"),
                                                          F.col("model_no"), F.col("present_vendor"))
                    .alias("description"))


@register("clean_llm_json", sql="SELECT present_hash, cleaned FROM fx_reply_clean")
def q_clean_llm_json(spark, sf):
    return all_replies(spark, sf).select("present_hash", P.clean_llm_json(F.col("reply")).alias("cleaned"))


@register("parse_attributes", sql="SELECT * FROM fx_parsed", rounded=["value_price"])
def q_parse_attributes(spark, sf):
    return P.parse_attributes(all_replies(spark, sf), "reply")


FIXTURES["fx_outcome"] = f"""
SELECT t.present_hash,
       concat_ws(' | ', nullif(t.present_name, ''), nullif(t.model_name, ''), nullif(t.model_no, ''),
                 CASE WHEN t.present_vendor <> '' THEN 'Vendor: ' || t.present_vendor END) AS description,
       CASE WHEN coalesce(t.present_name, '') = '' OR coalesce(t.model_name, '') = '' OR coalesce(t.model_no, '') = ''
                 THEN 'error_missing_details'
            WHEN r.thread_id IS NULL THEN 'error_openai_nodata'
            WHEN NOT r.attributes_ok THEN 'error_openai_api' ELSE 'success' END AS new_status,
       r.thread_id, r.run_id,
       {", ".join(f"CASE WHEN r.attributes_ok THEN r.{c} END AS {c}" for c in P.ATTRS)},
       CASE WHEN r.thread_id IS NULL THEN 'no_reply' ELSE r.attributes_error END AS attributes_error
FROM fx_presents t LEFT JOIN (SELECT p.* FROM fx_parsed p JOIN fx_replies a ON p.present_hash = a.present_hash) r
     ON t.present_hash = r.present_hash
WHERE t.classification_status = 'pending_classification'"""


@register("classification_outcome", sql="SELECT * FROM fx_outcome", rounded=["value_price"])
def q_classification_outcome(spark, sf):
    return P.classification_outcome(FX.presents(spark, sf), replies(spark, sf))


@register("apply_classification", sql=f"""
SELECT t.id, t.present_hash, t.present_name, t.present_vendor, t.model_name, t.model_no,
       coalesce(nullif(o.thread_id, ''), t.thread_id) AS thread_id, coalesce(nullif(o.run_id, ''), t.run_id) AS run_id,
       {", ".join(f"coalesce(o.{c}, t.{c}) AS {c}" for c in P.ATTRS)},
       CASE WHEN o.present_hash IS NOT NULL THEN {_NOW} ELSE t.classified_at END AS classified_at,
       CASE WHEN o.present_hash IS NOT NULL THEN o.new_status ELSE t.classification_status END AS classification_status
FROM fx_presents t LEFT JOIN fx_outcome o ON t.present_hash = o.present_hash""", rounded=["value_price"])
def q_apply_classification(spark, sf):
    t = FX.presents(spark, sf)
    return P.apply_classification(t, P.classification_outcome(t, replies(spark, sf)), now=AS_OF)


# ----------------------------------------------------------------- table rewrites

_UPS = [c for c in P.UPSERT_COLUMNS]


def _batch_expr(prefix, c):
    if c in ("thread_id", "run_id"):
        return "CAST(NULL AS VARCHAR)"
    if c == "classification_status":
        return "'success'"
    if c == "value_price":
        return "CAST(NULL AS DOUBLE)"
    return f"{prefix}{c}"


def _batch_cols(prefix):
    return [f"{_batch_expr(prefix, c)} AS {c}" for c in _UPS]


FIXTURES["fx_batch_last"] = """
SELECT * FROM fx_batch QUALIFY row_number() OVER (PARTITION BY present_hash ORDER BY seq DESC) = 1"""


@register("upsert_presents", sql=f"""
SELECT t.id, t.present_hash,
       {", ".join(f"CASE WHEN b.present_hash IS NOT NULL THEN {_batch_expr('b.', c)} ELSE t.{c} END AS {c}"
                  for c in _UPS)},
       CASE WHEN b.present_hash IS NOT NULL THEN {_NOW} ELSE t.classified_at END AS classified_at
FROM fx_presents t LEFT JOIN fx_batch_last b ON t.present_hash = b.present_hash
UNION ALL
SELECT (SELECT max(id) FROM fx_presents) + row_number() OVER (ORDER BY b.seq, b.present_hash) AS id,
       b.present_hash, {", ".join(_batch_cols('b.'))}, {_NOW} AS classified_at
FROM fx_batch_last b WHERE b.present_hash NOT IN (SELECT present_hash FROM fx_presents)""",
          rounded=["value_price"])
def q_upsert_presents(spark, sf):
    t = FX.presents(spark, sf)
    return P.upsert_presents(t, batch(spark, sf, "second"), order_col="seq", now=AS_OF).select(*t.columns)


FIXTURES["fx_import_lines"] = """
SELECT * REPLACE (CASE WHEN present_vendor IS NOT NULL AND color = 'second' AND seq % 4 = 1 THEN NULL ELSE present_hash END
                  AS present_hash,
                  CASE WHEN color = 'second' AND seq % 4 = 3 THEN '' ELSE present_name END AS present_name)
FROM fx_batch"""

FIXTURES["fx_import_tag"] = """
SELECT b.*, b.seq - 1 AS line_no,
       CASE WHEN coalesce(b.present_hash, '') = '' OR coalesce(b.present_name, '') = '' THEN 'error'
            WHEN b.present_hash IN (SELECT present_hash FROM fx_presents) THEN 'skipped_existing'
            WHEN b.seq <> min(CASE WHEN coalesce(b.present_name, '') <> '' THEN b.seq END) OVER (PARTITION BY b.present_hash)
                 THEN 'skipped_duplicate'
            ELSE 'imported' END AS outcome
FROM fx_import_lines b"""


def import_lines(spark, sf):
    """The batch as a CSV would bring it: some repeated lines have no hash, others no name."""
    b = batch(spark, sf, "second")
    again = F.col("color") == "second"
    b = b.withColumn("present_hash", F.when(again & (F.col("seq") % 4 == 1), F.lit(None).cast("string"))
                     .otherwise(F.col("present_hash")))
    b = b.withColumn("present_name", F.when(again & (F.col("seq") % 4 == 3), F.lit("")).otherwise(F.col("present_name")))
    return b.withColumn("line_no", F.col("seq") - 1)


@register("import_new_presents", sql=f"""
SELECT (SELECT max(id) FROM fx_presents) + row_number() OVER (ORDER BY line_no) AS id, present_hash,
       present_name, present_vendor, model_name, model_no, CAST(NULL AS VARCHAR) AS thread_id,
       CAST(NULL AS VARCHAR) AS run_id, item_main_category, item_sub_category, color, brand, vendor,
       CAST(NULL AS DOUBLE) AS value_price, target_demographic, utility_type, durability, usage_type,
       {_NOW} AS classified_at, 'success' AS classification_status
FROM fx_import_tag WHERE outcome = 'imported'""", rounded=["value_price"])
def q_import_new_presents(spark, sf):
    t = FX.presents(spark, sf)
    b = import_lines(spark, sf)
    return P.import_presents(t, b, order_col="line_no", now=AS_OF)[0]


@register("import_report", sql="""
SELECT CAST(COUNT(*) FILTER (WHERE outcome = 'imported') AS BIGINT) AS imported_count,
       CAST(COUNT(*) FILTER (WHERE outcome LIKE 'skipped%') AS BIGINT) AS skipped_count,
       CAST(COUNT(*) FILTER (WHERE outcome = 'error') AS BIGINT) AS error_count, CAST(COUNT(*) AS BIGINT) AS total_processed
FROM fx_import_tag""")
def q_import_report(spark, sf):
    t = FX.presents(spark, sf)
    b = import_lines(spark, sf)
    return P.import_report(P.import_presents(t, b, order_col="line_no", now=AS_OF)[1])


@register("invalidate_presents", sql="""
SELECT * REPLACE (CASE WHEN classification_status = 'failed' THEN 'invalidated' ELSE classification_status END
                  AS classification_status),
       classification_status = 'failed' AS changed
FROM fx_presents""", rounded=["value_price"])
def q_invalidate_presents(spark, sf):
    t = FX.presents(spark, sf)
    req = t.filter(F.col("classification_status") == "failed").select(
        "present_name", "model_name", "model_no", F.col("present_vendor").alias("vendor"))
    return P.invalidate_presents(t, req)


@register("reset_failed", sql="""
SELECT * REPLACE (CASE WHEN classification_status LIKE 'error%' THEN 'pending_classification'
                       ELSE classification_status END AS classification_status,
                  CASE WHEN classification_status LIKE 'error%' THEN NULL ELSE thread_id END AS thread_id,
                  CASE WHEN classification_status LIKE 'error%' THEN NULL ELSE run_id END AS run_id)
FROM fx_presents""", rounded=["value_price"])
def q_reset_failed(spark, sf):
    return P.reset_failed(FX.presents(spark, sf))


@register("failed_status_counts", sql="""
SELECT classification_status, CAST(COUNT(*) AS BIGINT) AS count,
       CAST(COUNT(DISTINCT classification_status) AS BIGINT) AS status_count
FROM fx_presents WHERE classification_status LIKE 'error%' GROUP BY ROLLUP (classification_status)""")
def q_failed_status_counts(spark, sf):
    return P.failed_status_counts(FX.presents(spark, sf))


@register("cache_stats", sql="""
SELECT CAST(COUNT(*) AS BIGINT) AS total_cached, CAST(COUNT(DISTINCT present_hash) AS BIGINT) AS unique_presents,
       CAST(COUNT(*) FILTER (WHERE classification_status = 'success') AS BIGINT) AS successful,
       CAST(COUNT(*) FILTER (WHERE classification_status = 'failed') AS BIGINT) AS failed,
       MIN(classified_at) AS oldest_entry, MAX(classified_at) AS newest_entry
FROM fx_presents""")
def q_cache_stats(spark, sf):
    return P.cache_stats(FX.presents(spark, sf))


@register("top_categories", sql="""
SELECT item_main_category, CAST(COUNT(*) AS BIGINT) AS count FROM fx_presents
WHERE classification_status = 'success' AND item_main_category IS NOT NULL
GROUP BY item_main_category ORDER BY count DESC, item_main_category LIMIT 10""")
def q_top_categories(spark, sf):
    return P.top_categories(FX.presents(spark, sf))


@register("pending_presents", sql="""
SELECT present_hash, present_name, present_vendor, model_name, model_no FROM fx_presents
WHERE classification_status = 'pending_classification'""")
def q_pending_presents(spark, sf):
    return P.pending_presents(FX.presents(spark, sf))


@register("latest_classification", sql="""
SELECT * FROM fx_presents WHERE classification_status = 'success'
QUALIFY row_number() OVER (PARTITION BY present_hash ORDER BY classified_at DESC NULLS FIRST, id DESC) = 1""",
          rounded=["value_price"])
def q_latest_classification(spark, sf):
    return P.latest_classification(FX.presents(spark, sf))


FIXTURES["fx_requested"] = """
SELECT r.cvr, r.product_id,
       upper(md5(p_name || ' - ' || p_type || ' - ' || CAST(p_partkey AS VARCHAR) || '. Vendor ' || p_brand)) AS present_hash
FROM fx_requests r JOIN part ON r.product_id = CAST(p_partkey AS VARCHAR)"""


def requested(spark, sf):
    part = FX.table(spark, sf, "part")
    r = FX.requests(spark, sf).select("cvr", "product_id")
    j = r.join(part, r.product_id == part.p_partkey.cast("string"))
    return j.select("cvr", "product_id", P.present_hash(F.col("p_name"), F.col("p_type"),
                                                        F.col("p_partkey").cast("string"),
                                                        F.col("p_brand")).alias("present_hash"))


@register("enrich_presents", sql="""
SELECT q.cvr, q.product_id, q.present_hash, a.item_main_category, a.item_sub_category, a.color, a.brand, a.vendor,
       a.target_demographic, a.utility_type, a.usage_type, a.durability, a.present_hash IS NOT NULL AS found
FROM fx_requested q LEFT JOIN (SELECT * FROM fx_presents WHERE classification_status = 'success') a
     ON q.present_hash = a.present_hash""")
def q_enrich_presents(spark, sf):
    return P.enrich_presents(requested(spark, sf), FX.presents(spark, sf))


@register("retain_cache", sql=f"""
SELECT * FROM fx_presents
WHERE NOT coalesce(classified_at < TIMESTAMP '{RETAIN_CACHE_AS_OF}' - INTERVAL 30 DAY, false)""",
          rounded=["value_price"])
def q_retain_cache(spark, sf):
    from giftlens.operators.usage import keep_recent
    return keep_recent(FX.presents(spark, sf), "classified_at", RETAIN_CACHE_AS_OF, days=K.CACHE_RETENTION_DAYS)
