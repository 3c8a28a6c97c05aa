"""The classified-product table (present attributes) as set-based rewrites.

Parquet tables have no in-place UPDATE/MERGE: every maintenance operator takes
the current table (and a change batch) and returns the next version, which the
caller writes to a new path or table. All joins are on ``present_hash``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftlens import constants as K
from giftlens.functions.cleaning import WHITESPACE

PRESENT_COLUMNS = [
    "id", "present_hash", "present_name", "present_vendor", "model_name", "model_no",
    "thread_id", "run_id", "item_main_category", "item_sub_category", "color", "brand",
    "vendor", "value_price", "target_demographic", "utility_type", "durability",
    "usage_type", "classified_at", "classification_status",
]
ATTRS = list(K.ATTRIBUTE_COLUMNS.values())
# Columns an upsert overwrites (everything but the key, id and timestamp).
UPSERT_COLUMNS = [c for c in PRESENT_COLUMNS if c not in ("id", "present_hash", "classified_at")]

ATTRIBUTE_SCHEMA = T.StructType([
    T.StructField("itemMainCategory", T.StringType()),
    T.StructField("itemSubCategory", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("valuePrice", T.DoubleType()),
    T.StructField("targetDemographic", T.StringType()),
    T.StructField("utilityType", T.StringType()),
    T.StructField("durability", T.StringType()),
    T.StructField("usageType", T.StringType()),
])
ENUMS = {
    "targetDemographic": K.TARGET_DEMOGRAPHICS,
    "utilityType": K.UTILITY_TYPES,
    "durability": K.DURABILITIES,
    "usageType": K.USAGE_TYPES,
}


def _now(now) -> Column:
    from giftlens.operators.usage import _as_of
    return _as_of(now)


# --------------------------------------------------------------------------- keys


def present_hash(name: Column, model: Column, model_no: Column, vendor: Column | None = None,
                 house_vendor: str = K.HOUSE_VENDOR) -> Column:
    """Upper-case MD5 of ``"{name} - {model} - {no}."`` plus
    ``" Vendor {vendor}"`` unless the vendor is empty or the house vendor
    (case-insensitive). Missing parts print as ``None``."""
    txt = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    base = F.concat(txt(name), F.lit(" - "), txt(model), F.lit(" - "), txt(model_no), F.lit("."))
    if vendor is None:
        return F.upper(F.md5(base))
    use = vendor.isNotNull() & (vendor != "") & (F.lower(vendor) != F.lit(house_vendor.lower()))
    return F.upper(F.md5(F.when(use, F.concat(base, F.lit(" Vendor "), vendor)).otherwise(base)))


def present_description(name: Column, model: Column, model_no: Column, vendor: Column) -> Column:
    """``name | model | no | Vendor: v``; empty or missing parts skipped."""
    part = lambda c: F.when(c != "", c)  # noqa: E731  (null for empty)
    v = F.when(vendor.isNotNull() & (vendor != ""), F.concat(F.lit("Vendor: "), vendor))
    return F.concat_ws(" | ", part(name), part(model), part(model_no), v)


# ----------------------------------------------------------------- reply handling


def clean_llm_json(c: Column) -> Column:
    """Strip; unescape ``\\"``; drop literal and real newline/CR/tab; drop one
    pair of outer quotes; drop a leading ``` ```json ``` and a trailing ``` ``` ```;
    strip. Empty or null input gives ``{}``."""
    ws = F.lit(WHITESPACE)
    s = F.btrim(c, ws)
    s = F.replace(s, F.lit('\\"'), F.lit('"'))
    for seq in ("\\n", "\\r", "\\t", "\n", "\r", "\t"):
        s = F.replace(s, F.lit(seq), F.lit(""))
    # every step refers to the one before it once: conditionals that repeat it would nest and multiply
    s = F.regexp_replace(s, r'(?s)\A"(.*)"\z', "$1")
    s = F.regexp_replace(s, r"\A```json", "")
    s = F.btrim(F.regexp_replace(s, r"```\z", ""), ws)
    return F.when(c.isNull() | (c == ""), F.lit("{}")).otherwise(s)


def parse_attributes(df: DataFrame, text_col: str = "reply") -> DataFrame:
    """X8 + X9: clean the reply, parse it, validate it against the attribute
    schema (all ten keys, no others, types, four enums) and expose the values
    under snake_case names. Adds ``attributes_ok`` and ``attributes_error``
    (first failing rule) — nothing is raised, bad rows are kept and labelled."""
    staged = df.withColumn("_c", clean_llm_json(F.col(text_col)))
    staged = staged.withColumn("_k", F.json_object_keys("_c"))  # null unless a JSON object
    staged = staged.withColumn("_p", F.from_json("_c", ATTRIBUTE_SCHEMA))
    keys = F.col("_k")
    required = F.array(*[F.lit(k) for k in ATTRIBUTE_SCHEMA.fieldNames()])
    missing = F.array_except(required, F.coalesce(keys, F.array().cast("array<string>")))
    extra = F.array_except(keys, required)
    type_errs = [F.when(F.col("_p")[k].isNull(), F.lit(f"bad_type:{k}")) for k in ATTRIBUTE_SCHEMA.fieldNames()]
    enum_errs = [F.when(~F.col("_p")[k].isin(v), F.lit(f"bad_enum:{k}")) for k, v in ENUMS.items()]
    err = F.coalesce(
        F.when(keys.isNull(), F.lit("invalid_json")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
        F.when(F.size(extra) > 0, F.concat(F.lit("extra:"), F.array_join(extra, ","))),
        *type_errs, *enum_errs)
    out = staged.withColumn("attributes_error", err)
    renamed = [F.col("_p")[k].alias(v) for k, v in K.ATTRIBUTE_COLUMNS.items()]
    return out.select(*df.columns, *renamed, F.col("attributes_error").isNull().alias("attributes_ok"),
                      "attributes_error")


def classification_outcome(table: DataFrame, replies: DataFrame, require_model_no: bool = True) -> DataFrame:
    """M13 + U8: the classification job over pending rows, set-based. For every
    pending product: missing name/model/(model_no) -> ``error_missing_details``;
    no reply -> ``error_openai_nodata``; reply that fails X8 ->
    ``error_openai_api``; a reply whose call left no text at all (null) ->
    ``error_processing_failed``; otherwise ``success`` with the parsed attributes.
    ``replies`` (present_hash, thread_id, run_id, reply) stands for the external
    classifier's answers; one reply per hash is expected (the first by
    thread_id is used otherwise)."""
    pending = table.filter(F.col("classification_status") == K.STATUS_PENDING)
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    missing = empty("present_name") | empty("model_name")
    if require_model_no:
        missing = missing | empty("model_no")
    one = (replies.groupBy("present_hash")
           .agg(F.min_by(F.struct("thread_id", "run_id", "reply"), F.col("thread_id")).alias("_r"))
           .select("present_hash", "_r.*"))
    j = pending.select("present_hash", "present_name", "present_vendor", "model_name", "model_no",
                       missing.alias("_missing")).join(one, "present_hash", "left")
    j = j.withColumn("_failed", F.col("thread_id").isNotNull() & F.col("reply").isNull())
    parsed = parse_attributes(j.withColumn("reply", F.coalesce("reply", F.lit(""))), "reply")
    status = (F.when(F.col("_missing"), F.lit(K.STATUS_MISSING_DETAILS))
              .when(F.col("thread_id").isNull(), F.lit(K.STATUS_NO_DATA))
              .when(F.col("_failed"), F.lit(K.STATUS_PROCESSING_FAILED))
              .when(~F.col("attributes_ok"), F.lit(K.STATUS_API_ERROR))
              .otherwise(F.lit(K.STATUS_SUCCESS)))
    ok = status == K.STATUS_SUCCESS
    # ids are only passed on when the classifier was called
    called = ~F.col("_missing")
    return parsed.select(
        "present_hash",
        present_description(F.col("present_name"), F.col("model_name"), F.col("model_no"),
                            F.col("present_vendor")).alias("description"),
        status.alias("new_status"),
        F.when(called, F.col("thread_id")).alias("thread_id"),
        F.when(called, F.col("run_id")).alias("run_id"),
        *[F.when(ok, F.col(c)).alias(c) for c in ATTRS],
        F.when(F.col("thread_id").isNull(), F.lit("no_reply")).otherwise(F.col("attributes_error"))
        .alias("attributes_error"))


# ----------------------------------------------------------------- table rewrites


def apply_classification(table: DataFrame, results: DataFrame, now=None) -> DataFrame:
    """Partial update by hash — non-null attributes overwrite, the status
    always, thread/run ids only when non-empty, ``classified_at = now``."""
    r = results.select("present_hash", *[F.col(c).alias("_n_" + c) for c in ATTRS],
                       F.col("new_status").alias("_n_status"), F.col("thread_id").alias("_n_thread"),
                       F.col("run_id").alias("_n_run"), F.lit(True).alias("_hit"))
    j = table.join(r, "present_hash", "left")
    hit = F.col("_hit").isNotNull()
    cols = []
    for c in table.columns:
        if c in ATTRS:
            cols.append(F.coalesce(F.col("_n_" + c).cast(table.schema[c].dataType), F.col(c)).alias(c))
        elif c == "classification_status":
            cols.append(F.when(hit, F.col("_n_status")).otherwise(F.col(c)).alias(c))
        elif c == "thread_id":
            cols.append(F.coalesce(F.when(F.col("_n_thread") != "", F.col("_n_thread")), F.col(c)).alias(c))
        elif c == "run_id":
            cols.append(F.coalesce(F.when(F.col("_n_run") != "", F.col("_n_run")), F.col(c)).alias(c))
        elif c == "classified_at":
            cols.append(F.when(hit, _now(now)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def _new_ids(new_rows: DataFrame, table: DataFrame, order: list) -> DataFrame:
    """Ids for inserted rows: max(existing id) + 1 + global rank (distributed)."""
    from giftlens.operators.split import global_rank
    base = table.agg(F.max("id")).first()[0] or 0  # one scalar
    ranked = global_rank(new_rows, order, name="_rk", total="_n_new")
    return (ranked.withColumn("id", (F.lit(base) + F.col("_rk") + 1).cast("long"))
            .drop("_rk", "_n_new"))


def dedupe_batch(batch: DataFrame, order_col: str, keep: str = "last") -> DataFrame:
    """One row per hash inside a batch — the last (or first) in batch order.
    An aggregate (partial + final), not a window."""
    row = F.struct(*[F.col(c) for c in batch.columns if c != "present_hash"])
    pick = F.max_by if keep == "last" else F.min_by
    return batch.groupBy("present_hash").agg(pick(row, F.col(order_col)).alias("_r")).select(
        "present_hash", "_r.*")


def upsert_presents(table: DataFrame, batch: DataFrame, order_col: str = "batch_seq",
                    now=None) -> DataFrame:
    """Insert-or-overwrite by hash (last write in the batch wins). Matched
    rows keep their id and get every non-key column from the batch and
    ``classified_at = now``; new hashes are appended with fresh ids. A batch without a
    status (no column, or null in a row) means ``success``. Lines without a hash cannot
    be stored and are left out."""
    b = dedupe_batch(batch.filter(F.col("present_hash").isNotNull()), order_col, keep="last")
    for c in UPSERT_COLUMNS:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    b = b.withColumn("classification_status", F.coalesce("classification_status", F.lit(K.STATUS_SUCCESS)))
    b = b.select("present_hash", order_col, *[F.col(c).cast(table.schema[c].dataType).alias(c)
                                              for c in UPSERT_COLUMNS])
    inc = b.select("present_hash", *[F.col(c).alias("_i_" + c) for c in UPSERT_COLUMNS],
                   F.lit(True).alias("_hit"))
    j = table.join(inc, "present_hash", "left")
    hit = F.col("_hit").isNotNull()
    updated = j.select(*[F.when(hit, F.col("_i_" + c)).otherwise(F.col(c)).alias(c) if c in UPSERT_COLUMNS
                         else F.when(hit, _now(now)).otherwise(F.col(c)).alias(c) if c == "classified_at"
                         else F.col(c) for c in table.columns])
    new = b.join(table.select("present_hash"), "present_hash", "left_anti")
    new = _new_ids(new, table, [F.col(order_col), F.col("present_hash")])
    new = new.withColumn("classified_at", _now(now)).select(*table.columns)
    return updated.unionByName(new)


def import_presents(table: DataFrame, batch: DataFrame, order_col: str = "line_no",
                    now=None) -> tuple[DataFrame, DataFrame]:
    """U2 + J10 + Q8: insert-if-new import. Hashes already stored are skipped;
    a hash repeated inside the batch keeps its first line (the rest are
    skipped). Inserted rows: status ``success``; price, thread and run null. A line
    without a hash or a name cannot be stored: its outcome is ``error`` with the reason.
    Lines that the CSV reader rejected (``_corrupt_record``) come in the batch with that
    column and count as errors too. Returns (inserted rows, per-line outcome with the
    file line number)."""
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in batch.columns else F.lit(False)
    reason = (F.when(corrupt, F.lit("malformed line"))
              .when(F.coalesce(F.col("present_hash"), F.lit("")) == "", F.lit("missing present_hash"))
              .when(F.coalesce(F.col("present_name"), F.lit("")) == "", F.lit("missing present_name")))
    batch = batch.withColumn("reason", reason)
    good = batch.filter(F.col("reason").isNull())
    first = good.groupBy("present_hash").agg(F.min(order_col).alias("_first"))
    stored = table.select("present_hash").distinct().withColumn("_stored", F.lit(True))
    tagged = (batch.join(first, "present_hash", "left").join(stored, "present_hash", "left")
              .withColumn("outcome", F.when(F.col("reason").isNotNull(), F.lit("error"))
                          .when(F.col("_stored").isNotNull(), F.lit("skipped_existing"))
                          .when(F.col(order_col) != F.col("_first"), F.lit("skipped_duplicate"))
                          .otherwise(F.lit("imported"))))
    line = F.col("file_line") if "file_line" in batch.columns else F.col(order_col) + 2
    outcome = tagged.select("present_hash", F.col(order_col), line.alias("file_line"), "outcome", "reason")
    new = tagged.filter(F.col("outcome") == "imported")
    cols = []
    for c in table.columns:
        if c in ("id", "classified_at"):
            continue
        if c == "classification_status":
            cols.append(F.lit(K.STATUS_SUCCESS).alias(c))
        elif c in ("value_price", "thread_id", "run_id") or c not in batch.columns:
            cols.append(F.lit(None).cast(table.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(c).cast(table.schema[c].dataType).alias(c))
    new = new.select(F.col(order_col), *cols)
    new = _new_ids(new, table, [F.col(order_col)])
    new = new.withColumn("classified_at", _now(now)).select(*table.columns)
    return new, outcome


def import_report(outcome: DataFrame) -> DataFrame:
    """Imported / skipped / error counts and total processed."""
    return outcome.agg(
        F.count_if(F.col("outcome") == "imported").alias("imported_count"),
        F.count_if(F.col("outcome").startswith("skipped")).alias("skipped_count"),
        F.count_if(F.col("outcome") == "error").alias("error_count"),
        F.count(F.lit(1)).alias("total_processed"))


def invalidate_presents(table: DataFrame, requests: DataFrame) -> DataFrame:
    """U4: set status ``invalidated`` for the requested product identities
    (present_name, model_name, model_no, vendor) unless already invalidated.
    Adds ``changed`` (true where this call changed the row)."""
    keys = requests.select(present_hash(F.col("present_name"), F.col("model_name"), F.col("model_no"),
                                        F.col("vendor")).alias("present_hash")).distinct()
    j = table.join(keys.withColumn("_hit", F.lit(True)), "present_hash", "left")
    change = F.col("_hit").isNotNull() & (F.col("classification_status") != K.STATUS_INVALIDATED)
    return j.select(*[F.when(change, F.lit(K.STATUS_INVALIDATED)).otherwise(F.col(c)).alias(c)
                      if c == "classification_status" else F.col(c) for c in table.columns],
                    F.coalesce(change, F.lit(False)).alias("changed"))


def reset_failed(table: DataFrame, pattern: str = "error%") -> DataFrame:
    """Statuses matching the LIKE ``pattern`` go back to pending; their
    thread and run ids are cleared."""
    hit = F.col("classification_status").like(pattern)
    return table.select(*[
        F.when(hit, F.lit(K.STATUS_PENDING)).otherwise(F.col(c)).alias(c) if c == "classification_status"
        else F.when(hit, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) if c in ("thread_id", "run_id")
        else F.col(c) for c in table.columns])


def failed_status_counts(table: DataFrame, pattern: str = "error%") -> DataFrame:
    """Rows per status matching ``pattern`` (dry run of U5) plus a total
    row (status null) from a rollup."""
    return (table.filter(F.col("classification_status").like(pattern))
            .rollup("classification_status")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.countDistinct("classification_status").alias("status_count")))


def cache_stats(table: DataFrame) -> DataFrame:
    """A10: rows, distinct hashes, successes, failures, oldest / newest entry."""
    st = F.col("classification_status")
    return table.agg(F.count(F.lit(1)).alias("total_cached"),
                     F.countDistinct("present_hash").alias("unique_presents"),
                     F.count_if(st == K.STATUS_SUCCESS).alias("successful"),
                     F.count_if(st == "failed").alias("failed"),
                     F.min("classified_at").alias("oldest_entry"),
                     F.max("classified_at").alias("newest_entry"))


def top_categories(table: DataFrame, k: int = 10) -> DataFrame:
    """A11 + P13 + T1: most frequent main categories among successes."""
    return (table.filter((F.col("classification_status") == K.STATUS_SUCCESS)
                         & F.col("item_main_category").isNotNull())
            .groupBy("item_main_category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "item_main_category").limit(k))


def pending_presents(table: DataFrame) -> DataFrame:
    """Products waiting for classification."""
    return (table.filter(F.col("classification_status") == K.STATUS_PENDING)
            .select("present_hash", "present_name", "present_vendor", "model_name", "model_no"))


def latest_classification(table: DataFrame) -> DataFrame:
    """Per hash the latest successful row (``classified_at`` descending with
    nulls first, as the database orders it; then id descending). An aggregate
    with a struct ordering, not a window."""
    ok = table.filter(F.col("classification_status") == K.STATUS_SUCCESS)
    order = F.struct(F.col("classified_at").isNull().alias("n"), F.col("classified_at").alias("t"),
                     F.col("id").alias("i"))
    row = F.struct(*[F.col(c) for c in table.columns if c != "present_hash"])
    return ok.groupBy("present_hash").agg(F.max_by(row, order).alias("_r")).select("present_hash", "_r.*")


def enrich_presents(requested: DataFrame, table: DataFrame) -> DataFrame:
    """J11 + P14: attributes of requested products (by hash) that were
    classified successfully; ``found`` is false for the missing ones."""
    ok = (table.filter(F.col("classification_status") == K.STATUS_SUCCESS)
          .groupBy("present_hash").agg(F.min_by(F.struct(
              "item_main_category", "item_sub_category", "color", "brand", "vendor",
              "target_demographic", "utility_type", "usage_type", "durability"), F.col("id")).alias("_a"))
          .select("present_hash", "_a.*", F.lit(True).alias("found")))
    j = requested.join(ok, "present_hash", "left")
    return j.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
