"""File sources: the three training CSVs, the product-attribute CSV, nested
JSON prediction requests. Schemas are given explicitly (no inference pass)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftlens import constants as K
from giftlens.functions.cleaning import na_to_null

CATALOG_COLUMNS = ["shop_id", "gift_id"]
EMPLOYEE_COLUMNS = ["company_cvr", "branch_code", "male_count", "female_count"]
PRODUCT_CSV_COLUMNS = [
    "present_hash", "present_name", "present_vendor", "model_name", "model_no", "item_main_category",
    "item_sub_category", "color", "brand", "vendor", "target_demographic", "utility_type", "durability",
    "usage_type",
]


def _strings(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns absent from ``df`` (schema-level)."""
    return sorted(set(required) - set(df.columns))


def _csv_header(spark: SparkSession, path, encoding: str = "UTF-8") -> list[str] | None:
    """Column names of the first line of the first file; None if there is no file."""
    paths = [path] if isinstance(path, str) else list(path)
    try:
        return spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option(
            "escape", '"').csv(paths).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_csv_lines(spark: SparkSession, path, columns: list[str]) -> tuple[DataFrame, list[str]] | None:
    """All columns of a header CSV as text, by the header's own names and order, with ``_corrupt_record`` set on
    lines that do not fit the header, and the place of each line: ``_file``, ``_block``, ``_in_block``.

    One permissive pass: columns may come in any order, extra ones are allowed.
    Returns the frame and the columns of ``columns`` that are missing; None without a file.
    """
    header = _csv_header(spark, path)
    if header is None:
        return None
    schema = T.StructType([*_strings(header).fields, T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("quote", '"')
          .option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
          .csv([path] if isinstance(path, str) else list(path)))
    # Malformed lines are found only where all cells are parsed: tie the flag to every column, so that no
    # later projection or count prunes them.
    parsed = F.xxhash64(*header) != F.lit(0)
    df = df.select(*header, F.when(parsed, F.col("_corrupt_record")).alias("_corrupt_record"),
                   F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_in_block"))
    return df, sorted(set(columns) - set(header))


def with_line_order(df: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the lines' order over all files (by path, block, place in the block), from 0 without gaps,
    and ``file_line``: the line's number in its own file counting the header, as far as every record is one line.

    Lines are counted per block and the counts summed (one row per block): no sort, no single task.
    """
    spot = Window.partitionBy("_file", "_block").orderBy("_in_block")  # one split's lines
    n = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    own = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("_file", "_block", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_before"),
                 F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_above"))
    j = df.withColumn("_k", F.row_number().over(spot) - 1).join(n, ["_file", "_block"])
    return (j.withColumn(name, F.col("_before") + F.col("_k")).withColumn("file_line", F.col("_above") + F.col("_k") + 2)
            .drop("_file", "_block", "_in_block", "_k", "_before", "_above"))


def read_string_csv(spark: SparkSession, path, columns: list[str], na_tokens=K.NA_TOKENS,
                    order_col: str | None = None) -> DataFrame:
    """Header CSV, every column a string, pandas-style missing tokens -> null
    (``NONE`` stays text). Columns may come in any order; others are ignored; a
    missing one raises ``ValueError``. Lines that do not fit the header are left
    out. An absent file gives an empty frame. ``order_col`` adds the file order."""
    read = read_csv_lines(spark, path, columns)
    if read is None:
        empty = spark.createDataFrame([], _strings(columns))
        return empty.withColumn(order_col, F.lit(None).cast("long")) if order_col else empty
    df, missing = read
    if missing:
        raise ValueError(f"CSV is missing required columns: {', '.join(missing)}")
    if order_col:
        df = with_line_order(df, order_col)
    df = df.filter(F.col("_corrupt_record").isNull())
    return df.select(*[na_to_null(F.col(c), na_tokens).alias(c) for c in columns], *([order_col] if order_col else []))


def load_three_files(spark: SparkSession, selections: str, catalog: str, employees: str,
                     order_col: str = "event_seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selections, catalog, employees). Selections get ``event_seq``, the
    line order over their files (D5). If any of the three is missing, all three
    frames are empty: a training set of parts would be misleading."""
    paths = {"sel": (selections, K.SELECTION_COLUMNS), "cat": (catalog, CATALOG_COLUMNS), "emp": (employees, EMPLOYEE_COLUMNS)}
    if any(_csv_header(spark, p) is None for p, _ in paths.values()):
        out = {k: spark.createDataFrame([], _strings(c)) for k, (_, c) in paths.items()}
        return out["sel"].withColumn(order_col, F.lit(None).cast("long")), out["cat"], out["emp"]
    return (read_string_csv(spark, selections, K.SELECTION_COLUMNS, order_col=order_col),
            read_string_csv(spark, catalog, CATALOG_COLUMNS), read_string_csv(spark, employees, EMPLOYEE_COLUMNS))


def read_product_csv(spark: SparkSession, path) -> DataFrame:
    """S2 + S3 + Q8: product-attribute CSV in one pass; only the empty string is
    null. Every line is returned, with ``line_no`` (order over all files),
    ``file_line`` (in its file) and ``_corrupt_record`` (its text, on lines that do not
    fit the header): ``import_presents`` reports those as errors. Missing required
    columns or no lines raise ``ValueError``."""
    read = read_csv_lines(spark, path, PRODUCT_CSV_COLUMNS)
    if read is None:
        raise ValueError(f"no CSV file at {path}")
    df, missing = read
    if missing:
        raise ValueError(f"CSV is missing required columns: {', '.join(missing)}")
    df = with_line_order(df, "line_no")
    if df.limit(1).count() == 0:
        raise ValueError("CSV parsing resulted in empty dataframe")
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in PRODUCT_CSV_COLUMNS], "line_no", "file_line",
                     "_corrupt_record")


def rejected_lines(products: DataFrame) -> DataFrame:
    """Q8: the lines of :func:`read_product_csv` that do not fit the header, with their file line and text."""
    return products.filter(F.col("_corrupt_record").isNotNull()).select("file_line", F.col("_corrupt_record").alias("line"))


PRESENT_ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("model_name", T.StringType()), T.StructField("model_no", T.StringType()),
    T.StructField("vendor", T.StringType()), T.StructField("order_count", T.LongType()),
])
REQUEST_SCHEMA = T.StructType([
    T.StructField("cvr", T.StringType()), T.StructField("male_count", T.IntegerType()),
    T.StructField("female_count", T.IntegerType()), T.StructField("presents", T.ArrayType(PRESENT_ITEM)),
    T.StructField("employees", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
])


def read_requests(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Prediction requests (one JSON object per line, or one document with
    ``multiline``) exploded to one row per requested gift with its position."""
    return explode_requests(read_request_documents(spark, path, multiline))


def read_request_documents(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Prediction requests as they are (gifts and employee names nested), with a ``request_id``."""
    df = spark.read.schema(REQUEST_SCHEMA).option("multiLine", multiline).json(path)
    return df.withColumn("request_id", F.monotonically_increasing_id().cast("string"))


def explode_requests(requests: DataFrame) -> DataFrame:
    """One row per (request, gift): request_id, cvr, counts, position, gift fields."""
    return requests.select("request_id", "cvr", "male_count", "female_count",
                           F.posexplode_outer("presents").alias("position", "p")).select(
        "request_id", "cvr", "male_count", "female_count", "position",
        F.col("p.id").alias("product_id"), F.col("p.description").alias("description"),
        F.col("p.model_name").alias("model_name"), F.col("p.model_no").alias("model_no"),
        F.col("p.vendor").alias("vendor"), F.col("p.order_count").alias("order_count"))


def explode_employees(requests: DataFrame) -> DataFrame:
    """One row per employee name of a request: request_id, cvr, position, name. ``requests`` is
    :func:`read_request_documents`; requests without names give no rows."""
    return requests.select("request_id", F.col("cvr").alias("company_cvr"),
                           F.posexplode("employees").alias("position", "e")).select(
        "request_id", "company_cvr", "position", F.col("e.name").alias("name"))
