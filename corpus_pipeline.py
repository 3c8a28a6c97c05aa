"""Corpus cleaning pipeline: quality rules, toxicity, near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next stage's documents. All but the last return
the columns of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giftlens.llm import queries
from giftlens.llm.checkpoints import shared_dir, stored
from giftlens.llm.minhash_dedup import near_duplicates
from giftlens.llm.packing import pack, token_pieces
from giftlens.llm.quality_rules import base_failed, decision_list, learn_rules, text_statistics
from giftlens.llm.suffix_dedup import remove_repeats
from giftlens.llm.toxicity import fit, held_out, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Passages of more than 50 words are to go: 50 words of 4 bytes and a separator. (400 bytes would
#: leave most of them; the query op10 keeps the length of its contract.)
PASSAGE_BYTES = 250
PASSAGE_GRAM = 64


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base limits and no rule of the learned decision list rejects.

    Null and empty texts fail the base limits. Every row is judged by its own
    text, whatever its id.
    """
    docs = _documents(docs)
    stats = stored(text_statistics(docs.withColumn("row", F.struct(*COLUMNS)), carry=("row",)))
    rules = learn_rules(stats, queries.table(spark, sf_dir, "labels"))
    return stats.where(~base_failed() & (decision_list(rules) == 0)).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score under 0.5; the model learns from labelled documents of this stage's input
    that are not held out."""
    docs = _documents(docs)
    model = fit(docs, queries.table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model, out_col="__toxicity").where(F.col("__toxicity") < 0.5).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the smallest id (5-word shingles, similarity 0.8).

    Rows are compared by a number of their own, so of a repeated row one stays,
    rows with one id and different texts are different documents, and a null id
    (the last in order) has duplicates like any other.
    """
    docs = stored(_documents(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = near_duplicates(docs, id_col="row").select("row", "component_id").join(docs.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = groups.groupBy("component_id").agg(first).select("first.row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes of strings of ``PASSAGE_BYTES`` that start at two places or more.

    Every document stays, some with an empty text. Bytes of characters that a cut
    went through are dropped, so texts are valid; ``n_chars`` is counted anew. A
    null text becomes empty.
    """
    out = remove_repeats(_documents(docs), length=PASSAGE_BYTES, gram=PASSAGE_GRAM, carry=["lang", "source"])
    # a cut may leave a part of a character: such bytes decode to the replacement character's place and go
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(
        F.try_validate_utf8(F.col("kept").cast("string")))
    return (out.withColumn("text", F.coalesce(text, _valid(F.col("kept"))))
            .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def _valid(kept):
    """The characters of UTF-8 bytes without those that are not whole."""
    return F.regexp_replace(F.make_valid_utf8(kept.cast("string")), "�", "")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of at most 4096 tokens; one row per piece.

    An empty text is one piece, its end id.
    """
    pieces = token_pieces(_documents(docs), queries.vocabulary())
    return pack(pieces, ["doc_id", "start"])


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("near_dedup", near_dedup),
          ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Learned verdicts, sketches and token ids have no SQL twin; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
