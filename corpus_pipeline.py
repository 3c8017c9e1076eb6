"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote.

Stages get ``(spark, docs, sf_dir)`` and return a DataFrame; all but the last return the columns of
``documents``.  Rejected documents go; texts that lose lines get their ``n_chars`` anew.  Further columns
than those of ``documents`` are left behind by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grapnel.llm import decontam, line_dedup, packing, quality, simhash
from grapnel.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one: repeats and null ids change nothing; null and empty texts have no words and go."""
    return quality.ledger(docs.select(*COLUMNS)).where(quality.passes(quality.DEFAULT)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes.  Rows with a null id neither own nor lose lines, rows that share an id count as one document;
    a null text becomes its one empty line."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return done.withColumn("text", F.col("__lines")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents, written with a ``__row`` of their own each: ids can be null or shared, rows can't."""
    return materialize(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row a group stays: the one with the smallest id.

    Null ids come after all others, and a row with one is a document like another.  Among rows that share
    the smallest id the text's hash decides, then the row's place.
    """
    rows = numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("__row").alias("row"))
    groups = simhash.near_duplicates(rows.select(key.alias("__key"), "text"), "__key")
    stays = groups.where(F.col("__key.row") == F.col("component_id.row")).select(F.col("__key.row").alias("__row"))
    return rows.join(stays.hint("shuffle_hash"), "__row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one, whatever their ids: null ones, and clean rows that share a contaminated row's."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = numbered(docs)
    bad = decontam.contaminate(rows.select("__row", "text"), benchmark, "__row").where("contaminated").select("__row")
    return rows.join(bad.hint("shuffle_hash"), "__row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is a document: a null text is its end mark alone, repeats and null ids are packed like others."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]
#: Fingerprints and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
