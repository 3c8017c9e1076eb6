"""The thin queries over the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from grapnel.llm import chat, decontam, licenses, line_dedup, packing, quality, secrets, sharding, simhash, token_counts
from grapnel.llm.oracles import SQL

CONTROL = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__lines", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(_documents(spark, sf_dir))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.DEFAULT).alias("kept"), "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the ledger's bits alone."""
    return quality.ablations(quality.ledger(_documents(spark, sf_dir)))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = licenses.scan_licenses(_documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", licenses.digest("spans").alias("spans"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]
    return sharding.place(_table(spark, sf_dir, "documents", "doc_id"), "doc_id", shards).select("doc_id", "slot", "shard")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.scan(_documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base_spans", lambda x: x["k"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.digest("base_spans"), 256).alias("base_sha256"), secrets.digest("all_spans").alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontam.contaminate(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))]
    control = spark.range(1).select(F.inline(F.array(*rows)))
    done = chat.format_chats(turns.unionByName(control)).withColumns({"__turns": chat.parse(F.col("formatted")), "__loss": chat.under_mask("formatted", "loss")})
    spelled = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("__turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(_documents(spark, sf_dir))
    return done.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_quality_rules, op3_license_scans, op4_sharding, op5_packing, op6_secret_scans, op7_decontamination, op8_token_counts, op9_chat_formatting, op10_simhash, quality_ablations)
}
ORACLES: dict[str, str] = {k: v for k, v in SQL.items() if k in QUERIES}
