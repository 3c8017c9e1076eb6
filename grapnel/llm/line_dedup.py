"""Line dedup: every line that an earlier document already holds is dropped.

Method.  Each line is reduced to a 128-bit hash of its key.  The hashes are range-partitioned and
sorted by (hash, document, position) inside each partition, so that one streaming pass sees a key's
first holder before all others.  What comes back is not text but one compressed keep bitmap a
document: only the 64-bit words in which some line goes.

Skew.  A hash prefix histogram (65,536 rows at most) names the ranges that hold more than their
share; inside those, keys over the share are counted with map-side sums.  There can be no more such
keys than shares, so they are broadcast with their first holder, and their rows never meet in one
task.

Defined results.  A null or empty text has one empty line.  A row whose id is null neither owns nor
loses lines.  Rows that share an id count as one document; each keeps its own text and bitmap, and
equal rows come back as often as they came in.  Columns besides id and text are passed through by
:func:`apply_keep` whatever their names, as all working columns are named ``__*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grapnel.llm.text import BLANKS, ascii_lower, let
from grapnel.scratch import materialize

MIN_KEY = 10  # code points
SHARES = 1024  # a key with more than this fraction of all lines is hot
BROADCAST_ROWS = 1_000_000  # hot keys; beyond, the engine chooses the join
SHARE_ROWS = (1_000, 2_000_000)  # least and most rows that one key brings to a task


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _occurrences(docs: DataFrame, doc_id: str, text: str, min_key: int) -> DataFrame:
    keys = F.transform(F.split(ascii_lower(_text(text)), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    lines = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("__doc"), F.xxhash64(_text(text)).alias("__fp"), F.posexplode_outer(keys).alias("__pos", "__key")
    )
    return lines.where(F.length("__key") >= min_key).select(
        "__doc", "__fp", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("second"), "__key").alias("__h2")
    )


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key: int = MIN_KEY, share_rows: tuple[int, int] = SHARE_ROWS) -> DataFrame:
    """One row for each document that loses lines: ``__doc``, ``__fp`` (its text's hash), ``__drop`` (array of
    ``skip``, the 64-bit words before in which every line stays, and ``bits``, the next word, where a set bit
    drops the line) and ``__n_dropped``."""
    lines = materialize(_occurrences(docs, doc_id, text, min_key), "line-hashes")
    total = lines.count()
    most = max(share_rows[0], min(share_rows[1], total // SHARES))
    prefix = F.shiftrightunsigned("__h1", 48).alias("__prefix")
    wide = lines.groupBy(prefix).count().where(F.col("count") > most).select("__prefix")  # 65,536 rows at most
    hot = (
        lines.withColumn("__prefix", prefix).join(F.broadcast(wide), "__prefix", "left_semi")
        .groupBy("__h1", "__h2").agg(F.count("*").alias("__n"), F.min("__doc").alias("__first"))
        .where(F.col("__n") > most).drop("__n")
    )  # fewer rows than total / most
    told = lines.join(F.broadcast(hot) if total // most <= BROADCAST_ROWS else hot, ["__h1", "__h2"], "left")
    run = Window.partitionBy("__h1", "__h2").orderBy("__doc", "__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = (
        told.where(F.col("__first").isNull()).drop("__first")
        .repartitionByRange("__h1", "__h2")
        .withColumn("__first", F.first("__doc").over(run))
    )
    dropped = (
        streamed.unionByName(told.where(F.col("__first").isNotNull()))
        .where(F.col("__doc") > F.col("__first")).select("__doc", "__fp", "__pos")
        .repartition("__doc", "__fp")
    )
    words = dropped.groupBy("__doc", "__fp", F.expr("__pos div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, __pos % 64)")).alias("__bits"))
    sparse = words.groupBy("__doc", "__fp").agg(F.sort_array(F.collect_list(F.struct("__word", "__bits"))).alias("__set"), F.sum(F.bit_count("__bits")).cast("long").alias("__n_dropped"))
    skipped = lambda set_: F.transform(set_, lambda x, i: F.struct((x["__word"] - F.coalesce(F.get(set_, i - 1)["__word"], F.lit(-1)) - 1).cast("int").alias("skip"), x["__bits"].alias("bits")))
    return sparse.select("__doc", "__fp", let(F.col("__set"), skipped).alias("__drop"), "__n_dropped")


def apply_keep(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__lines`` (kept lines joined by a line feed), ``__n_lines`` and ``__n_dropped``.

    The text moves once; the bitmaps are the built side of the hash join, so no text is sorted.  A bitmap is
    unpacked in the row that needs it.
    """
    keyed = docs.withColumn("__fp", F.xxhash64(_text(text)))
    small = bitmaps.withColumnRenamed("__fp", "__fp2").hint("shuffle_hash")
    joined = keyed.join(small, (F.col(doc_id) == F.col("__doc")) & (F.col("__fp") == F.col("__fp2")), "left")
    lines = F.split(_text(text), "\n")
    unpacked = F.flatten(F.transform("__drop", lambda x: F.concat(F.array_repeat(F.lit(0).cast("long"), x["skip"]), F.array(x["bits"]))))
    bit = lambda bits, i: F.call_function("shiftrightunsigned", F.get(bits, F.floor(i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long"))
    kept = let(unpacked, lambda bits: F.filter(lines, lambda line, i: F.coalesce(bit(bits, i) == 0, F.lit(True))))
    return joined.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("__drop").isNull(), _text(text)).otherwise(F.array_join(kept, "\n")).alias("__lines"),
        F.size(lines).cast("long").alias("__n_lines"),
        F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("__n_dropped"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Bitmaps made and applied in one go."""
    return apply_keep(docs, keep_bitmaps(docs, doc_id, text, **options), doc_id, text)
