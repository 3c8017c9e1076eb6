"""Benchmark decontamination: documents that hold windows of benchmark words, found exactly.

Method.  A window is 10 consecutive words of an item (a shorter item is one window).  A document that
contains a window contains each of its words, so the rarest of them is a necessary prefix token:
words are ranked by how many documents of the whole corpus hold them, and only document words that are
some window's rarest word are joined.  Each join row names the window and the offset of its token, which
fixes where the window would have to start (positional bound) and end (length bound); the slice of
the document is then compared with the window word by word.  Only verified starts are shuffled.

Documents are taken apart in chunks of :data:`CHUNK` words that carry the few words before and after, so
the row that goes through the join is small however long the document is.

Broadcasts.  Windows, their item entries and their vocabulary grow with the benchmark, so each is counted
first.  Up to :data:`BROADCAST_ROWS` and :data:`BROADCAST_WORDS` they are broadcast; beyond, they are shuffled
and meet the rare words of the corpus only.  Either way the corpus is passed twice: for counts and for hits.
The benchmark's words are counted before that, as a bound on the rows of each table that is written between.

Defined results.  A null or empty text has no words; an item without words has no window.  Rows that
share an id and a text are one document and come back as often as they came in; a null id is an id
like another.  Items that share an id are one item; an item with a null id marks words, but is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grapnel.llm.text import NON_WORD_RUN, ascii_lower, let, pieces, rows_again
from grapnel.scratch import materialize

WINDOW = 10
BROADCAST_ROWS = 200_000
BROADCAST_WORDS = 1_000_000
CHUNK = 256


def words(text: str) -> Column:
    return pieces(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NON_WORD_RUN)


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct windows: ``__window`` (array of words) and ``__items`` (sorted ids, as strings)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("__w") - width, F.lit(0)))
    return (
        benchmark.select(F.col(item_id).cast("string").alias("__item"), words(text).alias("__w")).where(F.size("__w") > 0)
        .select("__item", "__w", F.explode(starts).alias("__at"))
        .groupBy(F.slice("__w", F.col("__at") + 1, width).alias("__window")).agg(F.sort_array(F.collect_set("__item")).alias("__items"))
    )


def _small(frame: DataFrame, rows: int, most: int) -> DataFrame:
    """The frame, marked for broadcast if it has few enough rows; else the engine shuffles it."""
    return F.broadcast(frame) if rows <= most else frame


def word_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text", most: int = BROADCAST_WORDS) -> DataFrame:
    """How many documents of the whole corpus hold each word of the vocabulary.

    A document's words are made distinct before they leave it; what is shuffled is a row a word and task.
    """
    held = docs.select(F.explode_outer(F.array_distinct(words(text))).alias("__token"))
    return held.join(_small(vocabulary, vocabulary.count(), most), "__token", "left_semi").groupBy("__token").agg(F.count("*").alias("__df"))


def prefix_tokens(windows: DataFrame, counts: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """Each window's rarest word and its offset: ``__token, __offset, __window, __items``."""
    placed = windows.select("__window", "__items", F.posexplode("__window").alias("__offset", "__token"))
    ranked = placed.join(_small(counts, counts.count(), most), "__token", "left").select("__window", "__items", F.struct(F.coalesce("__df", F.lit(0)).alias("df"), F.col("__token").alias("token"), F.col("__offset").alias("at")).alias("__rank"))
    least = ranked.groupBy("__window").agg(F.min("__rank").alias("__rank"), F.first("__items").alias("__items"))
    return least.select(F.col("__rank.token").alias("__token"), F.col("__rank.at").alias("__offset"), "__window", "__items")


def _chunks(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Chunks of words with up to ``width - 1`` words around: ``__from`` (place of the first core word),
    ``__lead`` (words before it), ``__w`` (all), ``__core`` (an empty marker, then the core words)."""

    def cut(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(CHUNK))
        lead = lambda s: F.least(s, F.lit(width - 1))
        return F.transform(at, lambda s: F.struct(
            s.alias("from"), lead(s).alias("lead"), F.size(w).alias("n"), F.slice(w, s - lead(s) + 1, lead(s) + CHUNK + width - 1).alias("w"),
            F.concat(F.array(F.lit("")), F.slice(w, s + 1, CHUNK)).alias("core"),
        ))

    spelled = docs.select(F.col(doc_id).alias("__doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__fp"), let(words(text), cut).alias("__cut"))
    return spelled.select("__doc", "__fp", F.explode_outer("__cut").alias("__c")).select(
        "__doc", "__fp", F.col("__c.from").alias("__from"), F.col("__c.lead").alias("__lead"), F.col("__c.n").alias("__n"), F.col("__c.w").alias("__w"), F.col("__c.core").alias("__core")
    )


_TABLE = "array<struct<__offset:int,__window:array<string>,__items:array<string>>>"


def _hits(docs: DataFrame, tokens: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Rows ``__doc, __fp, __first, __n, __hit``: one marker for each document row, and one for each
    verified window (start, end, items).  The window table is broadcast."""
    table = tokens.groupBy("__token").agg(F.collect_list(F.struct("__offset", "__window", "__items")).alias("__at"))
    marker = docs.sparkSession.range(1).select(F.lit("").alias("__token"), F.expr(f"CAST(NULL AS {_TABLE})").alias("__at"))
    at = _chunks(docs, doc_id, text, width).select("__doc", "__fp", "__from", "__lead", "__n", "__w", F.posexplode_outer("__core").alias("__pos", "__token"))
    told = at.join(F.broadcast(table.unionByName(marker)), "__token").where((F.col("__pos") > 0) | (F.col("__from") == 0))
    # the token's place in __w is lead + pos - 1 from 0, and in the document from + pos - 1
    start = lambda x: F.col("__lead") + F.col("__pos") - 1 - x["__offset"]
    size = lambda x: F.size(x["__window"])
    verified = F.filter("__at", lambda x: (start(x) >= 0) & (start(x) + size(x) <= F.size("__w")) & (F.slice("__w", F.greatest(start(x), F.lit(0)) + 1, size(x)) == x["__window"]))
    base = F.col("__from") - F.col("__lead")
    hits = F.transform(verified, lambda x: F.struct((base + start(x)).alias("s"), (base + start(x) + size(x)).alias("e"), x["__items"].alias("i")))
    # a generator, not a filter: a filter would move into the join and take it out of generated code
    return told.select("__doc", "__fp", (F.col("__pos") == 0).alias("__first"), "__n", F.explode_outer(hits).alias("__hit")).where(F.col("__first") | F.col("__hit").isNotNull())


def _hits_shuffled(docs: DataFrame, tokens: DataFrame, doc_id: str, text: str, width: int, most: int) -> DataFrame:
    """The rows of :func:`_hits` for a window table that is too large to broadcast.

    The corpus is still passed once.  Only words that are some window's rarest go on, each with the words
    that a window over it could reach, and meet the windows by a shuffle; markers get keys of their own.
    """
    rare = tokens.select("__token").distinct()
    at = _chunks(docs, doc_id, text, width).select("__doc", "__fp", "__from", "__lead", "__n", "__w", F.posexplode_outer("__core").alias("__pos", "__token"))
    known = at.join(_small(rare.withColumn("__rare", F.lit(True)), rare.count(), most), "__token", "left")
    place = F.col("__lead") + F.col("__pos") - 1
    first = (F.col("__pos") == 0) & (F.col("__from") == 0)
    near = known.where(first | ((F.col("__pos") > 0) & F.col("__rare"))).select(
        "__doc", "__fp", "__n", first.alias("__first"), F.when(first, F.concat(F.lit(" "), F.col("__fp").cast("string"))).otherwise(F.col("__token")).alias("__token"),
        F.least(place, F.lit(width - 1)).alias("__left"), (F.col("__from") + F.col("__pos") - 1).alias("__at"),
        F.when(~first, F.slice("__w", F.greatest(place - (width - 1), F.lit(0)) + 1, 2 * width - 1)).alias("__around"),
    )
    start, size = F.col("__left") - F.col("__offset"), F.size("__window")
    same = (start >= 0) & (start + size <= F.size("__around")) & (F.slice("__around", F.greatest(start, F.lit(0)) + 1, F.greatest(size, F.lit(0))) == F.col("__window"))
    met = near.join(tokens, "__token", "left").where(F.col("__first") | same)
    hit = F.when(~F.col("__first"), F.struct((F.col("__at") - F.col("__offset")).alias("s"), (F.col("__at") - F.col("__offset") + size).alias("e"), F.col("__items").alias("i")))
    return met.select("__doc", "__fp", "__first", "__n", hit.alias("__hit"))


def contaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row for each document: the id, ``n_words``, ``n_hit``, ``items`` (sorted array), ``contaminated``."""
    # no item has more windows, or more different words, than words
    bound = benchmark.agg(F.coalesce(F.sum(F.size(words(item_text))), F.lit(0))).first()[0]
    windows = materialize(item_windows(benchmark, item_id, item_text, width), "windows", bound)
    vocabulary = materialize(windows.select(F.explode("__window").alias("__token")).distinct(), "vocabulary", bound)
    counts = materialize(word_counts(docs, vocabulary, text, broadcast_words), "word-counts", bound)
    tokens = materialize(prefix_tokens(windows, counts, broadcast_words), "prefix-tokens", bound)
    # an item that many windows share is a longer list, so list entries count too
    size = windows.agg(F.count("*"), F.coalesce(F.sum(F.size("__items")), F.lit(0))).first()
    small = max(size) <= broadcast_rows
    found = _hits(docs, tokens, doc_id, text, width) if small else _hits_shuffled(docs, tokens, doc_id, text, width, broadcast_words)
    grouped = found.groupBy("__doc", "__fp").agg(
        F.max("__n").alias("__n"), F.count_if(F.col("__first")).alias("__rows"),
        F.collect_set(F.when(F.col("__hit").isNotNull(), F.struct("__hit.s", "__hit.e"))).alias("__runs"),
        F.array_distinct(F.flatten(F.collect_set("__hit.i"))).alias("__items"),
    )
    runs = F.sort_array("__runs")
    covered = F.aggregate(
        runs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(r["e"] - F.greatest(acc["to"], r["s"]), F.lit(0))).alias("n"), F.greatest(acc["to"], r["e"]).alias("to")),
    )["n"]
    done = grouped.select(
        F.col("__doc").alias(doc_id), F.col("__n").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"),
        F.sort_array("__items").alias("items"), (F.size("__runs") > 0).alias("contaminated"), "__rows",
    )
    return done.select(*done.columns, rows_again("__rows").alias("__copy")).drop("__rows", "__copy")
