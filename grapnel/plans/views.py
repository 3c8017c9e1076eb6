"""The knowledge-graph data model as views over plain document tables.

Every view is a pure plan over the driver tables, or over sections that were written once (``s``); ids are
derived from document and position, never random.  ``SQL`` holds the same views for DuckDB, written independently; :func:`oracle` puts them in
front of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

NODE_TYPES = ("claim", "claim", "claim", "evidence", "limitation")
CLAIM_EDGES = ("contradicts", "refines", "derived_from", "extends")
NAMESPACES = ("topic", "method", "entity")
SECTIONS_PER_CHAPTER = 5
SECTIONS_PER_PAGE = 3
CONCEPTS_PER_GRAPH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document card each: title is the first line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("paper_id"), F.col("source").alias("graph_id"), "lang",
        F.btrim(F.get(F.split("text", "\n"), F.lit(0))).alias("title"),
        (F.lit(1990) + F.col("doc_id") % 35).cast("long").alias("year"), F.length("text").cast("long").alias("n_chars"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more, in document order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("graph_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = docs.withColumn("text", F.btrim("line")).where(F.length("text") >= 20)
    w = Window.partitionBy("doc_id").orderBy("pos")
    ordered = kept.withColumn("ord", F.row_number().over(w).cast("long"))
    sid = lambda o: F.concat(F.lit("s"), F.col("doc_id"), F.lit("-"), o)
    return ordered.select(
        sid(F.col("ord")).alias("section_id"), "doc_id", "graph_id", "ord", "text", F.length("text").cast("long").alias("n_chars"),
        (F.floor((F.col("ord") - 1) / SECTIONS_PER_PAGE) + 1).cast("long").alias("page"),
        (F.floor((F.col("ord") - 1) / SECTIONS_PER_CHAPTER) + 1).cast("long").alias("chapter"),
        ((F.col("ord") - 1) % SECTIONS_PER_CHAPTER == 0).alias("is_head"),
        sid(F.lag("ord").over(w)).alias("prev_id"), sid(F.lead("ord").over(w)).alias("next_id"),
    )


def blocks(spark: SparkSession, sf_dir: str, s: DataFrame | None = None) -> DataFrame:
    """Claims, evidence and limitations: one block a section, its kind by position."""
    s = sections(spark, sf_dir) if s is None else s
    return s.select(
        F.concat(F.lit("n"), "doc_id", F.lit("-"), "ord").alias("node_id"), pick(NODE_TYPES, F.col("ord") % 5).alias("node_type"), "graph_id", "doc_id", "ord", "section_id", "text",
        ((F.col("n_chars") % 60 + 40).cast("double") / 100).alias("confidence"),
        F.get(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.2)), (F.col("n_chars") % 3).cast("int")).alias("importance"),
        (F.col("n_chars") >= 40).alias("has_span"),
    )


def nodes(spark: SparkSession, sf_dir: str, s: DataFrame | None = None) -> DataFrame:
    """All nodes a walk can visit: blocks and sections (their text cut to 500 characters)."""
    own = (sections(spark, sf_dir) if s is None else s).select(
        F.col("section_id").alias("node_id"), F.lit("section").alias("node_type"), "graph_id", "doc_id", "ord", "section_id",
        F.substring("text", 1, 500).alias("text"), F.lit(1.0).alias("confidence"), F.lit(0.5).alias("importance"), F.lit(True).alias("has_span"),
    )
    return blocks(spark, sf_dir, s).unionByName(own)


def edges(spark: SparkSession, sf_dir: str, s: DataFrame | None = None) -> DataFrame:
    """Typed, weighted, directed: five shapes over the blocks and sections of a document."""
    s = sections(spark, sf_dir) if s is None else s
    b = blocks(spark, sf_dir, s)
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    claim = F.when(F.col("node_type") == "claim", F.struct("node_id", F.length("text").alias("n")))
    told = b.withColumn("prior", F.last(claim, ignorenulls=True).over(before))
    linked = told.where(F.col("prior").isNotNull()).select(
        "graph_id", F.col("node_id").alias("source_id"), F.col("prior.node_id").alias("target_id"),
        F.when(F.col("node_type") == "evidence", "supports").when(F.col("node_type") == "limitation", "constrains")
        .otherwise(pick(CLAIM_EDGES, (F.length("text") + F.col("prior.n")) % 4)).alias("relation_type"),
        "confidence", F.when(F.col("node_type") == "claim", F.col("importance")).otherwise(F.lit(0.8)).alias("importance"),
    )
    linked = linked.withColumn("cost", F.when(F.col("relation_type") == "contradicts", F.lit(1.5)).otherwise(F.lit(1.0)))
    made = lambda d, a, z, kind, imp, cost: d.select("graph_id", a.alias("source_id"), z.alias("target_id"), F.lit(kind).alias("relation_type"), F.lit(1.0).alias("confidence"), F.lit(imp).alias("importance"), F.lit(cost).alias("cost"))
    head = F.concat(F.lit("s"), F.col("doc_id"), F.lit("-"), ((F.col("chapter") - 1) * SECTIONS_PER_CHAPTER + 1).cast("string"))
    every = (
        linked.unionByName(made(s.where(F.col("next_id").isNotNull()), F.col("section_id"), F.col("next_id"), "section_next", 0.4, 0.2))
        .unionByName(made(s.where(~F.col("is_head")), F.col("section_id"), head, "section_parent", 0.5, 0.2))
        .unionByName(made(b, F.col("node_id"), F.col("section_id"), "belongs_to", 0.6, 0.1))
    )
    return every.withColumn("relation_id", F.concat_ws("|", "source_id", "relation_type", "target_id"))


def graph_words(spark: SparkSession, sf_dir: str, s: DataFrame | None = None) -> DataFrame:
    words = (sections(spark, sf_dir) if s is None else s).select("graph_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("word"))
    return words.groupBy("graph_id", "word").agg(F.count("*").alias("n"))


def concepts(spark: SparkSession, sf_dir: str, s: DataFrame | None = None) -> DataFrame:
    """The ten most frequent longer words of each graph, in a small hierarchy."""
    counted = graph_words(spark, sf_dir, s)
    top = Window.partitionBy("graph_id").orderBy(F.desc("n"), "word")
    ranked = counted.withColumn("rank", F.row_number().over(top).cast("long")).where(F.col("rank") <= CONCEPTS_PER_GRAPH)
    like = Window.partitionBy("graph_id", "label").orderBy(F.desc("m"), "other")
    aliases = (
        ranked.select("graph_id", F.col("word").alias("label"))
        .join(counted.select("graph_id", F.col("word").alias("other"), F.col("n").alias("m")), "graph_id")
        .where((F.substring("label", 1, 4) == F.substring("other", 1, 4)) & (F.col("label") != F.col("other")))
        .withColumn("r", F.row_number().over(like)).where("r <= 3")
        .groupBy("graph_id", "label").agg(F.sort_array(F.collect_list("other")).alias("aliases"))
    )
    key = lambda c: F.concat(F.lit("concept:"), c)
    parent = ranked.select("graph_id", F.col("rank").alias("up"), key(F.col("word")).alias("parent_key"))
    return (
        ranked.withColumnRenamed("word", "label").join(aliases, ["graph_id", "label"], "left")
        .withColumn("up", F.when(F.col("rank") > 1, F.floor(F.col("rank") / 2)).cast("long")).join(parent, ["graph_id", "up"], "left")
        .select(
            key(F.col("label")).alias("concept_key"), "graph_id", "label", F.coalesce("aliases", F.expr("CAST(array() AS array<string>)")).alias("aliases"), "parent_key", "rank", "n",
            pick(NAMESPACES, F.col("rank") % 3).alias("namespace"), F.when(F.col("rank") == CONCEPTS_PER_GRAPH, "candidate").otherwise("active").alias("status"),
        )
    )


def mentions(spark: SparkSession, sf_dir: str, s: DataFrame | None = None) -> DataFrame:
    """Which claim names which concept of its graph."""
    words = blocks(spark, sf_dir, s).where("node_type = 'claim'").select("graph_id", "node_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("label"))
    return words.join(concepts(spark, sf_dir, s).select("graph_id", "label", "concept_key"), ["graph_id", "label"]).select("node_id", "concept_key", "graph_id")


SQL = {
    "sections": """
      SELECT 's' || doc_id || '-' || ord AS section_id, doc_id, graph_id, ord, text, length(text) AS n_chars,
        (ord - 1) // 3 + 1 AS page, (ord - 1) // 5 + 1 AS chapter, (ord - 1) % 5 = 0 AS is_head,
        CASE WHEN ord > 1 THEN 's' || doc_id || '-' || (ord - 1) END AS prev_id,
        CASE WHEN ord < max(ord) OVER (PARTITION BY doc_id) THEN 's' || doc_id || '-' || (ord + 1) END AS next_id
      FROM (SELECT doc_id, graph_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord
        FROM (SELECT doc_id, source AS graph_id, trim(unnest(string_split(text, chr(10)))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        WHERE length(text) >= 20)""",
    "blocks": """
      SELECT 'n' || doc_id || '-' || ord AS node_id, CASE ord % 5 WHEN 3 THEN 'evidence' WHEN 4 THEN 'limitation' ELSE 'claim' END AS node_type,
        graph_id, doc_id, ord, section_id, text, CAST(n_chars % 60 + 40 AS DOUBLE) / 100 AS confidence,
        CAST(CASE n_chars % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS importance, n_chars >= 40 AS has_span
      FROM sections""",
    "nodes": """
      SELECT * FROM blocks UNION ALL
      SELECT section_id, 'section', graph_id, doc_id, ord, section_id, substr(text, 1, 500), 1.0::DOUBLE, 0.5::DOUBLE, true FROM sections""",
    "edges": """
      SELECT *, concat_ws('|', source_id, relation_type, target_id) AS relation_id FROM (
      SELECT graph_id, node_id AS source_id, p.id AS target_id, relation_type, confidence, CASE WHEN node_type = 'claim' THEN importance ELSE 0.8::DOUBLE END AS importance,
        CASE WHEN relation_type = 'contradicts' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS cost
      FROM (SELECT *, CASE node_type WHEN 'evidence' THEN 'supports' WHEN 'limitation' THEN 'constrains'
          ELSE ['contradicts', 'refines', 'derived_from', 'extends'][(length(text) + p.n) % 4 + 1] END AS relation_type
        FROM (SELECT *, last_value(CASE WHEN node_type = 'claim' THEN {'id': node_id, 'n': length(text)} END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM blocks) WHERE p IS NOT NULL)
      UNION ALL SELECT graph_id, section_id, next_id, 'section_next', 1.0, 0.4, 0.2 FROM sections WHERE next_id IS NOT NULL
      UNION ALL SELECT graph_id, section_id, 's' || doc_id || '-' || ((chapter - 1) * 5 + 1), 'section_parent', 1.0, 0.5, 0.2 FROM sections WHERE NOT is_head
      UNION ALL SELECT graph_id, node_id, section_id, 'belongs_to', 1.0, 0.6, 0.1 FROM blocks)""",
    "graph_words": """
      SELECT graph_id, word, count(*) AS n FROM (SELECT graph_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM sections) GROUP BY ALL""",
    "concepts": """
      WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, word) AS rank FROM graph_words) WHERE rank <= 10),
      a AS (SELECT graph_id, label, list_sort(list(other)) AS aliases FROM (
          SELECT r.graph_id, r.word AS label, w.word AS other, row_number() OVER (PARTITION BY r.graph_id, r.word ORDER BY w.n DESC, w.word) AS k
          FROM r JOIN graph_words w ON r.graph_id = w.graph_id AND left(r.word, 4) = left(w.word, 4) AND r.word <> w.word) WHERE k <= 3 GROUP BY ALL)
      SELECT 'concept:' || r.word AS concept_key, r.graph_id, r.word AS label, coalesce(a.aliases, []) AS aliases,
        CASE WHEN r.rank > 1 THEN 'concept:' || p.word END AS parent_key, r.rank, r.n,
        CASE r.rank % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'method' ELSE 'entity' END AS namespace, CASE WHEN r.rank = 10 THEN 'candidate' ELSE 'active' END AS status
      FROM r LEFT JOIN a ON r.graph_id = a.graph_id AND r.word = a.label LEFT JOIN r p ON r.graph_id = p.graph_id AND p.rank = r.rank // 2""",
    "mentions": """
      SELECT DISTINCT b.node_id, c.concept_key, b.graph_id
      FROM (SELECT graph_id, node_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM blocks WHERE node_type = 'claim') b
      JOIN concepts c ON b.graph_id = c.graph_id AND b.word = c.label""",
    "papers": """
      SELECT doc_id AS paper_id, source AS graph_id, lang, trim(string_split(text, chr(10))[1]) AS title, 1990 + doc_id % 35 AS year, length(text) AS n_chars FROM documents""",
}


def oracle(body: str, **more: str) -> str:
    """``body`` with the views (and further CTEs) in front of it."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (SQL | more).items()) + body
