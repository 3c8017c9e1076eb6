"""Lookups, listings, link tables, upserts, deletes and reports over the knowledge store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from grapnel.plans import views
from grapnel.plans.views import oracle
from grapnel.registry import query
from grapnel.scratch import materialize

PRIORITY_RANK = ("low", "medium", "high", "critical")


# ---- operators -------------------------------------------------------------------------------------

def by_id(frame: DataFrame, column: str, *ids) -> DataFrame:
    """Point and batch lookups: the predicate reaches the scan."""
    return frame.where(F.col(column).isin(*ids))


def in_scope(frame: DataFrame, graphs: list[str] | None) -> DataFrame:
    return frame if not graphs else frame.where(F.col("graph_id").isin(*graphs))


def relations_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges that join two nodes in either direction."""
    forth = edges.where((F.col("source_id") == a) & (F.col("target_id") == b))
    return forth.unionByName(edges.where((F.col("source_id") == b) & (F.col("target_id") == a)))


def alias_lookup(concepts: DataFrame, alias: str) -> DataFrame:
    """Concepts that have exactly this alias, ASCII case aside."""
    return concepts.where(F.exists("aliases", lambda x: F.lower(x) == alias.lower()))


def text_search(frame: DataFrame, text: str, columns: list[str], limit: int, order: list[str]) -> DataFrame:
    """Rows where any of the first three words (2 characters or more) stands in any column, case aside.

    Words are matched literally; the order is stated, so the limit is a top-k.
    """
    words = [w.lower() for w in text.split() if len(w) >= 2][:3]
    hit = F.lit(False)
    for w in words:
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w))
    return frame.where(hit).orderBy(*order).limit(limit)


def hierarchy(concepts: DataFrame) -> DataFrame:
    """(concept_key, graph_id, relation, other): parents, children and siblings through a shared parent."""
    own = concepts.select("graph_id", "concept_key", "parent_key").where(F.col("parent_key").isNotNull())
    up = own.select("graph_id", "concept_key", F.lit("parent").alias("relation"), F.col("parent_key").alias("other"))
    down = own.select("graph_id", F.col("parent_key").alias("concept_key"), F.lit("child").alias("relation"), F.col("concept_key").alias("other"))
    twin = own.select("graph_id", "parent_key", F.col("concept_key").alias("other"))
    beside = own.join(twin, ["graph_id", "parent_key"]).where("concept_key <> other").select("graph_id", "concept_key", F.lit("sibling").alias("relation"), "other")
    return up.unionByName(down).unionByName(beside).distinct()


def neighborhood(concepts: DataFrame, start: str, graph: str, depth: int) -> DataFrame:
    """Concepts within ``depth`` steps over parents and children, with the least depth of each.

    One join a level; the frontier only holds keys that no earlier level has reached.
    """
    links = hierarchy(concepts).where((F.col("relation") != "sibling") & (F.col("graph_id") == graph)).select("concept_key", "other")
    seen = concepts.where((F.col("concept_key") == start) & (F.col("graph_id") == graph)).select("concept_key", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = frontier.join(links, "concept_key").select(F.col("other").alias("concept_key")).distinct().join(seen, "concept_key", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace: rows of ``old`` whose key comes again go, then all of ``new`` is added."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last write a key wins; ties are settled by the order's later columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``gone``, children first."""
    return {name: frame.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti") for name, (frame, column) in tables.items()}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, frame in tables.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def missing_edges(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that should exist and don't: safe to run again after they were added."""
    return wanted.join(edges.select("source_id", "target_id", "relation_type"), ["source_id", "target_id", "relation_type"], "left_anti")


def inbox(blocks: DataFrame, below: float = 0.5) -> DataFrame:
    """Blocks of low confidence, for review."""
    kind = F.when(F.col("importance") == 1.0, "critical").when(F.col("importance") == 0.5, "high").otherwise(F.when(F.col("confidence") < 0.45, "medium").otherwise("low"))
    return blocks.where(F.col("confidence") < below).select(F.concat(F.lit("inbox-"), "node_id").alias("inbox_id"), F.col("node_id").alias("item_id"), F.col("node_type").alias("item_type"), kind.alias("priority"), "confidence", "graph_id", F.lit("pending").alias("decision"))


def priority_rank(column: str = "priority"):
    rank = F.lit(-1)
    for i, p in enumerate(PRIORITY_RANK):
        rank = F.when(F.col(column) == p, i).otherwise(rank)
    return rank


# ---- queries ---------------------------------------------------------------------------------------

DOC = 12


@query("SELECT doc_id AS paper_id, lang, source AS graph_id, length(text) AS n_chars FROM documents WHERE doc_id IN (3, 7, 12, 190)")
def store_point_lookup(spark: SparkSession, sf: str):
    return by_id(views.papers(spark, sf), "paper_id", 3, 7, 12, 190).select("paper_id", "lang", "graph_id", "n_chars")


@query(oracle("SELECT paper_id, title, year, row_number() OVER (ORDER BY year DESC, paper_id) AS place FROM papers WHERE graph_id = 'src3' ORDER BY place LIMIT 50"))
def store_list_papers(spark, sf):
    w = Window.orderBy(F.desc_nulls_last("year"), "paper_id")
    top = in_scope(views.papers(spark, sf), ["src3"]).orderBy(F.desc_nulls_last("year"), "paper_id").limit(50)
    return top.select("paper_id", "title", "year", F.row_number().over(w).alias("place"))


@query(oracle("SELECT section_id, ord, page, chapter, prev_id, next_id FROM sections WHERE doc_id = 12"))
def store_sections_of_document(spark, sf):
    return by_id(views.sections(spark, sf), "doc_id", DOC).orderBy("ord", "page", "section_id").select("section_id", "ord", "page", "chapter", "prev_id", "next_id")


@query(oracle("SELECT graph_id, node_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (NOT has_span) AS n_spanless FROM nodes GROUP BY ALL"))
def store_nodes_by_type(spark, sf):
    return views.nodes(spark, sf).groupBy("graph_id", "node_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(~F.col("has_span")).alias("n_spanless"))


@query(oracle("SELECT node_id, node_type, confidence, importance FROM nodes WHERE node_id IN ('n1-1', 'n5-2', 's5-2', 'n12-3', 'nowhere')"))
def store_resolve_batch(spark, sf):
    return by_id(views.nodes(spark, sf), "node_id", "n1-1", "n5-2", "s5-2", "n12-3", "nowhere").select("node_id", "node_type", "confidence", "importance")


@query(oracle("SELECT node_id, text, confidence FROM blocks WHERE node_type = 'claim' AND doc_id = 12 AND confidence >= 0.5"))
def store_claims_of_document(spark, sf):
    return views.blocks(spark, sf).where((F.col("node_type") == "claim") & (F.col("doc_id") == DOC) & (F.col("confidence") >= 0.5)).select("node_id", "text", "confidence")


@query(oracle("SELECT relation_id, relation_type, confidence FROM edges WHERE (source_id = 'n12-2' AND target_id = 'n12-1') OR (source_id = 'n12-1' AND target_id = 'n12-2')"))
def store_relations_between(spark, sf):
    return relations_between(views.edges(spark, sf), "n12-2", "n12-1").select("relation_id", "relation_type", "confidence")


@query(oracle("SELECT source_id, target_id, relation_type FROM edges WHERE source_id IN ('n12-1', 'n12-2', 's12-1', 's3-4')"))
def store_relations_from(spark, sf):
    return by_id(views.edges(spark, sf), "source_id", "n12-1", "n12-2", "s12-1", "s3-4").select("source_id", "target_id", "relation_type")


@query(oracle("SELECT graph_id, concept_key FROM concepts WHERE list_contains(list_transform(aliases, lambda a: lower(a)), (SELECT min(al) FROM (SELECT unnest(aliases) AS al FROM concepts)))"))
def store_alias_lookup(spark, sf):
    """Who has the first of all aliases, asked for in capitals."""
    c = materialize(views.concepts(spark, sf), "concepts")
    alias = c.select(F.explode("aliases").alias("al")).agg(F.min("al")).first()[0]
    return alias_lookup(c, (alias or "").upper()).select("graph_id", "concept_key")


@query(oracle("SELECT graph_id, concept_key, label FROM concepts WHERE namespace = 'method'"))
def store_namespace_list(spark, sf):
    return views.concepts(spark, sf).where("namespace = 'method'").orderBy("graph_id", "label").select("graph_id", "concept_key", "label")


@query(oracle("SELECT m.graph_id, m.concept_key, count(*) AS n_blocks, min(m.node_id) AS first_block FROM mentions m GROUP BY ALL"))
def store_blocks_for_concept(spark, sf):
    return views.mentions(spark, sf).groupBy("graph_id", "concept_key").agg(F.count("*").alias("n_blocks"), F.min("node_id").alias("first_block"))


@query(oracle("SELECT node_id, array_to_string(list_sort(list(concept_key)), ',') AS concept_keys FROM mentions GROUP BY node_id"))
def store_concepts_for_block(spark, sf):
    return views.mentions(spark, sf).groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("concept_key")), ",").alias("concept_keys"))


_HIERARCHY = """
 (SELECT graph_id, concept_key, 'parent' AS relation, parent_key AS other FROM concepts WHERE parent_key IS NOT NULL
  UNION SELECT graph_id, parent_key, 'child', concept_key FROM concepts WHERE parent_key IS NOT NULL
  UNION SELECT a.graph_id, a.concept_key, 'sibling', b.concept_key FROM concepts a JOIN concepts b ON a.graph_id = b.graph_id AND a.parent_key = b.parent_key AND a.concept_key <> b.concept_key)"""


@query(oracle(f"SELECT * FROM {_HIERARCHY}"))
def store_concept_hierarchy(spark, sf):
    return hierarchy(views.concepts(spark, sf)).select("graph_id", "concept_key", "relation", "other")


@query(oracle(f"""SELECT key AS concept_key, CAST(min(d) AS BIGINT) AS depth FROM (
  WITH RECURSIVE l AS (SELECT concept_key AS a, other AS b FROM {_HIERARCHY} WHERE relation <> 'sibling' AND graph_id = 'src1'),
  w AS (SELECT concept_key AS key, 0 AS d FROM concepts WHERE graph_id = 'src1' AND rank = 3 UNION ALL SELECT l.b, d + 1 FROM w JOIN l ON l.a = w.key WHERE d < 2)
  SELECT * FROM w) GROUP BY key"""))
def store_concept_neighborhood(spark, sf):
    c = materialize(views.concepts(spark, sf), "concepts")
    start = c.where("graph_id = 'src1' AND rank = 3").select("concept_key").first()
    return neighborhood(c, start[0] if start else "", "src1", 2)


@query(oracle("""SELECT 'sections' AS table_name, count(*) AS n FROM sections UNION ALL SELECT 'blocks', count(*) FROM blocks UNION ALL SELECT 'edges', count(*) FROM edges
 UNION ALL SELECT 'concepts', count(*) FROM concepts UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'papers', count(*) FROM papers"""))
def store_counts(spark, sf):
    return table_counts({n: getattr(views, n)(spark, sf) for n in ("sections", "blocks", "edges", "concepts", "mentions", "papers")})


@query(oracle("""SELECT 'claims_without_evidence' AS problem, b.graph_id, count(*) AS n FROM blocks b WHERE node_type = 'claim' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = b.node_id AND e.relation_type = 'supports') GROUP BY ALL
 UNION ALL SELECT 'blocks_without_links', b.graph_id, count(*) FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.relation_type <> 'belongs_to' AND (e.target_id = b.node_id OR e.source_id = b.node_id)) GROUP BY ALL
 UNION ALL SELECT 'claims_without_concepts', b.graph_id, count(*) FROM blocks b WHERE node_type = 'claim' AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.node_id = b.node_id) GROUP BY ALL"""))
def store_orphan_report(spark, sf):
    s = materialize(views.sections(spark, sf), "sections")
    b, e, m = views.blocks(spark, sf, s), views.edges(spark, sf, s), views.mentions(spark, sf, s)
    claims = b.where("node_type = 'claim'")
    linked = e.where("relation_type <> 'belongs_to'").select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    parts = {
        "claims_without_evidence": claims.join(e.where("relation_type = 'supports'").select(F.col("target_id").alias("node_id")).distinct(), "node_id", "left_anti"),
        "blocks_without_links": b.join(linked, "node_id", "left_anti"),
        "claims_without_concepts": claims.join(m.select("node_id").distinct(), "node_id", "left_anti"),
    }
    out = None
    for name, part in parts.items():
        one = part.groupBy("graph_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "graph_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(oracle("""SELECT source_id, target_id, relation_type FROM (
  SELECT section_id AS source_id, next_id AS target_id, 'section_next' AS relation_type FROM sections WHERE next_id IS NOT NULL
  UNION ALL SELECT node_id, section_id, 'belongs_to' FROM blocks
  UNION ALL SELECT node_id, concept_key, 'mentions' FROM mentions) w
 WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.confidence < 2 AND e.source_id = w.source_id AND e.target_id = w.target_id AND e.relation_type = w.relation_type AND NOT (e.relation_type = 'section_next' AND e.source_id LIKE '%7-%'))"""))
def store_missing_edges(spark, sf):
    """Edge completion on a store from which some next-edges were removed."""
    s = materialize(views.sections(spark, sf), "sections")
    b, m = views.blocks(spark, sf, s), views.mentions(spark, sf, s)
    have = views.edges(spark, sf, s).where(~((F.col("relation_type") == "section_next") & F.col("source_id").like("%7-%")))
    wanted = (
        s.where(F.col("next_id").isNotNull()).select(F.col("section_id").alias("source_id"), F.col("next_id").alias("target_id"), F.lit("section_next").alias("relation_type"))
        .unionByName(b.select(F.col("node_id").alias("source_id"), F.col("section_id").alias("target_id"), F.lit("belongs_to").alias("relation_type")))
        .unionByName(m.select(F.col("node_id").alias("source_id"), F.col("concept_key").alias("target_id"), F.lit("mentions").alias("relation_type")))
    )
    return missing_edges(wanted, have).select("source_id", "target_id", "relation_type")


_INBOX = """(SELECT 'inbox-' || node_id AS inbox_id, node_id AS item_id, node_type AS item_type,
  CASE WHEN importance = 1.0 THEN 'critical' WHEN importance = 0.5 THEN 'high' WHEN confidence < 0.45 THEN 'medium' ELSE 'low' END AS priority, confidence, graph_id, 'pending' AS decision FROM blocks WHERE confidence < 0.5)"""


@query(oracle(f"SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, inbox_id) AS place FROM {_INBOX} ORDER BY place LIMIT 40"))
def store_pending_reviews(spark, sf):
    top = inbox(views.blocks(spark, sf)).orderBy(F.desc(priority_rank()), "inbox_id").limit(40)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(priority_rank()), "inbox_id")))


@query(oracle(f"SELECT *, row_number() OVER (ORDER BY priority DESC, inbox_id) AS place FROM {_INBOX} ORDER BY place LIMIT 40"))
def store_pending_reviews_text_order(spark, sf):
    """The same list where the priority's name is what is sorted."""
    top = inbox(views.blocks(spark, sf)).orderBy(F.desc("priority"), "inbox_id").limit(40)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "inbox_id")))


@query(oracle("""SELECT 'sections' AS table_name, count(*) AS n FROM sections WHERE doc_id % 10 <> 3 UNION ALL SELECT 'blocks', count(*) FROM blocks WHERE doc_id % 10 <> 3
 UNION ALL SELECT 'mentions', count(*) FROM mentions m JOIN blocks b USING (node_id) WHERE b.doc_id % 10 <> 3 UNION ALL SELECT 'papers', count(*) FROM papers WHERE paper_id % 10 <> 3"""))
def store_cascade_remaining(spark, sf):
    p, b = views.papers(spark, sf), views.blocks(spark, sf)
    gone = p.where("paper_id % 10 = 3")
    tables = {"sections": (views.sections(spark, sf), "doc_id"), "blocks": (b, "doc_id"), "mentions": (views.mentions(spark, sf).join(b.select("node_id", "doc_id"), "node_id"), "doc_id"), "papers": (p, "paper_id")}
    return table_counts(cascade_delete(tables, gone, "paper_id"))


@query("""SELECT k, v FROM (SELECT l_orderkey AS k, l_linenumber::BIGINT AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1""")
def store_latest_wins(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"), F.col("l_shipdate").alias("at"))
    return latest(rows, ["k"], [F.desc("at"), F.desc("v")]).select("k", "v")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'renamed', c_acctbal + 1 FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT -s_suppkey, s_name, s_acctbal FROM supplier""")
def store_upsert(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("renamed").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    added = views.table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert(c, changed.unionByName(added), ["c_custkey"])


@query(oracle("SELECT section_id, page, length(text) AS n FROM sections WHERE page BETWEEN 2 AND 3 ORDER BY section_id LIMIT 200"))
def store_segments_by_page(spark, sf):
    return views.sections(spark, sf).where("page BETWEEN 2 AND 3").orderBy("section_id").limit(200).select("section_id", "page", F.length("text").alias("n"))


@query(oracle("SELECT node_id, confidence, row_number() OVER (ORDER BY confidence DESC, node_id) AS place FROM blocks WHERE node_type = 'claim' ORDER BY place LIMIT 100"))
def store_top_claims(spark, sf):
    top = views.blocks(spark, sf).where("node_type = 'claim'").orderBy(F.desc("confidence"), "node_id").limit(100)
    return top.select("node_id", "confidence", F.row_number().over(Window.orderBy(F.desc("confidence"), "node_id")).alias("place"))


@query(oracle("SELECT node_id FROM blocks WHERE node_type = 'claim' AND (contains(lower(text), 'tion') OR contains(lower(text), 'ung')) ORDER BY node_id LIMIT 20"))
def store_text_search(spark, sf):
    return text_search(views.blocks(spark, sf).where("node_type = 'claim'"), "tion x Ung", ["text"], 20, ["node_id"]).select("node_id")


@query(oracle("SELECT doc_id, chapter, min(ord) AS first_ord, min_by(text, ord) AS title, count(*) AS n FROM sections GROUP BY ALL"))
def store_outline_tree(spark, sf):
    return views.sections(spark, sf).groupBy("doc_id", "chapter").agg(F.min("ord").alias("first_ord"), F.min_by("text", "ord").alias("title"), F.count("*").alias("n"))


@query(oracle("""SELECT graph_id, count(*) AS n_edges, count(DISTINCT source_id) AS n_sources, round(sum(importance), 4) AS importance FROM edges
 WHERE relation_type IN ('supports', 'constrains', 'contradicts') GROUP BY graph_id"""))
def store_graph_relations(spark, sf):
    return views.edges(spark, sf).where(F.col("relation_type").isin("supports", "constrains", "contradicts")).groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.countDistinct("source_id").alias("n_sources"), F.round(F.sum("importance"), 4).alias("importance"))


@query(oracle("""SELECT e.target_id AS claim_id, coalesce(array_to_string(list_sort(list(source_id) FILTER (relation_type = 'supports')), ','), '') AS evidence_ids,
 coalesce(array_to_string(list_sort(list(source_id) FILTER (relation_type = 'constrains')), ','), '') AS limitation_ids FROM edges e WHERE relation_type IN ('supports', 'constrains') GROUP BY 1"""))
def store_links_of_claims(spark, sf):
    e = views.edges(spark, sf).where(F.col("relation_type").isin("supports", "constrains"))
    ids = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("relation_type") == kind, F.col("source_id")))), ",")
    return e.groupBy(F.col("target_id").alias("claim_id")).agg(ids("supports").alias("evidence_ids"), ids("constrains").alias("limitation_ids"))
