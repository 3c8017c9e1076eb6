"""What a graph browser shows: a slice of ordered nodes, what is attached to them, and the visible edges.

Also the import plan (documents to sections, edges and groups) and the log of walks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from grapnel.operators import structure, traversal
from grapnel.plans import views
from grapnel.plans.views import oracle
from grapnel.registry import query


# ---- operators -------------------------------------------------------------------------------------

def paragraph_view(sections: DataFrame, graph: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a graph's paragraphs in document order: a top-k, then the offset is cut off."""
    w = Window.orderBy("doc_id", "ord")
    top = sections.where(F.col("graph_id") == graph).orderBy("doc_id", "ord").limit(offset + limit)  # bounded before the global rank
    return top.withColumn("place", F.row_number().over(w)).where(F.col("place") > offset)


def attached(shown: DataFrame, blocks: DataFrame, kinds: tuple[str, ...] = ("claim", "evidence", "limitation")) -> DataFrame:
    return blocks.where(F.col("node_type").isin(*kinds)).join(shown.select("section_id"), "section_id", "left_semi")


def visible_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends visible: two semi-joins."""
    ids = F.broadcast(ids.select("node_id"))
    return edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def chapter_view(sections: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): chapters, their context headings and paragraphs; orphans hang on a made-up chapter.

    Synthetic ids are hashes of what they stand for.
    """
    placed = structure.asof_outline(sections, outline).withColumn("chapter_id", F.concat(F.lit("ch-"), F.substring(F.sha2(F.concat_ws(":", "doc_id", F.coalesce(F.col("place").cast("string"), F.lit("none"))), 256), 1, 12)))
    chapters = placed.groupBy("doc_id", "chapter_id").agg(F.coalesce(F.first("title"), F.lit("(no chapter)")).alias("title"), F.count("*").alias("n_paragraphs"))
    contains = placed.select(F.col("chapter_id").alias("source_id"), F.col("section_id").alias("target_id"), F.lit("context_contains").alias("relation_type"))
    order = placed.join(sections.select("section_id", "ord"), "section_id")
    w = Window.partitionBy("chapter_id").orderBy("ord")
    follow = order.withColumn("next", F.lead("section_id").over(w)).where("next IS NOT NULL").select(F.col("section_id").alias("source_id"), F.col("next").alias("target_id"), F.lit("follows").alias("relation_type"))
    return chapters, contains.unionByName(follow)


def trace_row(result: traversal.Walk, plan: traversal.WalkPlan, question: str) -> DataFrame:
    """A walk's log entry: plan and result as JSON, id from the content."""
    ids = result.visited.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pop_order", "node_id"))), lambda x: x["node_id"]).alias("visited"), F.lit(result.stop).alias("stop_reason"))).alias("result_json"))
    told = ids.withColumn("plan_json", F.to_json(F.struct(F.lit(plan.mode).alias("mode"), F.lit(plan.max_depth).alias("max_depth"), F.lit(plan.max_nodes).alias("max_nodes"), F.array(*map(F.lit, plan.pointers)).alias("pointers"))))
    return told.withColumn("trace_id", F.concat(F.lit("trace_"), F.substring(F.sha2(F.concat_ws("|", F.lit(question), "plan_json", "result_json"), 256), 1, 12)))


def load_trace(traces: DataFrame) -> DataFrame:
    plan = F.from_json("plan_json", "mode string, max_depth int, max_nodes int, pointers array<string>")
    return traces.select("trace_id", plan.alias("plan"), F.from_json("result_json", "visited array<string>, stop_reason string").alias("result"))


def import_documents(spark, sf_dir: str) -> dict[str, DataFrame]:
    """The import as one lazy plan: cards, sections, outline, roles and groups, edges, quality flags."""
    s = views.sections(spark, sf_dir)
    o = structure.outline(spark, sf_dir)
    roles = structure.section_roles(s)
    return {"papers": views.papers(spark, sf_dir), "sections": structure.section_counters(s), "outline": structure.outline_parents(o), "placed": structure.asof_outline(s, o), "groups": structure.structure_groups(roles), "edges": views.edges(spark, sf_dir)}


# ---- queries ---------------------------------------------------------------------------------------

_PAGE = "SELECT *, row_number() OVER (ORDER BY doc_id, ord) AS place FROM sections WHERE graph_id = 'src2' QUALIFY place > 10 AND place <= 40"


def _page(spark, sf):
    return paragraph_view(views.sections(spark, sf), "src2", 30, 10)


@query(oracle(f"SELECT section_id, place FROM ({_PAGE})"))
def view_paragraphs(spark, sf):
    return _page(spark, sf).select("section_id", "place")


@query(oracle(f"SELECT node_id, node_type FROM blocks WHERE section_id IN (SELECT section_id FROM ({_PAGE}))"))
def view_argument_nodes(spark, sf):
    return attached(_page(spark, sf), views.blocks(spark, sf)).select("node_id", "node_type")


_IDS = f"SELECT section_id AS id FROM ({_PAGE}) UNION ALL SELECT node_id FROM blocks WHERE section_id IN (SELECT section_id FROM ({_PAGE}))"


@query(oracle("SELECT source_id, target_id, relation_type FROM edges WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)", ids=_IDS))
def view_mixed_edges(spark, sf):
    page = _page(spark, sf)
    ids = page.select(F.col("section_id").alias("node_id")).unionByName(attached(page, views.blocks(spark, sf)).select("node_id"))
    return visible_edges(views.edges(spark, sf), ids).select("source_id", "target_id", "relation_type")


_PLACED = f"SELECT *, 'ch-' || substr(sha256(doc_id || ':' || coalesce(place::VARCHAR, 'none')), 1, 12) AS chapter_id FROM ({structure._PLACED})"


@query(oracle("SELECT doc_id, chapter_id, coalesce(any_value(title), '(no chapter)') AS title, count(*) AS n_paragraphs FROM placed GROUP BY doc_id, chapter_id", ol=structure._OUTLINE, placed=_PLACED))
def view_chapters(spark, sf):
    return chapter_view(views.sections(spark, sf), structure.outline(spark, sf))[0]


@query(oracle("""SELECT chapter_id AS source_id, section_id AS target_id, 'context_contains' AS relation_type FROM placed UNION ALL
 SELECT section_id, n, 'follows' FROM (SELECT section_id, lead(section_id) OVER (PARTITION BY chapter_id ORDER BY ord) AS n FROM placed) WHERE n IS NOT NULL""", ol=structure._OUTLINE, placed=_PLACED))
def view_chapter_edges(spark, sf):
    return chapter_view(views.sections(spark, sf), structure.outline(spark, sf))[1]


_AUDIT = traversal.PRESETS["audit"]


@query(traversal._sql(_AUDIT, f"SELECT 'audit' AS mode, array_to_string(list(node_id ORDER BY depth, rn), ',') AS visited, 'exhausted' AS stop_reason FROM ({traversal._union('a', 3, 'node_id, depth, rn')})"))
def trace_round_trip(spark, sf):
    """A walk logged as JSON and read back."""
    saved = trace_row(traversal._run(spark, sf, _AUDIT), _AUDIT, "question")
    return load_trace(saved).select("plan.mode", F.array_join("result.visited", ",").alias("visited"), "result.stop_reason")


@query(oracle("""SELECT s.doc_id, count(*) AS n_sections, max(chapter) AS n_chapters, count(*) FILTER (g.role = 'content' AND g.group_id <> 'root') AS n_grouped FROM sections s JOIN groups g USING (section_id) GROUP BY s.doc_id""", roles=structure._ROLES, groups=structure._GROUPS))
def import_summary(spark, sf):
    made = import_documents(spark, sf)
    per = made["sections"].groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.max("chapter_no").alias("n_chapters"))
    grouped = made["groups"].where("role = 'content' AND group_id <> 'root'").groupBy("doc_id").agg(F.count("*").alias("n_grouped"))
    return per.join(grouped, "doc_id", "left").select("doc_id", "n_sections", "n_chapters", F.coalesce("n_grouped", F.lit(0)).alias("n_grouped"))
