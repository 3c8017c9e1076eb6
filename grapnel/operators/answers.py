"""Questions answered from a stored graph: written once, asked often, many questions at a time.

The store holds nodes (blocks, sections, concepts), adjacency in both directions and concepts, each sorted by
the column it is looked up by, so that file statistics prune what a level of a walk reads.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from grapnel.operators import retrieval, traversal
from grapnel.operators.linkage import bridge_candidates
from grapnel.operators.store import text_search
from grapnel.operators.traversal import BOTH_WAYS, BRIDGE_COST, SPAN_GATED, Walk, WalkPlan
from grapnel.plans import views
from grapnel.plans.views import oracle
from grapnel.registry import query
from grapnel.scratch import materialize

EMBEDDING = 64
CONCEPT_CONFIDENCE, INTENT_CHARS = 0.8, 50
FEW = 2  # fewer results than this fall back to paragraphs


# ---- the store -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class GraphStore:
    nodes: DataFrame
    edges: DataFrame
    adjacency: DataFrame
    concepts: DataFrame
    bridges: DataFrame


def concept_nodes(concepts: DataFrame) -> DataFrame:
    """Concepts as nodes; a key is qualified by its graph."""
    return concepts.select(
        concept_id(F.col("graph_id"), F.col("concept_key")).alias("node_id"), F.lit("concept").alias("node_type"), "graph_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("section_id"),
        F.col("label").alias("text"), F.lit(CONCEPT_CONFIDENCE).alias("confidence"), F.lit(0.5).alias("importance"), F.lit(True).alias("has_span"),
    )


def concept_id(graph: Column, key: Column) -> Column:
    return F.concat(graph, F.lit("/"), key)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, type, neighbor, confidence, importance, cost): outgoing edges, and incoming ones of types that are walked
    both ways.  Of parallel edges the first by direction, importance and cost stays; the weakest confidence a plan may
    ask for is applied at reading, so it is part of that order."""
    shape = lambda d, a, b, way: d.select(F.col(a).alias("node"), F.col("relation_type").alias("type"), F.col(b).alias("neighbor"), "confidence", "importance", "cost", "relation_id", F.lit(way).alias("way"))
    kept = edges.where("source_id <> target_id")
    return shape(kept, "source_id", "target_id", 0).unionByName(shape(kept.where(F.col("relation_type").isin(*BOTH_WAYS)), "target_id", "source_id", 1))


_OPEN: dict[tuple[str, str], GraphStore] = {}


def build_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Views to written tables.  Sections are made once and read for all that is derived from them."""
    sections = materialize(views.sections(spark, sf_dir), "sections")
    concepts = materialize(views.concepts(spark, sf_dir, sections), "concepts")
    nodes = views.nodes(spark, sf_dir, sections).unionByName(concept_nodes(concepts))
    edges = materialize(views.edges(spark, sf_dir, sections), "edges")
    found = bridge_candidates(concepts)
    bridges = found.select(
        F.col("graph_id_a").alias("source_graph_id"), concept_id(F.col("graph_id_a"), F.col("concept_key_a")).alias("source_id"), concept_id(F.col("graph_id_b"), F.col("concept_key_b")).alias("target_id"),
        "bridge_type", "review_status", "confidence", F.lit(BRIDGE_COST).alias("cost"),
    )
    by = lambda frame, key: frame.repartitionByRange(key).sortWithinPartitions(key)
    return GraphStore(materialize(by(nodes, "node_id"), "nodes"), edges, materialize(by(both_ways(edges), "node"), "adjacency"), concepts, materialize(by(bridges, "source_id"), "bridges"))


def open_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The store of these tables; written by the first who asks in a Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = build_store(spark, sf_dir)
    return _OPEN[key]


# ---- many walks at once ----------------------------------------------------------------------------

def walk_many(store: GraphStore, starts: DataFrame, plan: WalkPlan) -> tuple[DataFrame, DataFrame]:
    """(visited, edges) of one walk a question from ``starts`` (question_id, node_id).

    The levels of :func:`traversal.walk` with the question as a further key: what a question may still visit
    and spend is a row of a small table, top-k and prefix sums are windows over the question.  Levels are
    written, so nothing is computed twice; no row reaches the driver.
    """
    gate = F.lit(True)
    if plan.scope:
        gate = gate & F.col("graph_id").isin(*plan.scope)
    if plan.require_span:
        gate = gate & (~F.col("node_type").isin(*SPAN_GATED) | F.col("has_span"))
    nodes = store.nodes.where(gate).select("node_id", "node_type", "confidence", "importance", F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    first = Window.partitionBy("question_id", "node", "type", "neighbor").orderBy("way", F.desc("importance"), "cost", "relation_id")
    types = F.array(*map(F.lit, (*plan.pointers, *plan.bridges)))
    state = starts.select("question_id").distinct().withColumns({"n_seen": F.lit(0).cast("long"), "spent": F.lit(0).cast("long"), "stopped": F.lit(False), "jumps": F.lit(0).cast("long")})
    frame = starts.distinct().withColumn("priority", F.lit(0.0))
    visited = walked = used = None
    for depth in range(plan.max_depth + 1):
        fresh = frame.join(state.where(~F.col("stopped")), "question_id")
        if visited is not None:
            fresh = fresh.join(visited.select("question_id", "node_id"), ["question_id", "node_id"], "left_anti")
        w = Window.partitionBy("question_id").orderBy("priority", "node_id")
        ranked = fresh.join(nodes, "node_id").withColumns({"rn": F.row_number().over(w), "before": F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        taken = ranked.where((F.col("rn") + F.col("n_seen") <= plan.max_nodes) & (F.col("before") + F.col("spent") < plan.budget))
        level = materialize(taken.select("question_id", "node_id", "node_type", F.lit(depth).alias("depth"), (F.col("rn") + F.col("n_seen")).alias("pop_order"), "confidence", "importance", "tokens"), "level")
        visited = level if visited is None else visited.unionByName(level)
        if depth == plan.max_depth:
            break
        gained = level.groupBy("question_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
        state = state.join(gained, "question_id", "left").select(
            "question_id", (F.col("n_seen") + F.coalesce("n", F.lit(0))).alias("n_seen"), (F.col("spent") + F.coalesce("t", F.lit(0))).alias("spent"), F.col("stopped") | F.col("n").isNull(), "jumps"
        ).toDF("question_id", "n_seen", "spent", "stopped", "jumps")
        state = state.withColumn("stopped", F.col("stopped") | (F.col("n_seen") >= plan.max_nodes) | (F.col("spent") >= plan.budget))
        front = level.select("question_id", F.col("node_id").alias("node"), "pop_order")
        near = front.join(store.adjacency.where(F.col("type").isin(*plan.pointers) & (F.col("confidence") >= plan.min_confidence)), "node")
        near = near.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select("question_id", "node", "pop_order", "type", "neighbor", "confidence", "importance", "cost")
        if plan.bridges:
            own = front.join(store.nodes.select(F.col("node_id").alias("node"), "graph_id"), "node")
            near = near.unionByName(own.join(traversal.bridge_adjacency(store.bridges, plan), ["node", "graph_id"]).select(*near.columns))
        degree = near.groupBy("question_id", "node", "pop_order", "type").agg(F.count("*").alias("n"))
        capped = Window.partitionBy("question_id", "type").orderBy("pop_order").rowsBetween(Window.unboundedPreceding, -1)
        hop = F.col("type").isin(*plan.bridges) if plan.bridges else F.lit(False)
        hops = Window.partitionBy("question_id", hop).orderBy("pop_order", F.array_position(types, F.col("type"))).rowsBetween(Window.unboundedPreceding, -1)
        degree = degree.withColumns({"by_type": F.coalesce(F.sum("n").over(capped), F.lit(0)), "by_hop": F.coalesce(F.sum("n").over(hops), F.lit(0))})
        if used is not None:
            degree = degree.join(used, ["question_id", "type"], "left").withColumn("by_type", F.col("by_type") + F.coalesce("used", F.lit(0))).drop("used")
        degree = degree.join(state.select("question_id", "jumps"), "question_id").withColumn("by_hop", F.col("by_hop") + F.col("jumps"))
        opened = degree.where(F.when(hop, F.col("by_hop") < plan.max_jumps).otherwise(F.col("by_type") < plan.edge_cap)).select("question_id", "node", "type")
        steps = materialize(near.join(opened, ["question_id", "node", "type"], "left_semi").withColumn("depth", F.lit(depth)), "steps")
        walked = steps if walked is None else walked.unionByName(steps)
        used = walked.groupBy("question_id", "type").agg(F.count("*").alias("used"))
        if plan.bridges:
            made = walked.where(F.col("type").isin(*plan.bridges)).groupBy("question_id").agg(F.count("*").alias("made"))
            state = state.join(made, "question_id", "left").withColumn("jumps", F.coalesce("made", F.lit(0))).drop("made")
        state = materialize(state, "walk-state")
        frame = steps.select("question_id", F.col("neighbor").alias("node_id"), ((depth + 1) * 100 + F.col("cost") * 10 - F.col("importance") * 3 - F.col("confidence") * 2).alias("priority")).groupBy("question_id", "node_id").agg(F.min("priority").alias("priority"))
    return visited, walked.select("question_id", "depth", "node", "type", "neighbor", "confidence")


# ---- one question ----------------------------------------------------------------------------------

def claim_distance(text: Column, question: str) -> Column:
    """Squared distance of the deterministic embeddings of a text and a question, in steps of their bytes."""
    import hashlib

    probe = hashlib.sha256(question.encode()).digest()
    digest = F.unhex(F.sha2(text, 256))
    byte = lambda i: F.conv(F.hex(F.substring(digest, i + 1, 1)), 16, 10).cast("long")
    total = F.lit(0).cast("long")
    for i in range(32):
        total = total + (byte(i) - probe[i]) * (byte(i) - probe[i])
    return total * (EMBEDDING // 32)  # the digest is cycled


def retrieve(store: GraphStore, question: str, decision: str, scope: tuple[str, ...] = (), top_k: int = 20, context: int = 10) -> dict[str, DataFrame]:
    """Claims in order (vector hits, then text hits), what hangs on the first of them, and paragraphs.

    ``decision`` is the gate's.  The first five claims give evidence and limitations, the first ten limitations
    once more; where that is fewer than two results, paragraphs around text hits stand in.
    """
    inside = (lambda d: d.where(F.col("graph_id").isin(*scope))) if scope else (lambda d: d)
    claims = inside(store.nodes.where("node_type = 'claim'"))
    parts = []
    if decision in ("vector", "full"):
        far = store.nodes.where("node_type = 'claim'").withColumn("distance", claim_distance(F.col("text"), question)).orderBy("distance", "node_id").limit(top_k)
        parts.append(("vector", inside(far).select("node_id", F.row_number().over(Window.orderBy("distance", "node_id")).alias("place"))))  # the scope is applied to the k nearest
    if decision in ("fts_only", "full"):
        hits = text_search(claims, question, ["text"], top_k, ["node_id"])
        parts.append(("text", hits.select("node_id", F.row_number().over(Window.orderBy("node_id")).alias("place"))))
    found = store.nodes.sparkSession.createDataFrame([], "node_id string, found_by string, place long")
    for i, (name, part) in enumerate(parts):
        found = found.unionByName(part.select("node_id", F.lit(name).alias("found_by"), (F.col("place") + i * top_k).alias("place")))
    found = found.groupBy("node_id").agg(F.min_by("found_by", "place").alias("found_by"), F.min("place").alias("place"))
    found = materialize(found.withColumn("place", F.row_number().over(Window.orderBy("place"))), "found")  # 2 x top_k rows at most
    near = lambda k: retrieval.expand_one_hop(found.where(F.col("place") <= k), store.edges)
    ids = near(5).where("relation_type = 'supports'").select(F.col("neighbor").alias("node_id")).distinct() if decision == "full" else found.select("node_id").limit(0)
    evidence = store.nodes.where("node_type = 'evidence'").join(ids, "node_id", "left_semi")
    limits = store.nodes.where("node_type = 'limitation'").join(near(10).select(F.col("neighbor").alias("node_id")).distinct(), "node_id", "left_semi")
    out = {"claims": claims.join(found, "node_id"), "evidence": evidence, "limitations": limits}
    n = sum(frame.count() for frame in (found, evidence, limits))  # bounded by top_k and their neighbours
    if decision in ("fts_only", "full") or n < FEW:
        sections = inside(store.nodes.where("node_type = 'section'"))
        seeds = text_search(sections, question, ["text"], max(3, context // 2), ["doc_id", "ord"])
        out["paragraphs"] = retrieval.context_windows(seeds.select("doc_id", "ord"), sections, 1, context)
    return out


def intent(question: str, mode: str) -> str:
    return f"{mode}:{question[:INTENT_CHARS]}"


@dataclass
class Answer:
    """A question's walk, its packet rows, what was retrieved, and how it was decided."""

    walk: Walk
    packet: DataFrame
    found: dict[str, DataFrame]
    decision: str
    mode: str
    intent: str
    concepts: list[str]


def ask(store: GraphStore, question: str, mode: str | None = None, scope: tuple[str, ...] = (), top_k: int = 20) -> Answer:
    """Routing, gate, retrieval, start nodes (concepts, then the first five claims), walk, packet."""
    spark = store.nodes.sparkSession
    one = spark.range(1).select(F.lit(0).cast("long").alias("question_id"), F.lit(question).alias("question"))
    concepts = store.concepts.where(F.col("graph_id").isin(*scope)) if scope else store.concepts
    routed = retrieval.route_concepts(one, concepts).orderBy("place").collect()  # five at most
    gate = retrieval.gate(F.lit(question), F.lit(len(routed)), F.lit(sum(r["relevance"] for r in routed)))
    decision, found_mode = one.select(gate, retrieval.mode_of(F.col("question"))).first()
    plan = replace(traversal.PRESETS[mode or found_mode], scope=scope)
    found = retrieve(store, question, decision, scope, top_k)
    starts = [f"{r['graph_id']}/{r['concept_key']}" for r in routed] + [r["node_id"] for r in found["claims"].where("place <= 5").orderBy("place").select("node_id").collect()]
    result = traversal.walk(store.nodes, store.edges, starts, plan, store.bridges if plan.bridges else None)
    return Answer(result, retrieval.packet(result, found["claims"]), found, decision, plan.mode, intent(question, plan.mode), starts[: len(routed)])


def linked_walk(sections: DataFrame, seeds: DataFrame, steps: int, edges: DataFrame | None = None) -> DataFrame:
    """Sections up to ``steps`` before and after the seeds (section_id) along their pointers, with the offset.

    A missing next pointer is replaced by the most important ``section_next`` edge.  One join a step and
    direction; the frontier is the seeds' size.
    """
    s = sections.select("section_id", "prev_id", "next_id")
    if edges is not None:
        w = Window.partitionBy("source_id").orderBy(F.desc("importance"), "target_id")
        after = edges.where("relation_type = 'section_next'").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(F.col("source_id").alias("section_id"), F.col("target_id").alias("__after"))
        s = s.join(after, "section_id", "left").withColumn("next_id", F.coalesce("next_id", "__after")).drop("__after")
    out = here = seeds.select(F.col("section_id").alias("seed"), "section_id", F.lit(0).alias("offset")).join(s.select("section_id"), "section_id", "left_semi")
    for way, pointer in ((-1, "prev_id"), (1, "next_id")):
        front = here
        for _ in range(steps):
            moved = front.join(s.select("section_id", F.col(pointer).alias("__to")), "section_id").where("__to IS NOT NULL").select("seed", F.col("__to").alias("section_id"), (F.col("offset") + way).alias("offset"))
            front = moved.join(s.select("section_id"), "section_id", "left_semi")
            out = out.unionByName(front)
    return out


# ---- queries ---------------------------------------------------------------------------------------

QUESTION = "tion x Ung 证据"
_AUDIT = traversal.PRESETS["audit"]
_CLAIMS = "SELECT node_id, node_type, confidence, importance, text FROM blocks WHERE node_type = 'claim'"
_DISTANCE = " + ".join(f"(('0x' || substr(h, {2 * i + 1}, 2))::BIGINT - ('0x' || substr(q, {2 * i + 1}, 2))::BIGINT) ** 2" for i in range(32))
_ASKED = {
    "routed": f"""SELECT graph_id || '/' || concept_key AS node_id FROM (SELECT graph_id, concept_key, relevance FROM (SELECT concept_key, graph_id, CASE WHEN contains(bare, label) THEN 0.9 WHEN contains(label, bare) THEN 0.5
      WHEN len(list_filter(aliases, lambda a: contains(bare, a) OR contains(a, bare))) > 0 THEN 0.8 END AS relevance FROM concepts, (SELECT regexp_replace('{QUESTION}', '[？?，, ]', '', 'g') AS bare) WHERE status = 'active') WHERE relevance IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY concept_key ORDER BY relevance DESC, graph_id) = 1 ORDER BY relevance DESC, concept_key LIMIT 5)""",
    "vec": f"SELECT *, row_number() OVER (ORDER BY d, node_id) AS place FROM (SELECT node_id, {_DISTANCE} AS d FROM (SELECT node_id, sha256(text) AS h, sha256('{QUESTION}') AS q FROM ({_CLAIMS})) ORDER BY d, node_id LIMIT 20)",
    "txt": f"SELECT node_id, 20 + row_number() OVER (ORDER BY node_id) AS place FROM (SELECT node_id FROM ({_CLAIMS}) WHERE contains(lower(text), 'tion') OR contains(lower(text), 'ung') OR contains(lower(text), '证据') ORDER BY node_id LIMIT 20)",
    "ranked": "SELECT node_id, row_number() OVER (ORDER BY min(place)) AS place FROM (SELECT node_id, place FROM vec UNION ALL SELECT node_id, place FROM txt) GROUP BY node_id",
    "found": f"SELECT c.*, r.place FROM ({_CLAIMS}) c JOIN ranked r USING (node_id)",
    "every": f"SELECT * FROM nodes UNION ALL SELECT graph_id || '/' || concept_key, 'concept', graph_id, NULL, NULL, NULL, label, {CONCEPT_CONFIDENCE}::DOUBLE, 0.5::DOUBLE, true FROM concepts",
}
_WALK = traversal.walk_sql(_AUDIT, "SELECT node_id, 0.0::DOUBLE AS priority FROM routed UNION ALL SELECT node_id, 0.0 FROM found WHERE place <= 5", nodes="every")
_ALL = traversal._union("a", 3, "node_id, node_type, confidence, importance, depth, rn, text")
_PACKET = f"""SELECT *, CASE WHEN node_type = 'limitation' THEN 'limitation' WHEN node_type = 'claim' AND confidence >= 0.7 AND importance >= 0.8 THEN 'anchor'
    WHEN node_type IN ('claim', 'evidence') AND confidence < 0.5 THEN 'low_confidence' WHEN node_type = 'claim' THEN 'claim' WHEN node_type = 'evidence' THEN 'evidence' END AS bucket FROM (
  SELECT node_id, node_type, confidence, importance, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY depth, rn) AS pop_order, text FROM ({_ALL})
  UNION ALL SELECT node_id, node_type, confidence, importance, NULL, NULL, text FROM found WHERE node_id NOT IN (SELECT node_id FROM ({_ALL})))"""


def _sql(body: str) -> str:
    return oracle(body, **_ASKED, **_WALK, packet=_PACKET)


def _answer(spark, sf) -> Answer:
    return ask(open_store(spark, sf), QUESTION, "audit")


@query(_sql("SELECT * FROM packet"))
def packet_flagship(spark, sf):
    return _answer(spark, sf).packet


@query(_sql("SELECT bucket, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM packet WHERE bucket IS NOT NULL GROUP BY bucket"))
def packet_buckets(spark, sf):
    return _answer(spark, sf).packet.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(_sql("SELECT true AS may_assert_claims, true AS must_cite_claims, bool_or(bucket = 'limitation') AS must_mention_limitations, bool_or(bucket = 'low_confidence') AS must_flag_low_confidence, true AS disallow_invention FROM packet"))
def packet_policy(spark, sf):
    return retrieval.generation_policy(_answer(spark, sf).packet)


@query(_sql("""SELECT string_agg(body, chr(10) ORDER BY bucket) AS packet FROM (SELECT bucket, '## ' || bucket || chr(10) || string_agg(printf('- [%.2f] ', confidence) || substr(text, 1, 80) || ' (' || node_id || ')', chr(10) ORDER BY node_id) AS body
  FROM packet WHERE bucket IS NOT NULL GROUP BY bucket)"""))
def packet_rendered(spark, sf):
    return retrieval.render(_answer(spark, sf).packet)


_HOPS = "SELECT source_id AS a, target_id AS b, relation_type FROM edges WHERE relation_type IN ('supports', 'constrains') UNION SELECT target_id, source_id, relation_type FROM edges WHERE relation_type IN ('supports', 'constrains')"


@query(oracle(f"""SELECT 'claims' AS part, node_id FROM found UNION ALL SELECT 'evidence', node_id FROM blocks WHERE node_type = 'evidence' AND node_id IN (SELECT b FROM ({_HOPS}) h JOIN found f ON f.node_id = h.a WHERE f.place <= 5 AND relation_type = 'supports')
  UNION ALL SELECT 'limitations', node_id FROM blocks WHERE node_type = 'limitation' AND node_id IN (SELECT b FROM ({_HOPS}) h JOIN found f ON f.node_id = h.a WHERE f.place <= 10)
  UNION ALL SELECT 'paragraphs', node_id FROM (SELECT DISTINCT n.node_id, n.doc_id, n.ord FROM nodes n JOIN (SELECT doc_id, ord FROM nodes WHERE node_type = 'section' AND (contains(lower(text), 'tion') OR contains(lower(text), 'ung') OR contains(lower(text), '证据')) ORDER BY doc_id, ord LIMIT 5) h
    ON n.doc_id = h.doc_id AND abs(n.ord - h.ord) <= 1 WHERE n.node_type = 'section' ORDER BY n.doc_id, n.ord LIMIT 10)""", **_ASKED))
def hybrid_retrieve(spark, sf):
    """All that a full retrieval finds for one question, by part."""
    out = None
    for name, part in retrieve(open_store(spark, sf), QUESTION, "full").items():
        one = part.select(F.lit(name).alias("part"), "node_id")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def walk_many_audit(spark, sf):
    """A walk for every document: from its first two claims, all at once."""
    store = open_store(spark, sf)
    w = Window.partitionBy("doc_id").orderBy("ord")
    starts = store.nodes.where("node_type = 'claim'").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select(F.col("doc_id").alias("question_id"), "node_id")
    return walk_many(store, starts, _AUDIT)[0].select("question_id", "node_id", "depth", "pop_order")


@query(oracle("SELECT x.section_id AS seed, y.section_id, y.ord - x.ord AS \"offset\" FROM sections x JOIN sections y ON x.doc_id = y.doc_id AND abs(x.ord - y.ord) <= 2 WHERE x.is_head"))
def linked_paragraphs(spark, sf):
    s = views.sections(spark, sf)
    return linked_walk(s, s.where("is_head").select("section_id"), 2)
