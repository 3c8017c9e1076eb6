"""Bounded best-first walks over a typed graph, as level-synchronous relational steps.

A pushed node's priority is ``100 * (depth + 1) + 10 * cost - 3 * importance - 2 * confidence``.  While no
edge costs more than 9, every entry of one depth sorts before all entries of the next, so popping from a
priority queue equals taking whole levels, each ordered by (priority, node id).  A level is: candidates
join nodes, gates, a top-k of what may still be visited, prefix sums for budget and edge caps, then a
join with the adjacency.

What crosses the driver is bounded by the plan, never by the graph: at most ``max_nodes`` accepted nodes
a level with their degrees.  The frontier goes into the scan of the edges as an IN-list, so a level reads
only what the file statistics and filters let through.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F, types as T

from grapnel.plans.views import oracle
from grapnel.registry import query

BOTH_WAYS = ("supports", "constrains", "contradicts", "refines", "extends", "supersedes", "derived_from")
SPAN_GATED = ("claim", "evidence", "limitation")
MOST_COST = 9.0
BRIDGE_COST = 5.0


@dataclass(frozen=True)
class WalkPlan:
    """Limits of one walk; every number is a bound on what is visited, never a sample."""

    mode: str
    pointers: tuple[str, ...]
    max_depth: int
    max_nodes: int
    edge_cap: int
    budget: int
    bridges: tuple[str, ...] = ()
    max_jumps: int = 0
    min_confidence: float = 0.5
    require_span: bool = True
    scope: tuple[str, ...] = ()


# The seven modes with their pointer order and limits.
PRESETS = {
    p.mode: p
    for p in (
        WalkPlan("explain", ("belongs_to", "derived_from", "supports", "constrains"), 3, 40, 15, 4000),
        WalkPlan("audit", ("supports", "constrains", "contradicts", "derived_from", "refines"), 2, 25, 10, 3000),
        WalkPlan("compare", ("derived_from", "supports", "constrains", "contradicts", "refines"), 3, 50, 20, 5000),
        WalkPlan("trace", ("belongs_to", "section_parent", "section_next"), 2, 20, 10, 2000),
        WalkPlan("conflict", ("contradicts", "constrains", "supports", "derived_from"), 3, 30, 15, 4000),
        WalkPlan("synthesis", ("derived_from", "supports", "constrains", "contradicts", "refines", "extends"), 4, 60, 25, 6000),
        WalkPlan("transfer", ("derived_from", "supports", "constrains"), 4, 40, 15, 5000, ("analogous_to", "transfers_to", "applies_to"), 3),
    )
}


def adjacency(edges: DataFrame, plan: WalkPlan) -> DataFrame:
    """(node, type, neighbor, confidence, importance, cost): outgoing edges, and incoming ones of the types
    that are walked both ways.  Self loops go; of parallel edges the first by direction, importance, cost stays."""
    kept = edges.where(F.col("relation_type").isin(*plan.pointers) & (F.col("confidence") >= plan.min_confidence) & (F.col("source_id") != F.col("target_id")))
    shape = lambda d, a, b, way: d.select(F.col(a).alias("node"), F.col("relation_type").alias("type"), F.col(b).alias("neighbor"), "confidence", "importance", "cost", "relation_id", F.lit(way).alias("way"))
    return shape(kept, "source_id", "target_id", 0).unionByName(shape(kept.where(F.col("relation_type").isin(*BOTH_WAYS)), "target_id", "source_id", 1))


def _first_parallel(adj: DataFrame) -> DataFrame:
    w = Window.partitionBy("node", "type", "neighbor").orderBy("way", F.desc("importance"), "cost", "relation_id")
    return adj.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "way")


def bridge_adjacency(bridges: DataFrame, plan: WalkPlan) -> DataFrame:
    """Outgoing active bridges of the plan's types; ``graph_id`` is the graph whose node they start from."""
    return bridges.where(F.col("bridge_type").isin(*plan.bridges) & (F.col("review_status") == "active") & (F.col("confidence") >= plan.min_confidence)).select(
        F.col("source_id").alias("node"), F.col("source_graph_id").alias("graph_id"), F.col("bridge_type").alias("type"), F.col("target_id").alias("neighbor"), "confidence", F.lit(0.5).alias("importance"), "cost"
    )


@dataclass
class Walk:
    """What a walk found: visited nodes in pop order, walked edges, and why it stopped."""

    visited: DataFrame
    edges: DataFrame
    stop: str
    n_tokens: int


def walk(nodes: DataFrame, edges: DataFrame, starts: list[str], plan: WalkPlan, bridges: DataFrame | None = None) -> Walk:
    spark = nodes.sparkSession
    gated = nodes
    if plan.scope:
        gated = gated.where(F.col("graph_id").isin(*plan.scope))
    if plan.require_span:
        gated = gated.where(~F.col("node_type").isin(*SPAN_GATED) | F.col("has_span"))
    adj = adjacency(edges, plan)
    hops = bridge_adjacency(bridges, plan) if bridges is not None and plan.bridges else None
    seen: list[tuple] = []
    walked: list[tuple] = []
    used = dict.fromkeys(plan.pointers, 0)
    tokens, jumps, stop = 0, 0, "exhausted"
    candidates: dict[str, float] = {s: 0.0 for s in starts}  # the plan's starts, then a bounded top-k
    frame = spark.createDataFrame([(k, v) for k, v in sorted(candidates.items())], "node_id string, priority double")
    for depth in range(plan.max_depth + 1):
        room = plan.max_nodes - len(seen)
        known = [n[0] for n in seen]
        fresh = frame.where(~F.col("node_id").isin(*known)) if known else frame
        # a level accepts at most `room` nodes, so the join's top-k is all that it can use
        level = gated.join(F.broadcast(fresh) if depth == 0 else fresh, "node_id").orderBy("priority", "node_id").limit(room)
        accepted, homes, over = [], [], False
        for r in level.select("node_id", "node_type", "priority", (F.length("text") / 4).cast("int").alias("tokens"), "confidence", "importance", "text", "graph_id").collect():
            if tokens >= plan.budget:
                over = True
                break
            tokens += r["tokens"]
            accepted.append(r["node_id"])
            homes.append((r["node_id"], r["graph_id"]))
            seen.append((r["node_id"], r["node_type"], depth, len(seen) + 1, r["confidence"], r["importance"], r["text"]))
        if len(seen) >= plan.max_nodes:
            stop = "max_nodes"
        elif over or tokens >= plan.budget:
            stop = "budget"
        if not accepted or depth == plan.max_depth:
            break
        near = _first_parallel(adj.where(F.col("node").isin(*accepted)))
        if hops is not None:
            own = F.broadcast(spark.createDataFrame(homes, "node string, graph_id string"))
            near = near.unionByName(hops.where(F.col("node").isin(*accepted)).join(own, ["node", "graph_id"]).drop("graph_id"), allowMissingColumns=True)
        degree = {(r["node"], r["type"]): r["n"] for r in near.groupBy("node", "type").agg(F.count("*").alias("n")).collect()}
        opened = []
        for n in accepted:
            for t in plan.pointers:
                if used[t] < plan.edge_cap and (n, t) in degree:
                    used[t] += degree[n, t]
                    opened.append((n, t))
            for t in plan.bridges:
                if jumps < plan.max_jumps and (n, t) in degree:
                    jumps += degree[n, t]
                    opened.append((n, t))
        if not opened:
            break
        pairs = F.broadcast(spark.createDataFrame(opened, "node string, type string"))  # max_nodes x pointers rows at most
        steps = near.join(pairs, ["node", "type"])
        walked.append(steps.select(F.lit(depth).alias("depth"), "node", "type", "neighbor", "confidence"))
        frame = steps.select(F.col("neighbor").alias("node_id"), ((depth + 1) * 100 + F.col("cost") * 10 - F.col("importance") * 3 - F.col("confidence") * 2).alias("priority")).groupBy("node_id").agg(F.min("priority").alias("priority"))
        if stop != "exhausted":
            break
    schema = "node_id string, node_type string, depth int, pop_order int, confidence double, importance double, text string"
    found = spark.createDataFrame(seen, schema)
    edges_schema = T.StructType.fromDDL("depth int, node string, type string, neighbor string, confidence double")
    trail = spark.createDataFrame([], edges_schema)
    for w in walked:
        trail = trail.unionByName(w)
    return Walk(found, trail, stop, tokens)


def conflicts(result: Walk) -> DataFrame:
    """Visited claims at either end of a walked ``contradicts`` edge."""
    ends = result.edges.where("type = 'contradicts'").select(F.explode(F.array("node", "neighbor")).alias("node_id")).distinct()
    return result.visited.where("node_type = 'claim'").join(ends, "node_id", "left_semi")


def summary(result: Walk) -> DataFrame:
    """One row: counts, the sum of the walked edges' confidence, the reason for stopping."""
    n = result.visited.agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))
    e = result.edges.agg(F.count("*").alias("n_edges"), F.round(F.coalesce(F.sum("confidence"), F.lit(0.0)), 2).alias("confidence_sum"))
    return n.join(e).withColumns({"stop_reason": F.lit(result.stop), "n_tokens": F.lit(result.n_tokens)})


# ---- the same walk in SQL ---------------------------------------------------------------------------

def walk_sql(plan: WalkPlan, starts: str, nodes: str = "nodes") -> dict[str, str]:
    """CTEs a0..an (accepted) and x0..xn (walked edges) of the unrolled walk; ``starts`` is a query."""
    types = ", ".join(f"'{t}'" for t in plan.pointers)
    both = ", ".join(f"'{t}'" for t in BOTH_WAYS)
    gate = "(n.node_type NOT IN ('claim', 'evidence', 'limitation') OR n.has_span)" if plan.require_span else "true"
    if plan.scope:
        gate += " AND n.graph_id IN (" + ", ".join(f"'{g}'" for g in plan.scope) + ")"
    out = {
        "adj": f"""SELECT node, type, neighbor, confidence, importance, cost FROM (SELECT *, row_number() OVER (PARTITION BY node, type, neighbor ORDER BY way, importance DESC, cost, relation_id) AS rn FROM (
          SELECT source_id AS node, relation_type AS type, target_id AS neighbor, confidence, importance, cost, relation_id, 0 AS way FROM edges WHERE relation_type IN ({types}) AND confidence >= {plan.min_confidence} AND source_id <> target_id
          UNION ALL SELECT target_id, relation_type, source_id, confidence, importance, cost, relation_id, 1 FROM edges WHERE relation_type IN ({types}) AND relation_type IN ({both}) AND confidence >= {plan.min_confidence} AND source_id <> target_id)) WHERE rn = 1""",
        "c0": starts,
    }
    for d in range(plan.max_depth + 1):
        before = " UNION ALL ".join(f"SELECT node_id FROM a{k}" for k in range(d)) or "SELECT NULL AS node_id WHERE false"
        n_before = " + ".join(f"(SELECT count(*) FROM a{k})" for k in range(d)) or "0"
        t_before = " + ".join(f"(SELECT coalesce(sum(tokens), 0) FROM a{k})" for k in range(d)) or "0"
        out[f"a{d}"] = f"""SELECT * FROM (SELECT n.node_id, n.node_type, n.confidence, n.importance, n.text, length(n.text) // 4 AS tokens, {d} AS depth,
            row_number() OVER w AS rn, coalesce(sum(length(n.text) // 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
          FROM c{d} c JOIN {nodes} n ON n.node_id = c.node_id WHERE {gate} AND c.node_id NOT IN ({before} ) WINDOW w AS (ORDER BY c.priority, c.node_id))
          WHERE rn + {n_before} <= {plan.max_nodes} AND spent + {t_before} < {plan.budget}"""
        if d < plan.max_depth:
            e_before = " + ".join(f"(SELECT count(*) FROM x{k} x WHERE x.type = g.type)" for k in range(d)) or "0"
            full = " + ".join(f"(SELECT count(*) FROM a{k})" for k in range(d + 1))
            spent = " + ".join(f"(SELECT coalesce(sum(tokens), 0) FROM a{k})" for k in range(d + 1))
            out[f"g{d}"] = f"SELECT a.rn, a.node_id, j.type, count(*) AS n FROM a{d} a JOIN adj j ON j.node = a.node_id GROUP BY ALL"
            out[f"o{d}"] = f"SELECT g.*, coalesce(sum(n) OVER (PARTITION BY type ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {e_before} AS used FROM g{d} g"
            out[f"x{d}"] = f"SELECT {d} AS depth, j.* FROM o{d} o JOIN adj j ON j.node = o.node_id AND j.type = o.type WHERE o.used < {plan.edge_cap}"
            out[f"c{d + 1}"] = f"SELECT neighbor AS node_id, min({d + 1} * 100 + cost * 10 - importance * 3 - confidence * 2) AS priority FROM x{d} WHERE {full} < {plan.max_nodes} AND {spent} < {plan.budget} GROUP BY neighbor"
    return out


def _union(prefix: str, n: int, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM {prefix}{k}" for k in range(n))


# ---- queries ---------------------------------------------------------------------------------------

#: The starts of the registered walks: claims of one graph with full confidence range, first five by id.
STARTS = "SELECT node_id, 0.0::DOUBLE AS priority FROM (SELECT node_id FROM blocks WHERE node_type = 'claim' AND graph_id = 'src1' AND confidence >= 0.6 ORDER BY node_id LIMIT 5)"


def _starts(store) -> list[str]:
    rows = store.nodes.where("node_type = 'claim' AND graph_id = 'src1' AND confidence >= 0.6").orderBy("node_id").limit(5)
    return [r["node_id"] for r in rows.select("node_id").collect()]


def _section_starts(store) -> list[str]:
    rows = store.nodes.where("node_type = 'section' AND graph_id = 'src1'").orderBy("node_id").limit(5)
    return [r["node_id"] for r in rows.select("node_id").collect()]


def _run(spark, sf, plan: WalkPlan) -> Walk:
    from grapnel.operators import answers  # which builds on walks

    store = answers.open_store(spark, sf)
    starts = _section_starts(store) if plan.mode == "trace" else _starts(store)
    return walk(store.nodes, store.edges, starts, plan, store.bridges if plan.bridges else None)


def _sql(plan: WalkPlan, body: str) -> str:
    starts = STARTS if plan.mode != "trace" else "SELECT section_id AS node_id, 0.0::DOUBLE AS priority FROM (SELECT section_id FROM sections WHERE graph_id = 'src1' ORDER BY section_id LIMIT 5)"
    return oracle(body, **walk_sql(plan, starts))


def _visited_sql(plan: WalkPlan) -> str:
    return _sql(plan, f"SELECT node_id, node_type, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY depth, rn) AS pop_order, confidence, importance FROM ({_union('a', plan.max_depth + 1, 'node_id, node_type, depth, rn, confidence, importance')})")


for _plan in PRESETS.values():
    query(_visited_sql(_plan), name=f"walk_{_plan.mode}")(lambda spark, sf, p=_plan: _run(spark, sf, p).visited.drop("text"))

_AUDIT, _EXPLAIN = PRESETS["audit"], PRESETS["explain"]


@query(_sql(_AUDIT, f"SELECT CAST(depth AS BIGINT) AS depth, node, type, neighbor, confidence FROM ({_union('x', _AUDIT.max_depth, 'depth, node, type, neighbor, confidence')})"))
def walk_audit_edges(spark, sf):
    return _run(spark, sf, _AUDIT).edges


_CONFLICT = PRESETS["conflict"]


@query(_sql(_CONFLICT, f"""SELECT DISTINCT v.node_id FROM ({_union('a', _CONFLICT.max_depth + 1, 'node_id, node_type')}) v JOIN (SELECT node, neighbor FROM ({_union('x', _CONFLICT.max_depth, 'node, neighbor, type')}) WHERE type = 'contradicts') e
  ON v.node_id = e.node OR v.node_id = e.neighbor WHERE v.node_type = 'claim'"""))
def walk_conflict_claims(spark, sf):
    return conflicts(_run(spark, sf, _CONFLICT)).select("node_id")


_SMALL = replace(_AUDIT, mode="small", max_nodes=7)


@query(_sql(_SMALL, f"""SELECT count(*) AS n_nodes, CAST(max(depth) AS BIGINT) AS depth, (SELECT count(*) FROM ({_union('x', 2, 'node')})) AS n_edges, (SELECT round(coalesce(sum(confidence), 0), 2) FROM ({_union('x', 2, 'confidence')})) AS confidence_sum,
  CASE WHEN count(*) >= 7 THEN 'max_nodes' ELSE 'exhausted' END AS stop_reason, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM ({_union('a', 3, 'depth, tokens')})"""))
def walk_stop_reason(spark, sf):
    return summary(_run(spark, sf, _SMALL))


_SCOPED = replace(_EXPLAIN, mode="scoped", scope=("src1", "src2"), require_span=False, min_confidence=0.6)


@query(_visited_sql(_SCOPED))
def walk_scoped(spark, sf):
    return _run(spark, sf, _SCOPED).visited.drop("text")
