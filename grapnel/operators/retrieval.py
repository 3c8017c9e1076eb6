"""Retrieval: gate, concept routing, vector and text search, expansion, context windows, the merged answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grapnel.operators import traversal
from grapnel.operators.store import text_search
from grapnel.plans import views
from grapnel.plans.views import oracle, table
from grapnel.registry import query
from grapnel.scratch import materialize

# Words that always ask for a full retrieval.
TRIGGERS = (
    "记得", "还记得", "上次", "以前", "之前", "曾经", "约定", "说过", "提到过", "你提过", "你讲过的", "那个人", "那个地方", "那个概念", "叫什么",
    "什么是", "解释一下", "如何定义", "文献中", "论文中", "框架", "模型", "证据", "限制", "冲突", "矛盾", "对比", "区别", "比较", "异同",
)
# Words that point to a mode, in the order in which ties are settled.
MODE_WORDS = {
    "explain": ("什么是", "解释", "定义", "概念", "是什么", "含义", "理解"),
    "audit": ("验证", "证据", "支撑", "可信", "可靠", "检查", "审查"),
    "compare": ("对比", "区别", "比较", "异同", "差异", "vs", "不同"),
    "trace": ("原文", "出处", "引用", "页码", "来源", "在哪里提到的"),
    "conflict": ("矛盾", "冲突", "不一致", "争议", "反对", "质疑"),
    "synthesis": ("综述", "总结", "综合", "归纳", "概述", "梳理", "整理"),
    "transfer": ("迁移", "跨领域", "类比", "应用于", "借鉴"),
}
ANCHOR_CONFIDENCE, ANCHOR_IMPORTANCE, LOW_CONFIDENCE = 0.7, 0.8, 0.5


# ---- operators -------------------------------------------------------------------------------------

def gate(question: Column, anchors: Column, confidence_sum: Column, triggers: tuple[str, ...] = TRIGGERS, shortest: int = 4) -> Column:
    """How to retrieve for a question: skip, full, vector or fts_only."""
    q = F.btrim(question)
    asked = F.exists(F.array(*map(F.lit, triggers)), lambda w: F.contains(q, w))
    return (
        F.when(F.length(q) < shortest, "skip").when(asked, "full")
        .when((anchors >= 3) & (confidence_sum / F.greatest(anchors, F.lit(1)) >= 0.7), "skip")
        .when(F.length(q) > 20, "vector").otherwise("fts_only")
    )


def mode_of(question: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The mode with the most word hits; the first of equals; ``explain`` without any hit."""
    words = words or MODE_WORDS
    hits = [F.struct(F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(F.lower(question), w))).alias("n"), F.lit(-i).alias("i"), F.lit(m).alias("m")) for i, (m, ws) in enumerate(words.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["m"]).otherwise("explain")


def route_concepts(questions: DataFrame, concepts: DataFrame, top_k: int = 5) -> DataFrame:
    """Concepts whose label or alias stands in the question (blanks and commas aside) or the other way round, best five each.

    A name that stands in a text begins with one of the text's grams: equi-joins on grams of at most three
    characters find the pairs, ``contains`` verifies them.  A question of nothing but blanks stands in every
    label; only the first five of those count, so no more are joined.
    """
    q = questions.select("question_id", F.regexp_replace("question", "[？?，, ]", "").alias("bare"))
    c = concepts.where("status = 'active'").select("concept_key", "graph_id", "label", "aliases")
    names = c.select("concept_key", "graph_id", F.col("label").alias("name"), F.lit(True).alias("is_label")).unionByName(c.select("concept_key", "graph_id", F.explode("aliases").alias("name"), F.lit(False).alias("is_label"))).where("name <> ''")
    grams = lambda t: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.array(*(F.substr(t, i, F.lit(k)) for k in (1, 2, 3))))))
    head = lambda t: F.substring(t, 1, 3)
    asked = q.where("bare <> ''")
    inside = asked.withColumn("gram", F.explode(grams(F.col("bare")))).join(names.withColumn("gram", head("name")), "gram").where(F.contains("bare", F.col("name"))).withColumn("score", F.when(F.col("is_label"), 0.9).otherwise(0.8))
    around = asked.withColumn("gram", head("bare")).join(names.withColumn("gram", F.explode(grams(F.col("name")))), "gram").where(F.contains("name", F.col("bare"))).withColumn("score", F.when(F.col("is_label"), 0.5).otherwise(0.8))
    # a label's own verdict comes before that of its aliases, whatever their scores
    pick = ["question_id", "concept_key", "graph_id"]
    best = inside.select(*pick, "is_label", "score").unionByName(around.select(*pick, "is_label", "score")).groupBy(*pick).agg(F.max(F.struct("is_label", "score"))["score"].alias("relevance"))
    some = c.groupBy("concept_key").agg(F.min("graph_id").alias("graph_id")).orderBy("concept_key").limit(top_k)
    blank = q.where("bare = ''").select("question_id").join(F.broadcast(some)).select(*pick, F.lit(0.5).alias("relevance"))  # top_k rows
    first = Window.partitionBy("question_id", "concept_key").orderBy(F.desc("relevance"), "graph_id")
    top = Window.partitionBy("question_id").orderBy(F.desc("relevance"), "concept_key")
    return best.unionByName(blank).withColumn("rn", F.row_number().over(first)).where("rn = 1").withColumn("place", F.row_number().over(top)).where(F.col("place") <= top_k).select("question_id", "concept_key", "graph_id", "relevance", "place")


def nearest(vectors: DataFrame, target: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows by squared Euclidean distance: one pass, a top-k in each task."""
    probe = F.array(*(F.lit(float(x)) for x in target))
    d = F.aggregate(F.zip_with(vector, probe, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.withColumn("distance", d).orderBy("distance", key).limit(k)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding: SHA-256 bytes, cycled and scaled to [-1, 1]."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, 2), 16, 10).cast("double")
    return F.array(*(byte(i) / 127.5 - 1 for i in range(dim)))


def expand_one_hop(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours over ``supports`` and ``constrains`` in either direction: (node_id, neighbor, type)."""
    e = edges.where(F.col("relation_type").isin("supports", "constrains"))
    both = e.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbor"), "relation_type").unionByName(e.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbor"), "relation_type"))
    return found.select("node_id").distinct().join(both, "node_id").distinct()


def inject_limitations(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Limitations next to what was found."""
    near = expand_one_hop(found, edges).select(F.col("neighbor").alias("node_id")).distinct()
    return nodes.where("node_type = 'limitation'").join(near, "node_id", "left_semi")


def context_windows(hits: DataFrame, sections: DataFrame, radius: int, limit: int) -> DataFrame:
    """The sections up to ``radius`` places around the hits, each once, in document order."""
    around = hits.select("doc_id", F.explode(F.sequence(F.col("ord") - radius, F.col("ord") + radius)).alias("ord")).distinct()
    return sections.join(around, ["doc_id", "ord"]).orderBy("doc_id", "ord").limit(limit)


def packet_bucket() -> Column:
    """Where a visited node goes in the packet."""
    claim, low = F.col("node_type") == "claim", F.col("confidence") < LOW_CONFIDENCE
    return (
        F.when(F.col("node_type") == "limitation", "limitation")
        .when(claim & (F.col("confidence") >= ANCHOR_CONFIDENCE) & (F.col("importance") >= ANCHOR_IMPORTANCE), "anchor")
        .when((claim | (F.col("node_type") == "evidence")) & low, "low_confidence")
        .when(claim, "claim").when(F.col("node_type") == "evidence", "evidence")
    )


def packet(result: traversal.Walk, retrieved: DataFrame) -> DataFrame:
    """Visited nodes and the retrieved claims that were not visited, each in its bucket."""
    seen = result.visited.select("node_id", "node_type", "confidence", "importance", "depth", "pop_order", "text")
    more = retrieved.join(seen.select("node_id"), "node_id", "left_anti").select("node_id", "node_type", "confidence", "importance", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("pop_order"), "text")
    return seen.unionByName(more).withColumn("bucket", packet_bucket())


def generation_policy(rows: DataFrame) -> DataFrame:
    """One row of flags that a writer has to respect."""
    has = lambda b: F.coalesce(F.bool_or(F.col("bucket") == b), F.lit(False))
    return rows.agg(has("limitation").alias("must_mention_limitations"), has("low_confidence").alias("must_flag_low_confidence")).select(F.lit(True).alias("may_assert_claims"), F.lit(True).alias("must_cite_claims"), "must_mention_limitations", "must_flag_low_confidence", F.lit(True).alias("disallow_invention"))


def render(rows: DataFrame) -> DataFrame:
    """The packet as one text: a heading a bucket, its lines in order."""
    line = F.concat(F.lit("- ["), F.format_number("confidence", 2), F.lit("] "), F.substring("text", 1, 80), F.lit(" ("), F.col("node_id"), F.lit(")"))
    parts = rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return parts.select("bucket", F.concat(F.lit("## "), "bucket", F.lit("\n"), "body").alias("body")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "body"))), lambda x: x["body"]), "\n").alias("packet"))


# ---- queries ---------------------------------------------------------------------------------------

QUESTION = "tion x Ung"
_FOUND = "SELECT node_id, node_type, confidence, importance, text FROM blocks WHERE node_type = 'claim' AND (contains(lower(text), 'tion') OR contains(lower(text), 'ung')) ORDER BY node_id LIMIT 20"


_QUESTIONS = "SELECT conv_id * 1000 + turn AS question_id, CASE WHEN turn % 4 = 0 THEN left(text, 3) WHEN turn % 8 = 2 THEN text || '证据' ELSE text END AS question, conv_id % 5 AS anchors, (conv_id % 7) * 0.8::DOUBLE AS conf FROM conversations WHERE role = 'user'"


def questions(spark, sf) -> DataFrame:
    """User turns; some made short or given a trigger word so that every branch has cases."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    q = F.when(F.col("turn") % 4 == 0, F.left("text", F.lit(3))).when(F.col("turn") % 8 == 2, F.concat("text", F.lit("证据"))).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), q.alias("question"), (F.col("conv_id") % 5).alias("anchors"), ((F.col("conv_id") % 7) * F.lit(0.8)).alias("conf"))


@query(f"""SELECT question_id, CASE WHEN length(trim(question)) < 4 THEN 'skip' WHEN regexp_matches(question, '{"|".join(TRIGGERS)}') THEN 'full' WHEN anchors >= 3 AND conf / greatest(anchors, 1) >= 0.7 THEN 'skip'
  WHEN length(trim(question)) > 20 THEN 'vector' ELSE 'fts_only' END AS decision FROM ({_QUESTIONS})""")
def gate_decision(spark, sf):
    return questions(spark, sf).select("question_id", gate(F.col("question"), F.col("anchors"), F.col("conf")).alias("decision"))


def _mode_case() -> str:
    n = lambda ws: " + ".join(f"contains(lower(q), '{w}')::INT" for w in ws)
    return ", ".join(f"{{'n': {n(ws)}, 'i': {-i}, 'm': '{m}'}}" for i, (m, ws) in enumerate(MODE_WORDS.items()))


@query(f"""SELECT question_id, CASE WHEN best.n > 0 THEN best.m ELSE 'explain' END AS mode FROM (SELECT question_id, list_max([{_mode_case()}]) AS best FROM
  (SELECT question_id, question || ['对比差异', '总结', '来源', '矛盾争议vs', '迁移', ''][question_id % 6 + 1] AS q FROM ({_QUESTIONS})))""")
def mode_detection(spark, sf):
    tail = views.pick(("对比差异", "总结", "来源", "矛盾争议vs", "迁移", ""), F.col("question_id") % 6)
    return questions(spark, sf).select("question_id", mode_of(F.concat("question", tail)).alias("mode"))


@query(oracle("""SELECT question_id, concept_key, graph_id, relevance, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, concept_key) AS place FROM (
  SELECT question_id, concept_key, graph_id, relevance, row_number() OVER (PARTITION BY question_id, concept_key ORDER BY relevance DESC, graph_id) AS rn FROM (
    SELECT question_id, concept_key, graph_id, CASE WHEN contains(bare, label) THEN 0.9::DOUBLE WHEN contains(label, bare) THEN 0.5::DOUBLE WHEN len(list_filter(aliases, lambda a: contains(bare, a) OR contains(a, bare))) > 0 THEN 0.8::DOUBLE END AS relevance
    FROM qs, concepts WHERE status = 'active') WHERE relevance IS NOT NULL) WHERE rn = 1 QUALIFY place <= 5""", qs=f"SELECT question_id, regexp_replace(question, '[？?，, ]', '', 'g') AS bare FROM ({_QUESTIONS})"))
def route_questions(spark, sf):
    return route_concepts(questions(spark, sf), materialize(views.concepts(spark, sf), "concepts"))


@query("""SELECT vec_id, round(distance, 5) AS distance, CAST(label AS BIGINT) AS label FROM (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20)""")
def knn_l2(spark, sf):
    e = table(spark, sf, "embeddings")
    probe = e.where("vec_id = 7").first()["embedding"]
    return nearest(e, probe, 20).select("vec_id", F.round("distance", 5).alias("distance"), "label")


@query("""SELECT vec_id FROM (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20) WHERE label IN (1, 2, 3)""")
def knn_scope_after_limit(spark, sf):
    """Scope is applied to the k nearest, not before."""
    e = table(spark, sf, "embeddings")
    return nearest(e, e.where("vec_id = 7").first()["embedding"], 20).where(F.col("label").isin(1, 2, 3)).select("vec_id")


@query("SELECT doc_id, round(list_sum(list_transform(range(64), lambda i: (('0x' || substr(h, (i % 32) * 2 + 1, 2))::BIGINT)::DOUBLE / 127.5 - 1)), 6) AS total FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def hash_embeddings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", hash_embedding(F.col("text")).alias("v"))
    return d.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_HITS = "SELECT * FROM sections WHERE contains(lower(text), 'tion') OR contains(lower(text), 'ung') ORDER BY page, section_id LIMIT 15"


def _paragraph_hits(spark, sf):
    return text_search(views.sections(spark, sf), QUESTION, ["text"], 15, ["page", "section_id"])


@query(oracle(f"SELECT section_id, page FROM ({_HITS})"))
def paragraph_hits(spark, sf):
    return _paragraph_hits(spark, sf).select("section_id", "page")


@query(oracle(f"SELECT section_id, doc_id, ord FROM (SELECT DISTINCT s.section_id, s.doc_id, s.ord FROM ({_HITS}) h JOIN sections s ON s.doc_id = h.doc_id AND abs(s.ord - h.ord) <= 1) ORDER BY doc_id, ord LIMIT 12"))
def context_paragraphs(spark, sf):
    return context_windows(_paragraph_hits(spark, sf), views.sections(spark, sf), 1, 12).select("section_id", "doc_id", "ord")


_NEAR = "SELECT source_id AS node_id, target_id AS neighbor, relation_type FROM edges WHERE relation_type IN ('supports', 'constrains') UNION SELECT target_id, source_id, relation_type FROM edges WHERE relation_type IN ('supports', 'constrains')"


@query(oracle(f"SELECT DISTINCT n.* FROM ({_NEAR}) n JOIN ({_FOUND}) f USING (node_id)"))
def one_hop_expansion(spark, sf):
    found = text_search(views.blocks(spark, sf).where("node_type = 'claim'"), QUESTION, ["text"], 20, ["node_id"])
    return expand_one_hop(found, views.edges(spark, sf)).select("node_id", "neighbor", "relation_type")


@query(oracle(f"SELECT node_id, confidence FROM nodes WHERE node_type = 'limitation' AND node_id IN (SELECT neighbor FROM ({_NEAR}) n JOIN ({_FOUND}) f USING (node_id))"))
def inject_limits(spark, sf):
    found = text_search(views.blocks(spark, sf).where("node_type = 'claim'"), QUESTION, ["text"], 20, ["node_id"])
    return inject_limitations(found, views.edges(spark, sf), views.nodes(spark, sf)).select("node_id", "confidence")
