"""Structural repair: candidates by rule, score policy, application; review decisions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grapnel.functions import text as tx
from grapnel.operators import mending
from grapnel.plans import views
from grapnel.plans.views import oracle
from grapnel.registry import query

AUTO, GREY = 0.85, 0.5
MIN_PRIORITY = 0.3
LEVELS = ("title", "chapter", "section", "subsection", "subsubsection", "paragraph_group")


# ---- operators -------------------------------------------------------------------------------------

def _next(column: str) -> Column:
    return F.lead(column).over(Window.partitionBy("doc_id").orderBy("ord"))


def merge_candidates(s: DataFrame) -> DataFrame:
    """Neighbours that may be one split paragraph: an additive score over a row and its next."""
    b = s.withColumns({"next_id": _next("section_id"), "next_text": _next("text"), "next_path": _next("path"), "next_level": _next("level")}).where("next_id IS NOT NULL")
    first = F.substring("next_text", 1, 1)
    score = (
        F.when(~F.substring("text", -20, 20).rlike(tx.SENTENCE_END), 30).otherwise(0) + F.when((F.upper(first) != first) | ~first.rlike("[\\p{Lu}0-9]"), 20).otherwise(0) + F.when(F.length("text") < 100, 30).otherwise(0)
        + F.when((F.col("path") == F.col("next_path")) & (F.col("path") != ""), 20).otherwise(0) + F.when(F.col("next_level") == "paragraph_group", 10).otherwise(0)
    )
    return b.withColumn("priority", F.least(score, F.lit(100)) / 100).where("priority >= 0.4").select(F.lit("adjacent_merge").alias("repair_type"), "section_id", F.col("next_id").alias("other_id"), "priority")


def level_jumps(s: DataFrame) -> DataFrame:
    """Heading levels that skip one or more: both deep levels aside."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col(c)) - 1, F.lit(5))
    b = s.withColumns({"next_id": _next("section_id"), "next_level": _next("level")}).where("next_id IS NOT NULL").withColumns({"a": rank("level"), "b": rank("next_level")})
    return b.where("NOT (a >= 4 AND b >= 4) AND b - a > 1").select(F.lit("chapter_boundary").alias("repair_type"), "section_id", F.col("next_id").alias("other_id"), F.lit(0.7).alias("priority"))


def page_gaps(s: DataFrame) -> DataFrame:
    b = s.withColumns({"next_id": _next("section_id"), "next_page": _next("page")}).where("next_page - page > 2")
    return b.select(F.lit("structure_gap").alias("repair_type"), "section_id", F.col("next_id").alias("other_id"), F.lit(0.4).alias("priority"))


def toc_residuals(s: DataFrame) -> DataFrame:
    """Dot leaders near a document's start."""
    n = F.regexp_count("text", F.lit(r"[…]{2,}|\.{4,}"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    b = s.withColumns({"n": n, "place": place}).where("place < 10 AND (n >= 3 OR (n >= 1 AND place <= 3))")
    return b.select(F.lit("toc_boundary").alias("repair_type"), "section_id", F.lit(None).cast("string").alias("other_id"), F.when(F.col("n") >= 3, 0.8).otherwise(0.5).alias("priority"))


def front_matter(s: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    b = s.withColumn("place", place).where((F.col("place") < 5) & F.concat_ws(" ", "path", F.substring("text", 1, 200)).rlike("前言|编写说明|序言|Preface|Foreword|Introduction to"))
    return b.select(F.lit("front_matter_boundary").alias("repair_type"), "section_id", F.lit(None).cast("string").alias("other_id"), F.lit(0.3).alias("priority"))


def heading_suspects(s: DataFrame) -> DataFrame:
    """Headings over 80 characters, and chapter-like first lines that aren't headings."""
    long = s.where(F.length("path") > 80).select(F.lit("heading_role").alias("repair_type"), "section_id", F.lit(None).cast("string").alias("other_id"), F.lit(0.5).alias("priority"))
    missed = s.where((F.col("level") == "paragraph_group") & F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80).rlike(r"(?i)^(Chapter|Part|Section)[ \t]+[0-9]+|^第[ \t]*[一二三四五六七八九十0-9]+[ \t]*[章节篇部]"))
    return long.unionByName(missed.select(F.lit("heading_role").alias("repair_type"), "section_id", F.lit(None).cast("string").alias("other_id"), F.lit(0.4).alias("priority")))


def all_candidates(s: DataFrame, least: float = MIN_PRIORITY) -> DataFrame:
    out = merge_candidates(s)
    for rule in (heading_suspects, toc_residuals, front_matter, level_jumps, page_gaps):
        out = out.unionByName(rule(s))
    return out.where(F.col("priority") >= least)


def page_numbers(s: DataFrame) -> DataFrame:
    """Leading numbers of a document's sections (doc_id, number): how often, their first context, whether they are page numbers.

    Numbers before words of date, count, part or measure never are.
    """
    t = tx.trimmed(F.col("text"))
    found = s.select("doc_id", "ord", t.alias("t"), F.regexp_extract(t, r"^([0-9]{1,4})[ \t]+", 1).alias("number")).where("number <> ''")
    kept = found.where(~F.col("t").rlike(rf"^[0-9]{{1,4}}[ \t]+({tx.NEVER_STRIP})"))
    seen = kept.groupBy("doc_id", "number").agg(F.count("*").alias("n"), F.min_by(F.substring("t", 1, 55), "ord").alias("context"))
    return seen.withColumn("is_page", F.col("context").rlike(tx.LEADING_PAGES[3]))


def without_page_numbers(s: DataFrame, numbers: DataFrame) -> DataFrame:
    """Sections without the leading numbers that are page numbers of their document."""
    t = tx.trimmed(F.col("text"))
    n = F.regexp_extract(t, r"^([0-9]{1,4})[ \t]", 1)
    keyed = s.withColumn("number", n).join(numbers.where("is_page").select("doc_id", "number", F.lit(True).alias("__page")), ["doc_id", "number"], "left")
    return keyed.withColumn("text", F.when(F.col("__page"), tx.trimmed(F.expr("substring(trim(text), length(number) + 1)"))).otherwise(t)).drop("number", "__page")


def policy_action(score: Column, high_impact: Column) -> Column:
    """What a score leads to: auto, grey (a model decides if much depends on it), or skip."""
    return F.when(score >= AUTO, "auto").when(score >= GREY, F.when(high_impact, "judge").otherwise("grey")).otherwise("skip")


def log_summary(log: DataFrame) -> DataFrame:
    """Counts by type, class and action in one pass."""
    return log.groupingSets([["repair_type"], ["action"], ["priority_class"], []], "repair_type", "action", "priority_class").agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def decide(items: DataFrame, decision: Column) -> DataFrame:
    """A review decision and what it does to the item: status and, for downgrades, confidence."""
    d = items.withColumn("decision", decision)
    status = F.when(F.col("decision") == "approve", "active").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "downgrade", "candidate").when(F.col("decision") == "mark_as_conflict", "disputed").otherwise("pending")
    return d.withColumn("status", status).withColumn("confidence", F.when(F.col("decision") == "downgrade", F.round(F.col("confidence") * 0.5, 6)).otherwise(F.col("confidence")))


def rollback(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Pending items of a rolled-back run are rejected; resolved ones stay."""
    gone = runs.where("status = 'rolled_back'").select("run_id", F.lit(True).alias("gone"))
    return items.join(gone, "run_id", "left").withColumn("decision", F.when(F.col("gone") & (F.col("decision") == "pending"), "reject").otherwise(F.col("decision"))).drop("gone")


# ---- queries ---------------------------------------------------------------------------------------

_SHAPED = """SELECT section_id, doc_id, ord, CASE WHEN ord % 9 = 1 THEN text || ' .... 12 ..... 3 ...... 4' WHEN ord % 13 = 2 THEN 'Preface ' || text WHEN ord % 17 = 5 THEN 'Chapter 12 ' || text ELSE text END AS text, page + CASE WHEN ord > 6 THEN 4 ELSE 0 END AS page,
  CASE WHEN ord % 19 = 0 THEN repeat('long heading ', 8) ELSE 'chapter ' || chapter END AS path, CASE WHEN is_head THEN 'chapter' WHEN ord % 4 = 0 THEN 'subsection' ELSE 'paragraph_group' END AS level FROM sections"""


def shaped(spark, sf) -> DataFrame:
    """Sections dressed with the defects to find."""
    s, o = views.sections(spark, sf), F.col("ord")
    text = F.when(o % 9 == 1, F.concat("text", F.lit(" .... 12 ..... 3 ...... 4"))).when(o % 13 == 2, F.concat(F.lit("Preface "), "text")).when(o % 17 == 5, F.concat(F.lit("Chapter 12 "), "text")).otherwise(F.col("text"))
    return s.select("section_id", "doc_id", "ord", text.alias("text"), (F.col("page") + F.when(o > 6, 4).otherwise(0)).alias("page"), F.when(o % 19 == 0, F.repeat(F.lit("long heading "), F.lit(8))).otherwise(F.concat(F.lit("chapter "), "chapter")).alias("path"),
                    F.when(F.col("is_head"), "chapter").when(o % 4 == 0, "subsection").otherwise("paragraph_group").alias("level"))


_MERGES = """SELECT 'adjacent_merge' AS repair_type, section_id, other_id, priority FROM (SELECT section_id, other_id, CAST(least(CASE WHEN NOT regexp_matches(right(text, 20), '[。！？.!?」】)）]$') THEN 30 ELSE 0 END + CASE WHEN NOT regexp_matches(left(nt, 1), '[\\p{Lu}0-9]') THEN 20 ELSE 0 END
  + CASE WHEN length(text) < 100 THEN 30 ELSE 0 END + CASE WHEN path = np AND path <> '' THEN 20 ELSE 0 END + CASE WHEN nl = 'paragraph_group' THEN 10 ELSE 0 END, 100) AS DOUBLE) / 100 AS priority
  FROM (SELECT *, lead(section_id) OVER w AS other_id, lead(text) OVER w AS nt, lead(path) OVER w AS np, lead(level) OVER w AS nl FROM shaped WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE other_id IS NOT NULL) WHERE priority >= 0.4"""
_JUMPS = """SELECT 'chapter_boundary' AS repair_type, section_id, other_id, 0.7::DOUBLE AS priority FROM (SELECT section_id, other_id, list_position(['title', 'chapter', 'section', 'subsection', 'subsubsection', 'paragraph_group'], level) AS a, list_position(['title', 'chapter', 'section', 'subsection', 'subsubsection', 'paragraph_group'], nl) AS b
  FROM (SELECT *, lead(section_id) OVER w AS other_id, lead(level) OVER w AS nl FROM shaped WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE other_id IS NOT NULL) WHERE NOT (a >= 5 AND b >= 5) AND b - a > 1"""
_GAPS = "SELECT 'structure_gap' AS repair_type, section_id, other_id, 0.4::DOUBLE AS priority FROM (SELECT *, lead(section_id) OVER w AS other_id, lead(page) OVER w AS np FROM shaped WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE np - page > 2"
_TOC = "SELECT 'toc_boundary' AS repair_type, section_id, NULL::VARCHAR AS other_id, CASE WHEN n >= 3 THEN 0.8 ELSE 0.5 END::DOUBLE AS priority FROM (SELECT *, len(regexp_extract_all(text, '[…]{2,}|\\.{4,}')) AS n FROM shaped) WHERE ord <= 10 AND (n >= 3 OR (n >= 1 AND ord <= 4))"
_FRONT = "SELECT 'front_matter_boundary' AS repair_type, section_id, NULL::VARCHAR AS other_id, 0.3::DOUBLE AS priority FROM shaped WHERE ord <= 5 AND regexp_matches(path || ' ' || left(text, 200), 'Preface|Foreword|Introduction to')"
_HEADS = "SELECT 'heading_role' AS repair_type, section_id, NULL::VARCHAR AS other_id, 0.5::DOUBLE AS priority FROM shaped WHERE length(path) > 80 UNION ALL SELECT 'heading_role', section_id, NULL, 0.4::DOUBLE FROM shaped WHERE level = 'paragraph_group' AND regexp_matches(left(text, 80), '(?i)^(Chapter|Part|Section)[ \\t]+[0-9]+')"
_EVERY = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_MERGES, _JUMPS, _GAPS, _TOC, _FRONT, _HEADS))


for _name, _sql, _rule in (("merge_candidates", _MERGES, merge_candidates), ("level_jumps", _JUMPS, level_jumps), ("page_gaps", _GAPS, page_gaps), ("toc_residuals", _TOC, toc_residuals), ("front_matter", _FRONT, front_matter), ("heading_suspects", _HEADS, heading_suspects)):
    query(oracle(f"SELECT * FROM ({_sql})", shaped=_SHAPED), name=f"repair_{_name}")(lambda spark, sf, rule=_rule: rule(shaped(spark, sf)))


@query(oracle(f"SELECT repair_type, count(*) AS n, round(avg(priority), 6) AS mean_priority FROM ({_EVERY}) WHERE priority >= 0.4 GROUP BY 1", shaped=_SHAPED))
def repair_all(spark, sf):
    return all_candidates(shaped(spark, sf), 0.4).groupBy("repair_type").agg(F.count("*").alias("n"), F.round(F.avg("priority"), 6).alias("mean_priority"))


_SCORED = f"SELECT *, CASE WHEN priority >= 0.85 THEN 'auto' WHEN priority >= 0.5 THEN CASE WHEN repair_type = 'chapter_boundary' THEN 'judge' ELSE 'grey' END ELSE 'skip' END AS action, CASE WHEN priority >= 0.7 THEN 'high' ELSE 'low' END AS priority_class FROM ({_EVERY})"


def _scored(spark, sf):
    return all_candidates(shaped(spark, sf)).withColumn("action", policy_action(F.col("priority"), F.col("repair_type") == "chapter_boundary")).withColumn("priority_class", F.when(F.col("priority") >= 0.7, "high").otherwise("low"))


@query(oracle(f"SELECT repair_type, section_id, other_id, action FROM ({_SCORED})", shaped=_SHAPED))
def repair_policy(spark, sf):
    return _scored(spark, sf).select("repair_type", "section_id", "other_id", "action")


@query(oracle(f"SELECT repair_type, action, priority_class, count(*) AS n FROM ({_SCORED}) GROUP BY GROUPING SETS ((repair_type), (action), (priority_class), ())", shaped=_SHAPED))
def repair_log_summary(spark, sf):
    return log_summary(_scored(spark, sf)).drop("grouping")


_WANTED = f"SELECT *, section_id IN (SELECT other_id FROM ({_MERGES}) WHERE priority >= 0.8) AS wanted FROM shaped"
_RUNS = f"SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) - 1 AS nth FROM (SELECT *, count(*) FILTER (NOT wanted) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM ({_WANTED}))"


@query(oracle(f"""SELECT doc_id, min_by(section_id, ord) AS section_id, count(*) AS n_parts, CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY ord) END AS text
  FROM (SELECT *, count(*) FILTER (nth % 2 = 0) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM ({_RUNS})) GROUP BY doc_id, island""", shaped=_SHAPED))
def repair_applied(spark, sf):
    s = shaped(spark, sf).withColumns({"status": F.lit("clean"), "page_end": F.col("page")})
    return mending.merge_pairs(s, merge_candidates(s).where("priority >= 0.8")).select("doc_id", "section_id", "n_parts", "text")


_ITEMS = "SELECT node_id AS item_id, graph_id, confidence, 'run-' || doc_id % 9 AS run_id, CASE WHEN ord % 3 = 0 THEN 'approve' ELSE 'pending' END AS decision, ord FROM blocks WHERE confidence < 0.5"


def items(spark, sf) -> DataFrame:
    return views.blocks(spark, sf).where("confidence < 0.5").select(F.col("node_id").alias("item_id"), "graph_id", "confidence", F.concat(F.lit("run-"), (F.col("doc_id") % 9).cast("string")).alias("run_id"), F.when(F.col("ord") % 3 == 0, "approve").otherwise("pending").alias("decision"), "ord")


@query(oracle(f"""SELECT item_id, decision, CASE decision WHEN 'approve' THEN 'active' WHEN 'reject' THEN 'rejected' WHEN 'downgrade' THEN 'candidate' WHEN 'mark_as_conflict' THEN 'disputed' ELSE 'pending' END AS status, CASE WHEN decision = 'downgrade' THEN round(confidence * 0.5, 6) ELSE confidence END AS confidence
  FROM (SELECT item_id, confidence, ['approve', 'reject', 'downgrade', 'mark_as_conflict', 'pending'][ord % 5 + 1] AS decision FROM ({_ITEMS}))"""))
def review_decisions(spark, sf):
    return decide(items(spark, sf), views.pick(("approve", "reject", "downgrade", "mark_as_conflict", "pending"), F.col("ord") % 5)).select("item_id", "decision", "status", "confidence")


@query(oracle(f"SELECT item_id, CASE WHEN run_id IN ('run-2', 'run-5') AND decision = 'pending' THEN 'reject' ELSE decision END AS decision FROM ({_ITEMS})"))
def review_rollback(spark, sf):
    runs = spark.range(9).select(F.concat(F.lit("run-"), "id").alias("run_id"), F.when(F.col("id").isin(2, 5), "rolled_back").otherwise("completed").alias("status"))
    return rollback(items(spark, sf), runs).select("item_id", "decision")


@query(oracle(f"SELECT run_id, count(*) AS items_produced, count(*) FILTER (decision = 'approve') AS items_accepted, count(*) FILTER (decision = 'pending') AS items_pending, round(min(confidence), 6) AS least_confidence FROM ({_ITEMS}) GROUP BY run_id"))
def run_status(spark, sf):
    return items(spark, sf).groupBy("run_id").agg(F.count("*").alias("items_produced"), F.count_if(F.col("decision") == "approve").alias("items_accepted"), F.count_if(F.col("decision") == "pending").alias("items_pending"), F.round(F.min("confidence"), 6).alias("least_confidence"))
