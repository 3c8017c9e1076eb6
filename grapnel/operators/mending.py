"""Repairs of section structure, applied: score to label, label to action, six kinds of change, four modes.

Sections: (doc_id, ord, section_id, heading, level, heading_confidence, status, page_start, page_end, text).
Candidates: (doc_id, repair_type, section_id, other_id, priority), as the detectors give them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

# Labels on either side of 0.5, kinds that a model is asked about, labels of headings.
LABELS = {
    "adjacent_merge": ("merge", "keep"), "heading_role": ("not_heading", "heading"), "toc_boundary": ("toc", "not_toc"), "front_matter_boundary": ("front_matter", "body"),
    "chapter_boundary": ("jump_anomaly", "normal"), "structure_gap": ("gap_significant", "gap_minor"),
}
HIGH_IMPACT = ("toc_boundary", "chapter_boundary", "front_matter_boundary")
MODES = ("off", "dry_run", "auto_only", "full")
YES = {"adjacent_merge": ("should_merge", "merge"), "toc_boundary": ("is_toc", "mark_toc"), "front_matter_boundary": ("is_front_matter", "mark_front_matter")}


@dataclass(frozen=True)
class Thresholds:
    """From what score a repair is made, looked at, or (by a model's word) made after all."""

    auto: float = 0.85
    grey: float = 0.5
    judge: float = 0.7


def labelled(scored: DataFrame) -> DataFrame:
    """Candidates with a raw ``score`` in [0, 1]: ``label`` and ``confidence`` by kind."""
    high = F.col("score") >= 0.5
    label = F.lit("unknown")
    for kind, (yes, no) in LABELS.items():
        label = F.when(F.col("repair_type") == kind, F.when(high, yes).otherwise(no)).otherwise(label)
    known = F.col("repair_type").isin(*LABELS)
    return scored.withColumns({"label": label, "confidence": F.round(F.when(known & ~high, 1 - F.col("score")).otherwise(F.col("score")), 4), "score": F.round("score", 4)})


def judge_texts(candidates: DataFrame, sections: DataFrame) -> DataFrame:
    """What a scorer reads about each candidate: its sections' headings and beginnings, put together by kind."""
    a = sections.select("doc_id", "section_id", *(F.col(c).alias(f"a_{c}") for c in ("heading", "level", "page_start", "page_end", "text")))
    b = sections.select("doc_id", F.col("section_id").alias("other_id"), *(F.col(c).alias(f"b_{c}") for c in ("heading", "level", "page_start", "page_end", "text")))
    both = candidates.join(a, ["doc_id", "section_id"], "left").join(b, ["doc_id", "other_id"], "left")
    named = lambda s, none: F.when(F.coalesce(F.col(f"{s}_heading"), F.lit("")) == "", none).otherwise(F.col(f"{s}_heading"))
    start = lambda s, n: F.substring(f"{s}_text", 1, n)
    block = lambda s: F.concat(F.lit("["), named(s, "无标题"), F.lit("]\n"), start(s, 500))
    level = lambda s: F.concat(F.lit("层级="), F.col(f"{s}_level"), F.lit(" 标题="), named(s, "(无)"))
    pages = lambda s: F.concat(F.lit("页"), F.col(f"{s}_page_start").cast("string"), F.lit("-"), F.col(f"{s}_page_end").cast("string"), F.lit(": "), start(s, 200))
    kind = F.col("repair_type")
    document = (
        F.when(kind == "adjacent_merge", F.concat_ws("\n---\n", block("a"), block("b"))).when(kind == "heading_role", F.concat(F.lit("标签/标题: "), named("a", "(无)"), F.lit("\n正文开头: "), start("a", 300)))
        .when(kind.isin("toc_boundary", "front_matter_boundary"), F.concat(F.lit("标题: "), named("a", "(无)"), F.lit("\n内容: "), start("a", 500)))
        .when(kind == "chapter_boundary", F.concat_ws("\n→\n", level("a"), level("b"))).when(kind == "structure_gap", F.concat_ws("\n--- 缺页 ---\n", pages("a"), pages("b"))).otherwise(F.concat_ws("\n---\n", start("a", 300), start("b", 300)))
    )
    return both.select(*candidates.columns, F.coalesce(document, F.lit("")).alias("document"))


def decision_of(answers: DataFrame) -> DataFrame:
    """A model's JSON (``answer``) on candidates to ``decision`` and ``judge_confidence``; without an answer, keep at 0.3."""
    got = F.from_json("answer", "confidence double, should_merge boolean, is_toc boolean, is_front_matter boolean, action string")
    told = F.coalesce(got["action"], F.lit("keep"))
    for kind, (field, yes) in YES.items():
        told = F.when(F.col("repair_type") == kind, F.when(F.coalesce(got[field], F.lit(False)), yes).otherwise("keep")).otherwise(told)
    none = F.col("answer").isNull() | got.isNull()
    return answers.withColumns({"decision": F.when(none, "keep").otherwise(told), "judge_confidence": F.when(none, 0.3).otherwise(F.round(F.coalesce(got["confidence"], F.lit(0.5)), 4))})


def actions(labels: DataFrame, mode: str = "dry_run", limits: Thresholds = Thresholds()) -> DataFrame:
    """Labelled candidates (with ``decision`` and ``judge_confidence`` where a model was asked) with
    ``classification``, ``action`` (observed, applied, logged_only or skipped) and the label that counts."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    for column, kind in (("decision", "string"), ("judge_confidence", "double")):
        if column not in labels.columns:
            labels = labels.withColumn(column, F.lit(None).cast(kind))
    if mode in ("off", "dry_run"):
        return labels.withColumns({"classification": F.lit("observe"), "action": F.lit("logged_only"), "asked": F.lit(False)})
    graded = F.when(F.col("confidence").isNull(), "skip").when(F.col("confidence") >= limits.auto, "auto_fix").when(F.col("confidence") >= limits.grey, "grey_zone").otherwise("skip")
    told = labels.withColumn("classification", graded)
    asked = (F.col("classification") == "grey_zone") & F.col("repair_type").isin(*HIGH_IMPACT) & F.col("decision").isNotNull() & F.lit(mode == "full")
    by_model = asked & (F.col("judge_confidence") >= limits.judge)
    action = F.when((F.col("classification") == "auto_fix") | by_model, "applied").when(F.col("classification") == "grey_zone", "logged_only").otherwise("skipped")
    return told.withColumns({"asked": asked, "action": action}).withColumn("label", F.when(F.col("asked") & (F.col("action") == "applied"), F.col("decision")).otherwise(F.col("label")))


def merge_pairs(sections: DataFrame, merges: DataFrame) -> DataFrame:
    """Sections with accepted neighbour merges (section_id, other_id) made, and ``n_parts``.

    Pairs are taken in order, and a pair whose first section is gone into the one before is void: in a run
    of pairs that follow each other directly every second one counts.  Sections that aren't direct
    neighbours don't merge.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    pairs = merges.select(F.col("section_id").alias("__before"), F.col("other_id").alias("section_id"), F.lit(1).alias("__wanted")).distinct()
    s = sections.withColumn("__before", F.lag("section_id").over(w)).join(pairs, ["section_id", "__before"], "left")
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__run", F.sum(F.when(F.col("__wanted").isNull(), 1).otherwise(0)).over(until))
    s = s.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__run").orderBy("ord")) - 1)  # 0: opens the run
    s = s.withColumn("__island", F.sum(F.when(F.col("__nth") % 2 == 0, 1).otherwise(0)).over(until))
    first = lambda c: F.min_by(c, "ord").alias(c)
    bare = lambda x, i: F.regexp_replace(F.when(i > 0, F.regexp_replace(x["text"], "^\\s+", "")).otherwise(x["text"]), "\\s+$", "")
    keep = [c for c in sections.columns if c not in ("doc_id", "ord", "status", "page_end", "text")]
    out = s.groupBy("doc_id", "__island").agg(
        F.min("ord").alias("ord"), *map(first, keep), F.when(F.count("*") > 1, "reconstructed").otherwise(F.min_by("status", "ord")).alias("status"), F.max("page_end").alias("page_end"),
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("__p"), F.count("*").alias("n_parts"),
    )
    text = F.when(F.col("n_parts") == 1, F.get("__p", F.lit(0))["text"]).otherwise(F.array_join(F.transform("__p", bare), "\n\n"))
    return out.withColumn("text", text).drop("__island", "__p")


def apply(sections: DataFrame, decided: DataFrame) -> DataFrame:
    """Sections after all applied repairs: merges first, then what relabels one section each, as joins.

    A repair of a section that was merged into another is void.
    """
    use = decided.where("action = 'applied'")
    s = merge_pairs(sections, use.where("repair_type = 'adjacent_merge'"))
    mark = lambda kind, column="section_id": use.where(F.col("repair_type") == kind).groupBy(F.col(column).alias("section_id")).agg(F.first("label").alias(f"__{kind}"))
    for kind in ("heading_role", "toc_boundary", "front_matter_boundary"):
        s = s.join(mark(kind), "section_id", "left")
    s = s.join(mark("chapter_boundary", "other_id"), "section_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    has = F.coalesce(F.col("heading"), F.lit("")) != ""
    line = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80)
    demote, promote = no((F.col("__heading_role") == "not_heading") & has), no((F.col("__heading_role") == "heading") & ~has & (line != ""))
    toc, front, jump = (F.col(f"__{k}").isNotNull() for k in ("toc_boundary", "front_matter_boundary", "chapter_boundary"))
    heading = F.when(demote, "").when(promote, line).otherwise(F.coalesce("heading", F.lit("")))
    named = F.when(toc, "目录").when(front & (heading == ""), "前言").otherwise(heading)
    return s.select(
        "doc_id", "ord", "section_id", named.alias("heading"), F.when(toc | demote, "paragraph_group").when(promote, "section").otherwise(F.col("level")).alias("level"),
        F.when(jump | toc, 0.5).when(front & (heading == ""), 0.5).when(demote, 0.4).when(promote, 0.6).otherwise(F.col("heading_confidence")).alias("heading_confidence"),
        F.when(jump, "needs_review").when(toc | front | demote | promote, "reconstructed").otherwise(F.col("status")).alias("status"), "page_start", "page_end", "n_parts",
        F.when(demote, F.concat("heading", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"),
    )


def report(decided: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what was found, done and left, and the number of sections before and after."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    c, act = F.col("classification"), F.col("action")
    told = decided.agg(
        F.count("*").alias("candidates_found"), n((c == "auto_fix") & (act == "applied"), "auto_fixed"), n((c == "grey_zone") & ~F.col("asked"), "grey_zone"), n(act == "skipped", "skipped"),
        n(F.col("asked"), "llm_triggered"), n(F.col("asked") & (act == "applied"), "llm_applied"),
    )
    return told.join(before.agg(F.count("*").alias("sections_before"))).join(after.agg(F.count("*").alias("sections_after")))  # one row each


def log_entries(decided: DataFrame, before: DataFrame, after: DataFrame, phase: str) -> DataFrame:
    """An audit row a candidate: the decision with the section as it was and, if it was changed, as it is."""
    shape = F.to_json(F.struct("heading", "level", "status", F.substring("text", 1, 120).alias("text")))
    a, b = before.select("section_id", shape.alias("before_state")), after.select("section_id", shape.alias("after_state"))
    told = decided.join(a, "section_id", "left").join(b, "section_id", "left")
    return told.select(F.lit(phase).alias("phase"), "doc_id", "repair_type", "section_id", "other_id", "priority", "classification", "action", F.col("asked").alias("llm_triggered"), "before_state", F.when(F.col("action") == "applied", F.col("after_state")).alias("after_state"))


def repaired(sections: DataFrame, candidates: DataFrame, score: Column | None = None, mode: str = "dry_run", answers: DataFrame | None = None, limits: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """(sections, decided candidates) of one run.  ``score`` is the scorer as a column over the candidates' ``document``;
    ``answers`` (doc_id, repair_type, section_id, answer) is what a model said about the grey ones."""
    if mode in ("off", "dry_run"):
        return sections, actions(labelled(candidates.withColumn("score", F.lit(None).cast("double"))), mode)
    scored = judge_texts(candidates, sections).withColumn("score", score if score is not None else F.lit(None).cast("double")).drop("document")
    told = labelled(scored)
    if answers is not None:
        told = decision_of(told.join(answers, ["doc_id", "repair_type", "section_id"], "left"))
        told = told.withColumns({c: F.when(F.col("answer").isNotNull(), F.col(c)) for c in ("decision", "judge_confidence")}).drop("answer")
    decided = actions(told, mode, limits)
    return apply(sections, decided), decided
