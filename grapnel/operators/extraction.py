"""Extraction: eligibility, pluggable models, tolerant parsing, enum coercion, linking, normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from grapnel.functions import text as tx
from grapnel.operators.concepts import CLAIM_TYPES
from grapnel.operators.linkage import clean_terms, slug
from grapnel.plans import views
from grapnel.plans.views import oracle
from grapnel.registry import query

MIN_SECTION = 150
PROMPT_CHARS = 2000
ANSWER_SCHEMA = "claims array<struct<text:string,type:string,confidence:double,terms:array<string>>>, limitations array<struct<text:string,severity:string>>"


# ---- operators -------------------------------------------------------------------------------------

def eligible(sections: DataFrame, reserved: Column | None = None) -> DataFrame:
    """Sections worth a call: 150 characters or more, not under a reserved heading."""
    long = F.length("text") >= MIN_SECTION
    return sections.where(long if reserved is None else long & ~reserved)


def ask_model(sections: DataFrame, model: Callable[[list[str]], list[str]], prompt_chars: int = PROMPT_CHARS, attempts: int = 3) -> DataFrame:
    """One call a section through a pluggable ``list[prompt] -> list[answer]``, in Arrow batches.

    A failed batch is tried again; after the last attempt its answers are null, never an error.
    """
    schema = "section_id string, answer string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = None
            for _ in range(attempts):
                try:
                    answers = model(batch["prompt"].tolist())
                    break
                except (ConnectionError, TimeoutError):
                    continue
            yield pd.DataFrame({"section_id": batch["section_id"], "answer": answers if answers is not None else [None] * len(batch)})

    return sections.select("section_id", F.substring("text", 1, prompt_chars).alias("prompt")).mapInPandas(run, schema)


def parse_answers(answers: DataFrame) -> DataFrame:
    """Claims of each answer: tolerant JSON, enum defaults, confidence clamped to [0, 1] with default 0.5."""
    got = answers.withColumn("a", F.from_json(tx.json_payload(F.col("answer")), ANSWER_SCHEMA))
    c = got.select("section_id", F.posexplode("a.claims").alias("i", "c")).where(F.length(F.coalesce("c.text", F.lit(""))) > 0)
    return c.select("section_id", "i", F.col("c.text").alias("text"), tx.coerced(F.coalesce("c.type", F.lit("")), CLAIM_TYPES, CLAIM_TYPES[0]).alias("claim_type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c.confidence", F.lit(0.5)))).alias("confidence"), clean_terms(F.coalesce("c.terms", F.array())).alias("terms"))


def link_relations(blocks: DataFrame) -> DataFrame:
    """Evidence and limitations with an array of claim ids to ``supports`` and ``constrains`` edges of 0.8."""
    kind = F.when(F.col("node_type") == "evidence", "supports").otherwise("constrains")
    return blocks.select("graph_id", F.col("node_id").alias("source_id"), F.explode("claim_ids").alias("target_id"), kind.alias("relation_type"), F.lit(0.8).alias("confidence"))


def valid_pairs(pairs: DataFrame, counts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Model-given claim pairs: indices in range, not the same, of a known type."""
    return pairs.join(counts, "section_id").where((F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("a") < F.col("n")) & (F.col("b") < F.col("n")) & (F.col("a") != F.col("b")) & F.col("type").isin(*types))


def normalize_concepts(blocks: DataFrame, concepts: DataFrame) -> DataFrame:
    """Raw terms of blocks to canonical keys by label, then alias; sorted sets; unresolved terms go.

    The lookup is an equi-join on the term; the engine broadcasts the names or splits a frequent term.
    """
    flat = blocks.select("graph_id", "node_id", F.explode("terms").alias("term"))
    names = concepts.select("graph_id", F.col("label").alias("term"), "concept_key", F.lit(0).alias("how")).unionByName(concepts.select("graph_id", F.explode("aliases").alias("term"), "concept_key", F.lit(1).alias("how")))
    best = names.groupBy("graph_id", "term").agg(F.min(F.struct("how", "concept_key")).alias("m")).select("graph_id", "term", "m.concept_key")
    return flat.join(best, ["graph_id", "term"]).groupBy("graph_id", "node_id").agg(F.array_sort(F.collect_set("concept_key")).alias("concept_keys"))


def mention_edges(normalized: DataFrame) -> DataFrame:
    return normalized.select("graph_id", F.col("node_id").alias("source_id"), F.explode("concept_keys").alias("target_id"), F.lit("mentions").alias("relation_type"), F.lit(0.7).alias("confidence")).where(F.contains("target_id", F.lit(":")))


def stand_in_model(prompts: list[str]) -> list[str]:
    """A deterministic model: the first sentence is a claim, its first words are the terms."""
    import json

    return ["```json\n" + json.dumps({"claims": [{"text": p.split(".")[0][:60], "type": ("EMPIRICAL", "nonsense")[len(p) % 2], "confidence": len(p) % 150 / 100, "terms": ["tag: " + w for w in p.split()[:2]] * 2}]}) + "\n```" for p in prompts]


# ---- queries ---------------------------------------------------------------------------------------

@query(oracle("SELECT section_id, length(text) AS n FROM sections WHERE length(text) >= 150 AND ord % 9 <> 0"))
def extraction_eligible(spark, sf):
    return eligible(views.sections(spark, sf), F.col("ord") % 9 == 0).select("section_id", F.length("text").alias("n"))


@query(oracle("""SELECT section_id, 0::BIGINT AS i, left(string_split(p, '.')[1], 60) AS text, CASE WHEN length(p) % 2 = 0 THEN 'empirical' ELSE 'theoretical' END AS claim_type, least(1.0, (length(p) % 150)::DOUBLE / 100)::DOUBLE AS confidence
 FROM (SELECT section_id, substr(text, 1, 2000) AS p FROM sections WHERE length(text) >= 150) WHERE length(left(string_split(p, '.')[1], 60)) > 0"""))
def extraction_claims(spark, sf):
    return parse_answers(ask_model(eligible(views.sections(spark, sf)), stand_in_model)).select("section_id", "i", "text", "claim_type", "confidence")


_TERMS = "SELECT graph_id, node_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS terms FROM blocks WHERE node_type = 'claim'"
_NAMES = "SELECT graph_id, term, arg_min(concept_key, (how, concept_key)) AS concept_key FROM (SELECT graph_id, label AS term, concept_key, 0 AS how FROM concepts UNION ALL SELECT graph_id, unnest(aliases), concept_key, 1 FROM concepts) GROUP BY ALL"
_NORMAL = f"SELECT t.graph_id, t.node_id, list_sort(list(DISTINCT n.concept_key)) AS ks FROM (SELECT graph_id, node_id, unnest(terms) AS term FROM ({_TERMS})) t JOIN ({_NAMES}) n USING (graph_id, term) GROUP BY ALL"


def _terms(spark, sf):
    return views.blocks(spark, sf).where("node_type = 'claim'").select("graph_id", "node_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("terms"))


@query(oracle(f"SELECT graph_id, node_id, array_to_string(ks, ',') AS concept_keys FROM ({_NORMAL})"))
def normalized_concepts(spark, sf):
    return normalize_concepts(_terms(spark, sf), views.concepts(spark, sf)).select("graph_id", "node_id", F.array_join("concept_keys", ",").alias("concept_keys"))


@query(oracle(f"SELECT graph_id, node_id AS source_id, unnest(ks) AS target_id, 'mentions' AS relation_type, 0.7::DOUBLE AS confidence FROM ({_NORMAL})"))
def mention_links(spark, sf):
    return mention_edges(normalize_concepts(_terms(spark, sf), views.concepts(spark, sf)))


@query(oracle("SELECT e.graph_id, e.node_id AS source_id, c.node_id AS target_id, CASE e.node_type WHEN 'evidence' THEN 'supports' ELSE 'constrains' END AS relation_type, 0.8::DOUBLE AS confidence FROM blocks e JOIN blocks c ON e.doc_id = c.doc_id AND c.node_type = 'claim' AND c.ord BETWEEN e.ord - 3 AND e.ord WHERE e.node_type <> 'claim'"))
def relation_links(spark, sf):
    b = views.blocks(spark, sf)
    near = b.where("node_type <> 'claim'").select("graph_id", "doc_id", "node_id", "node_type", F.explode(F.sequence(F.col("ord") - 3, F.col("ord"))).alias("ord"))
    claims = b.where("node_type = 'claim'").select("doc_id", "ord", F.col("node_id").alias("claim"))
    linked = near.join(claims, ["doc_id", "ord"]).groupBy("graph_id", "node_id", "node_type").agg(F.collect_list("claim").alias("claim_ids"))
    return link_relations(linked)


@query(oracle("""SELECT p.section_id, a, b, type FROM (SELECT section_id, ord % 5 - 1 AS a, ord % 4 AS b, ['supports', 'contradicts', 'unknown'][ord % 3 + 1] AS type, 1 + ord % 3 AS n FROM sections) p WHERE a >= 0 AND b >= 0 AND a < n AND b < n AND a <> b AND type IN ('supports', 'contradicts')"""))
def claim_pair_validation(spark, sf):
    s = views.sections(spark, sf)
    pairs = s.select("section_id", (F.col("ord") % 5 - 1).alias("a"), (F.col("ord") % 4).alias("b"), views.pick(("supports", "contradicts", "unknown"), F.col("ord") % 3).alias("type"))
    return valid_pairs(pairs, s.select("section_id", (F.col("ord") % 3 + 1).alias("n")), ("supports", "contradicts")).select("section_id", "a", "b", "type")


@query(oracle("SELECT concept_key, graph_id, CASE WHEN p <> '' THEN substr(p, 1, 25) ELSE 'c_' END AS slug FROM (SELECT concept_key, graph_id, regexp_replace(label, '[^a-z0-9]+', '_', 'g') AS p FROM concepts)"))
def concept_slugs(spark, sf):
    return views.concepts(spark, sf).select("concept_key", "graph_id", slug(F.col("label")).alias("slug"))
