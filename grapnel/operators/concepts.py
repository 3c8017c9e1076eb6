"""Concepts: cleaning and keys, registration in order, lookup, status changes, conflicts, review items; what models answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grapnel.functions import text as tx

# Term lists, limits and enum values; defaults stand first.
GENERIC = ("教育", "教学", "学生", "教师", "学习", "研究", "问题", "方法", "技术", "框架", "模型", "实践", "应用", "影响", "作用", "能力", "课程")
GENERIC_SHORT = ("教育", "教学", "学生", "教师", "学习", "研究", "实践", "问题", "方法", "技术")
SENTENCE_MARKS = ("。", "；", "，", "认为", "提出", "表明", "必须", "可以", "应该")
EDGE_MARKS = "：:，,。.;；、"
KNOWN_SLUGS = {
    "认知负荷": "cognitive_load", "人机共创": "human_ai_cocreation", "AI幻觉": "AI_hallucination", "大模型幻觉": "LLM_hallucination", "思维外包": "cognitive_outsourcing", "数据隐私": "data_privacy", "虚拟实验": "virtual_lab",
    "提示工程": "prompt_engineering", "陶行知生活教育思想": "Tao_Xingzhi_life_education", "生活教育思想": "Tao_Xingzhi_life_education", "学术诚信": "academic_integrity", "算法偏见": "algorithmic_bias",
}
CLAIM_TYPES = ("theoretical", "definitional", "empirical", "methodological", "normative", "critical", "synthesis", "framework")
IMPORTANCES = ("supporting", "core", "peripheral")
EVIDENCE_TYPES = ("other", "case", "data", "experiment", "teaching_practice", "survey", "theoretical_reference", "policy_reference", "chapter_argument", "literature_citation")
STRENGTHS = ("unassessed", "strong", "moderate", "weak")
RISKS = ("other", "scope", "method", "data", "ethics", "implementation", "theoretical", "unexplored", "conflict")
SEVERITIES = ("unassessed", "critical", "moderate", "minor")
RESEARCH_TYPES = ("other", "theoretical", "empirical", "case_study", "review", "practice_report", "policy", "textbook_chapter")
NAMESPACES = ("concept", "framework", "method", "problem", "theory", "tool", "metric")
CARD_CHARS, CARD = 3000, "title string, authors array<string>, year int, abstract string, keywords array<string>, research_type string, main_framework string"
ANSWER = "c array<struct<text:string,type:string,importance:string,confidence:double,terms:array<string>>>, e array<struct<text:string,type:string,strength:string,claims:array<int>,terms:array<string>>>, l array<struct<text:string,type:string,severity:string,claims:array<int>,terms:array<string>>>"
CONCEPTS = "concepts array<struct<namespace:string,term:string,english:string,definition:string,aliases:array<string>,parent:string>>"


# ---- terms and keys --------------------------------------------------------------------------------

def _collapsed(term: Column) -> Column:
    return F.btrim(F.btrim(F.regexp_replace(term, "\\s+", " ")), F.lit(EDGE_MARKS))


def clean_term(term: Column, english: bool = False) -> Column:
    """A label fit for a key, or an empty string: no generic word, no piece of a sentence, not too long."""
    t = _collapsed(F.coalesce(term, F.lit("")))
    marked = F.exists(F.array(*map(F.lit, SENTENCE_MARKS)), lambda m: F.contains(t, m))
    long = F.size(F.split(t, " ")) > 6 if english else F.length(t) > 24
    return F.when(t.isin(*GENERIC) | marked | long, "").otherwise(t)


def clean_aliases(aliases: Column, *labels: Column) -> Column:
    """Aliases and labels, trimmed, each once in order, of 48 characters at most."""
    every = F.concat(F.coalesce(aliases, F.expr("CAST(array() AS array<string>)")), F.array(*labels))
    bare = F.transform(F.filter(every, lambda a: a.isNotNull()), _collapsed)
    return F.array_distinct(F.filter(bare, lambda a: (a != "") & (F.length(a) <= 48)))


def short_terms(terms: Column) -> Column:
    """Terms of a model's answer: generic and long ones go, what stands before a colon goes, each once."""
    bare = F.transform(F.filter(terms, lambda t: t.isNotNull()), F.btrim)
    kept = F.filter(bare, lambda t: (t != "") & ~t.isin(*GENERIC_SHORT) & (F.length(t) <= 32))
    cut = F.transform(kept, lambda t: F.when(F.contains(t, F.lit(":")), F.btrim(F.regexp_replace(t, "^[^:]*:", ""))).otherwise(t))
    return F.array_distinct(F.filter(cut, lambda t: t != ""))


def plain_slug(text: Column) -> Column:
    """Texts of CJK letters only get a hash, others lower case with underscores."""
    letters = F.regexp_replace(text, "[^\\p{L}]", "")
    return F.when(letters.rlike("^[一-鿿]*$"), F.substring(F.md5(text), 1, 8)).otherwise(F.regexp_replace(F.lower(text), "[ -]", "_"))


def ascii_slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s != "", F.substring(s, 1, 25)).otherwise(plain_slug(text))


def canonical_key(namespace: Column, term: Column, english: Column) -> Column:
    """``namespace:slug``: frameworks in capitals, known terms by their name, else by the English term, else by the term."""
    known = F.create_map(*(F.lit(x) for pair in KNOWN_SLUGS.items() for x in pair))
    framework = F.substring(F.regexp_replace(F.upper(term), "[ -]", "_"), 1, 20)
    e = F.coalesce(english, F.lit(""))
    slug = F.when(namespace == "framework", framework).when(known[term].isNotNull(), known[term]).when(e != "", ascii_slug(e)).otherwise(plain_slug(term))
    return F.concat(namespace, F.lit(":"), slug)


# ---- registry --------------------------------------------------------------------------------------

def register_in_order(new: DataFrame, known: DataFrame) -> DataFrame:
    """New concepts (seq, graph_id, concept_key, aliases, merge_policy) judged as if added one after the other.

    A key of the graph that is known or came earlier rejects; else an alias of the graph that is known or
    came earlier with a concept that was taken asks for review, as a strict policy does; else it is taken.
    Keys only count from their first bearer, so both tests are joins with what came first.  ``seq`` is unique and
    of any sortable type; what is known comes before all of it.
    """
    k = known.select("graph_id", "concept_key", F.lit(True).alias("__known")).distinct()
    first = Window.partitionBy("graph_id", "concept_key").orderBy("seq")
    told = new.withColumn("__rn", F.row_number().over(first)).join(k, ["graph_id", "concept_key"], "left")
    told = told.withColumn("__taken", F.coalesce(F.col("__known"), F.lit(False)) | (F.col("__rn") > 1))
    mine = told.select("graph_id", "seq", "concept_key", "__taken", F.explode("aliases").alias("alias"))
    held = mine.where(~F.col("__taken")).select("graph_id", "alias", "seq").unionByName(known.select("graph_id", F.explode("aliases").alias("alias"), F.lit(None).cast(new.schema["seq"].dataType).alias("seq")))
    earliest = held.groupBy("graph_id", "alias").agg(F.min("seq").alias("__first"), F.bool_or(F.col("seq").isNull()).alias("__before"))
    shares = mine.join(earliest, ["graph_id", "alias"]).where(F.col("__before") | (F.col("__first") < F.col("seq"))).select("seq").distinct().withColumn("__shares", F.lit(True))
    out = told.join(shares, "seq", "left")
    return out.withColumn("decision", F.when(F.col("__taken"), "reject_duplicate").when(F.coalesce("__shares", F.lit(False)) | (F.col("merge_policy") == "strict"), "needs_review").otherwise("accept_candidate")).drop("__rn", "__known", "__taken", "__shares")


def lookup(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(graph_id, term) to the concepts with this label, then those with this alias: (graph_id, term, concept_key, how, place)."""
    labels = concepts.select("graph_id", F.col("label").alias("term"), "concept_key", F.lit("label").alias("how"), F.lit(0).alias("rank"))
    names = labels.unionByName(concepts.select("graph_id", F.explode("aliases").alias("term"), "concept_key", F.lit("alias").alias("how"), F.lit(1).alias("rank")))
    best = names.groupBy("graph_id", "term", "concept_key").agg(F.min(F.struct("rank", "how")).alias("m"))
    w = Window.partitionBy("graph_id", "term").orderBy("m.rank", "concept_key")
    return terms.distinct().join(best, ["graph_id", "term"]).select("graph_id", "term", "concept_key", "m.how", F.row_number().over(w).alias("place"))


def resolve_blocks(blocks: DataFrame, concepts: DataFrame) -> DataFrame:
    """Blocks (block_id, graph_id, terms) to sorted canonical keys: what looks canonical stays, other terms are looked up, the rest goes."""
    flat = blocks.select("block_id", "graph_id", F.explode("terms").alias("term"))
    canonical = F.contains("term", F.lit(":")) & ~F.startswith("term", F.lit("concept_"))
    first = lookup(flat.where(~canonical).select("graph_id", "term"), concepts).where("place = 1").select("graph_id", "term", "concept_key")
    keyed = flat.join(first, ["graph_id", "term"], "left").withColumn("key", F.when(canonical, F.col("term")).otherwise(F.col("concept_key"))).where("key IS NOT NULL")
    return keyed.groupBy("block_id", "graph_id").agg(F.array_sort(F.collect_set("key")).alias("concept_keys"))


def set_status(concepts: DataFrame, changes: DataFrame) -> DataFrame:
    """Concepts with reviews applied.  ``changes``: (concept_key, graph_id, action, into) with activate, reject or merge, one a concept.

    A merged concept remembers what it went into.
    """
    c = concepts.join(changes.select("concept_key", "graph_id", "action", "into"), ["concept_key", "graph_id"], "left")
    status = F.when(F.col("action") == "activate", "active").when(F.col("action") == "reject", "rejected").when(F.col("action") == "merge", "merged").otherwise(F.col("status"))
    review = F.when(F.col("action") == "activate", "approved").when(F.col("action") == "reject", "rejected").otherwise(F.col("review_status"))
    apart = F.when(F.col("action") == "merge", F.array_union("do_not_merge_with", F.array("into"))).otherwise(F.col("do_not_merge_with"))
    return c.withColumns({"status": status, "review_status": review, "do_not_merge_with": apart}).drop("action", "into")


def conflicts(candidates: DataFrame) -> DataFrame:
    """Pairs of a graph's concepts with a common alias, but those that exclude each other: (graph_id, a, b, overlap)."""
    c = candidates.select("graph_id", "concept_key", "do_not_merge_with", F.explode(F.array_distinct("aliases")).alias("alias"))
    a, b = c.alias("a"), c.alias("b")
    hits = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.alias") == F.col("b.alias")) & (F.col("a.concept_key") < F.col("b.concept_key")))
    apart = F.array_contains("a.do_not_merge_with", F.col("b.concept_key")) | F.array_contains("b.do_not_merge_with", F.col("a.concept_key"))
    return hits.where(~apart).groupBy(F.col("a.graph_id").alias("graph_id"), F.col("a.concept_key").alias("a"), F.col("b.concept_key").alias("b")).agg(F.array_sort(F.collect_set("a.alias")).alias("overlap"))


# ---- review items ----------------------------------------------------------------------------------

def concept_items(decided: DataFrame) -> DataFrame:
    """Review items of concepts (concept_key, graph_id, namespace, label, definition, existing_key)."""
    name = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("concept_key"))
    text = F.concat(F.when(F.coalesce(F.col("definition"), F.lit("")) != "", F.concat(F.lit("Definition: "), "definition")).otherwise(""), F.when(F.col("existing_key").isNotNull(), F.concat(F.lit("\n\nPossible duplicate of: "), "existing_key")).otherwise(""))
    usual = F.array(*map(F.lit, ("approve", "edit", "merge", "reject")))
    return decided.select(
        F.concat(F.lit("inbox-"), F.substring(F.sha2(F.concat_ws("|", F.lit("concept"), "graph_id", "concept_key"), 256), 1, 16)).alias("inbox_id"), F.lit("concept").alias("inbox_type"), F.col("concept_key").alias("item_id"), F.lit("concept").alias("item_type"),
        F.concat(F.lit("["), "namespace", F.lit("] "), name).alias("title"), text.alias("description"), F.lit(0.7).alias("extraction_confidence"), F.lit("medium").alias("priority"), F.lit("pending").alias("decision"),
        F.col("existing_key").alias("merge_target_id"), "graph_id", F.when(F.col("existing_key").isNotNull(), F.concat(F.array(F.lit("merge")), usual)).otherwise(usual).alias("suggested_actions"),
    )


def conflict_items(pairs: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "a", "b")
    return pairs.select(
        F.concat(F.lit("inbox-"), F.substring(F.sha2(F.concat_ws("|", F.lit("conflict"), "graph_id", key), 256), 1, 16)).alias("inbox_id"), F.lit("conflict").alias("inbox_type"), key.alias("item_id"), F.lit("concept_conflict").alias("item_type"),
        F.concat(F.lit("Possible duplicate: "), "a", F.lit(" vs "), "b").alias("title"), F.concat(F.lit("Overlapping aliases: "), F.array_join("overlap", ", ")).alias("description"), F.lit("high").alias("priority"), F.lit("pending").alias("decision"), "graph_id",
        F.array(*map(F.lit, ("merge", "reject", "edit"))).alias("suggested_actions"),
    )


def bridge_items(bridges: DataFrame) -> DataFrame:
    """Review items of candidate bridges; those that say two concepts are one come first."""
    key = F.concat_ws("|", "graph_id_a", "concept_key_a", "bridge_type", "graph_id_b", "concept_key_b")
    return bridges.where("review_status = 'candidate'").select(
        F.concat(F.lit("inbox-"), F.substring(F.sha2(key, 256), 1, 16)).alias("inbox_id"), F.lit("bridge").alias("inbox_type"), key.alias("item_id"), F.lit("bridge").alias("item_type"), F.concat(F.lit("["), "bridge_type", F.lit("] "), "concept_key_a", F.lit(" ↔ "), "concept_key_b").alias("title"),
        F.col("confidence").alias("extraction_confidence"), F.when(F.col("bridge_type") == "same_as", "high").otherwise("medium").alias("priority"), F.lit("pending").alias("decision"), F.col("graph_id_a").alias("graph_id"),
    )


# ---- what models answer ----------------------------------------------------------------------------

def _enum(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(allowed[0])


def parse_blocks(answers: DataFrame, link_confidence: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(claims, evidence, limitations, edges) of answers (section_id, answer).

    Ids come from section and place.  Evidence and limitations name claims of their section by number;
    numbers out of range are left out.
    """
    got = answers.select("section_id", F.from_json(tx.json_payload(F.col("answer")), ANSWER).alias("a"))
    block = lambda part, letter: got.select("section_id", F.posexplode(f"a.{part}").alias("i", "b")).where(F.length(F.coalesce("b.text", F.lit(""))) > 0).withColumn("id", F.concat_ws("-", F.lit(letter), "section_id", "i"))
    terms = short_terms(F.coalesce("b.terms", F.expr("CAST(array() AS array<string>)"))).alias("concept_keys")
    c, e, l = block("c", "c"), block("e", "e"), block("l", "l")  # noqa: E741
    claims = c.select(F.col("id").alias("claim_id"), "section_id", F.col("b.text").alias("claim_text"), _enum(F.col("b.type"), CLAIM_TYPES).alias("claim_type"), _enum(F.col("b.importance"), IMPORTANCES).alias("importance"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("b.confidence", F.lit(0.5)))).alias("extraction_confidence"), terms)
    evidence = e.select(F.col("id").alias("evidence_id"), "section_id", F.col("b.text").alias("evidence_text"), _enum(F.col("b.type"), EVIDENCE_TYPES).alias("evidence_type"), _enum(F.col("b.strength"), STRENGTHS).alias("strength"), terms)
    limits = l.select(F.col("id").alias("limitation_id"), "section_id", F.col("b.text").alias("limitation_text"), _enum(F.col("b.type"), RISKS).alias("risk_type"), _enum(F.col("b.severity"), SEVERITIES).alias("severity"), terms)
    ids = c.select("section_id", F.col("i").alias("n"), F.col("id").alias("target_id"))
    edge = lambda d, kind: d.select("section_id", F.col("id").alias("source_id"), F.explode(F.array_distinct("b.claims")).alias("n")).join(ids, ["section_id", "n"]).select("source_id", "target_id", F.lit(kind).alias("relation_type"), F.lit(link_confidence).alias("confidence"))
    return claims, evidence, limits, edge(e, "supports").unionByName(edge(l, "constrains"))


def parse_concepts(answers: DataFrame) -> DataFrame:
    """(section_id, concept_key, namespace, label, english, definition, aliases, parents) of answers; unfit labels go."""
    got = answers.select("section_id", F.from_json(tx.json_payload(F.col("answer")), CONCEPTS).alias("a")).select("section_id", F.explode("a.concepts").alias("c"))
    ns, label, english = _enum(F.lower("c.namespace"), NAMESPACES), clean_term(F.col("c.term")), clean_term(F.col("c.english"), english=True)
    parent = clean_term(F.col("c.parent"))
    named = got.select("section_id", ns.alias("namespace"), label.alias("label"), english.alias("english"), F.coalesce("c.definition", F.lit("")).alias("definition"), F.col("c.aliases").alias("raw"), F.when(parent != "", F.array(parent)).otherwise(F.expr("CAST(array() AS array<string>)")).alias("parents"))
    return named.where("label <> '' OR english <> ''").select("section_id", canonical_key(F.col("namespace"), F.col("label"), F.col("english")).alias("concept_key"), "namespace", "label", "english", "definition", clean_aliases(F.col("raw"), F.col("label"), F.col("english")).alias("aliases"), "parents")


def cards(documents: DataFrame) -> DataFrame:
    """Document cards from answers about their beginnings (paper_id, source_file, answer): every field has a default."""
    got = F.from_json(tx.json_payload(F.col("answer")), CARD)
    or_ = lambda field, default: F.coalesce(F.nullif(got[field], F.lit("")), default)
    none = F.expr("CAST(array() AS array<string>)")
    return documents.select("paper_id", or_("title", F.col("source_file")).alias("title"), F.coalesce(got["authors"], none).alias("authors"), got["year"].alias("year"), "source_file", or_("abstract", F.lit("")).alias("abstract"), F.coalesce(got["keywords"], none).alias("keywords"), _enum(got["research_type"], RESEARCH_TYPES).alias("research_type"), or_("main_framework", F.lit("")).alias("main_framework"))


def new_groups(decided: DataFrame) -> DataFrame:
    """Series groups of documents that begin one (paper_id, graph_id, title, main_framework): named after framework or title."""
    name = F.coalesce(F.nullif(F.col("main_framework"), F.lit("")), F.substring("title", 1, 50))
    return decided.select(F.concat(F.lit("group-"), F.substring(F.sha2(F.concat_ws("|", "graph_id", F.col("paper_id").cast("string")), 256), 1, 16)).alias("group_id"), name.alias("name"), F.array("graph_id").alias("graph_ids"), F.coalesce("main_framework", F.lit("")).alias("domain"), F.lit(1.0).alias("confidence"))


def model_matches(candidates: DataFrame, least: int = 60, tries: int = 3) -> DataFrame:
    """Of a model's scores for the best candidates (paper_id, group_id, rank, answer) the first of 60 or more, in rank order."""
    got = F.from_json(tx.json_payload(F.col("answer")), "score double, reasoning string")
    good = candidates.where(F.col("rank") <= tries).withColumn("a", got).where(F.col("a.score") >= least)
    best = good.groupBy("paper_id").agg(F.min_by(F.struct("group_id", "a"), "rank").alias("m"))
    return best.select("paper_id", F.col("m.group_id").alias("group_id"), (F.col("m.a.score") / 100).alias("confidence"), F.col("m.a.reasoning").alias("reasoning"))
