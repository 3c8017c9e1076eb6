"""Entity resolution: shingles, exact and sketched similarity, concept registration, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grapnel.operators import allpairs
from grapnel.operators.concepts import register_in_order
from grapnel.plans import views
from grapnel.plans.views import oracle
from grapnel.registry import query
from grapnel.scratch import materialize

MIN_JACCARD = 0.25


# ---- operators -------------------------------------------------------------------------------------

def shingles(text: Column, k: int = 3) -> Column:
    """Distinct lower-case character k-grams, blanks collapsed; a shorter text is its own shingle.

    The text is taken apart once: titles can be whole documents of one line.
    """
    def grams(ch: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ch) - k, F.lit(0)))
        return F.when(F.size(ch) < k, F.array(F.array_join(ch, ""))).otherwise(F.array_distinct(F.transform(starts, lambda i: F.concat(*(F.get(ch, i + j) for j in range(k))))))

    letters = F.filter(F.split(flat_title(text), ""), lambda c: c != "")
    return F.get(F.transform(F.array(letters), grams), F.lit(0))


def flat_title(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[ \\t\\r\\n]+", " "))


def title_classes(titles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first): the smallest key whose title is the same, blanks and case aside."""
    flat = F.sha2(flat_title(F.col(text)), 256).alias("h")
    first = titles.select(F.col(key).alias("k"), flat).groupBy("h").agg(F.min("k").alias("first"))
    return titles.select(key, flat).join(first, "h").select(key, "first")


def different_titles(titles: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t): each title once, blanks and case aside, by its smallest key."""
    return titles.select(F.col(key).alias("id"), flat_title(F.col(text)).alias("t")).where("t IS NOT NULL").groupBy("t").agg(F.min("id").alias("id")).select("id", "t")


def jaccard_pairs(titles: DataFrame, key: str, text: str, least: float = MIN_JACCARD, rows: int = allpairs.ROWS) -> DataFrame:
    """Pairs of different titles with exact shingle Jaccard of ``least`` or more, each title by its smallest key.

    All pairs are counted in blocks (:mod:`grapnel.operators.allpairs`), none is sent through a shuffle.  Equal
    titles are one (:func:`different_titles`), so copies don't multiply.
    """
    return allpairs.compare(allpairs.written(different_titles(titles, key, text), rows=rows), least).withColumn("jaccard", F.round("jaccard", 6))


def best_earlier(titles: DataFrame, key: str, text: str, least: float = MIN_JACCARD, rows: int = allpairs.ROWS) -> DataFrame:
    """Of :func:`jaccard_pairs` those that :func:`series_decision` can choose: a pair of blocks gives each title's best only."""
    return allpairs.compare(allpairs.written(different_titles(titles, key, text), rows=rows), least, best=True)


def minhash_pairs(titles: DataFrame, key: str, text: str, least: float = MIN_JACCARD, tables: int = 16, rows: int = allpairs.ROWS) -> DataFrame:
    """The sketch: pairs that agree on one of ``tables`` min-hashes, verified on the whole sets.

    A pair of Jaccard j is found with 1 - (1 - j) ** tables, 0.99 at a quarter.  Different titles only,
    each by its smallest key.  At a quarter nearly all pairs agree somewhere, so buckets would write them all;
    blocks of sets and min-hashes are compared instead, and a pair has to pass both.
    """
    least_of = lambda s, t: F.array_min(F.transform(s, lambda x: F.xxhash64(F.lit(t), x)))
    marks = F.get(F.transform(F.array(shingles(F.col("t"))), lambda s: F.array(*(least_of(s, t) for t in range(tables)))), F.lit(0))
    return allpairs.compare(allpairs.written(different_titles(titles, key, text), marks, rows), least).select("a", "b", "jaccard")


def series_decision(pairs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Join an existing series (the best earlier title, confidence + 0.2) or begin a new one.

    The best earlier title of a copy is the first with the same title; of a first one it is a first one, as
    that is the smallest key with this title.
    """
    w = Window.partitionBy("b").orderBy(F.desc("jaccard"), "a")
    best = pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("b").alias(key), F.col("a").alias("__a"), F.round(F.least(F.col("jaccard") + 0.2, F.lit(1.0)), 6).alias("__c"))
    copy = F.col(key) != F.col("first")
    told = classes.join(best, key, "left").withColumn("series_of", F.when(copy, F.col("first")).otherwise(F.col("__a")))
    return told.select(key, F.when(F.col("series_of").isNull(), "new").otherwise("join").alias("decision"), "series_of", F.when(copy, 1.0).otherwise(F.coalesce("__c", F.lit(1.0))).alias("confidence"))


def slug(label: Column, width: int = 25) -> Column:
    """ASCII words joined by underscores; labels without any get a hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain != "", F.substring(plain, 1, width)).otherwise(F.concat(F.lit("c_"), F.substring(F.md5(label), 1, 8)))


def clean_terms(terms: Column, longest: int = 32, most_words: int = 6) -> Column:
    """Trimmed terms, the part before a colon dropped, too long ones removed, first occurrences kept."""
    bare = F.transform(terms, lambda t: F.btrim(F.regexp_replace(t, "^[^:：]*[:：]", "")))
    return F.array_distinct(F.filter(bare, lambda t: (t != "") & (F.length(t) <= longest) & (F.size(F.split(t, " +")) <= most_words)))


def alias_conflicts(concepts: DataFrame) -> DataFrame:
    """Pairs of concepts of one graph that share an alias: an equi-join on (graph, alias)."""
    flat = concepts.select("graph_id", "concept_key", "rank", F.explode("aliases").alias("alias"))
    a, b = flat.alias("a"), flat.alias("b")
    hits = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.alias") == F.col("b.alias")) & (F.col("a.rank") < F.col("b.rank")))
    return hits.groupBy(F.col("a.graph_id").alias("graph_id"), F.col("a.concept_key").alias("concept_a"), F.col("b.concept_key").alias("concept_b")).agg(F.count("*").alias("n_shared"))


def bridge_candidates(concepts: DataFrame) -> DataFrame:
    """Cross-graph links between active concepts, classified by the first rule that applies.

    Rules that compare keys are equi-joins (label, key after its prefix, alias).  The two weakest compare
    all pairs: of one namespace, joined with the concepts' (small) character sets, and of a framework
    with a concept, which are joined on the namespace that applies.
    """
    c = concepts.where("status = 'active'").select("graph_id", "concept_key", F.lower("label").alias("label"), "namespace", "aliases", F.array_distinct(F.split(F.lower("label"), "")).alias("chars"), F.regexp_replace("concept_key", "^[^:]*:", "").alias("slug"))
    a, b = (c.select(*(F.col(x).alias(f"{x}_{s}") for x in c.columns)) for s in ("a", "b"))
    pick = ("graph_id_a", "concept_key_a", "graph_id_b", "concept_key_b")
    order = F.col("graph_id_a") < F.col("graph_id_b")
    same = a.join(b, order & (F.col("label_a") == F.col("label_b"))).select(*pick, F.lit(1).alias("rule"), F.lit("same_as").alias("bridge_type"), F.lit(0.9).alias("confidence"), (F.col("namespace_a") == F.col("namespace_b")).alias("same_namespace"))
    slugs = a.join(b, order & (F.col("slug_a") == F.col("slug_b"))).select(*pick, F.lit(2).alias("rule"), F.lit("same_as").alias("bridge_type"), F.lit(0.8).alias("confidence"), (F.col("namespace_a") == F.col("namespace_b")).alias("same_namespace"))
    fa, fb = a.withColumn("alias", F.explode("aliases_a")), b.withColumn("alias_b", F.explode("aliases_b"))
    alias = fa.join(fb, order & (F.col("alias") == F.col("alias_b"))).groupBy(*pick, (F.col("namespace_a") == F.col("namespace_b")).alias("same_namespace")).agg(F.count("*").alias("n"))
    alias = alias.select(*pick, F.lit(3).alias("rule"), F.lit("same_as").alias("bridge_type"), F.round(F.least(F.lit(0.7), F.lit(0.4) + F.col("n") * 0.1), 6).alias("confidence"), "same_namespace")
    like = a.join(b, order & (F.col("namespace_a") == F.col("namespace_b")) & (F.size(F.array_intersect("chars_a", "chars_b")) >= 3)).select(*pick, F.lit(4).alias("rule"), F.lit("analogous_to").alias("bridge_type"), F.lit(0.4).alias("confidence"), F.lit(True).alias("same_namespace"))
    other = F.when(F.col("namespace_a") == "framework", "concept").when(F.col("namespace_a") == "concept", "framework")
    applies = a.join(b, order & (other == F.col("namespace_b"))).select(*pick, F.lit(5).alias("rule"), F.lit("applies_to").alias("bridge_type"), F.lit(0.3).alias("confidence"), F.lit(False).alias("same_namespace"))
    w = Window.partitionBy(*pick).orderBy("rule")
    best = same.unionByName(slugs).unionByName(alias).unionByName(like).unionByName(applies).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    active = (F.col("bridge_type") == "same_as") & (F.col("confidence") >= 0.8) & F.col("same_namespace")
    return best.withColumn("review_status", F.when(active, "active").otherwise("candidate")).drop("rn", "rule", "same_namespace")


# ---- queries ---------------------------------------------------------------------------------------

_SETS = """SELECT paper_id, first, CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END AS s
  FROM (SELECT paper_id, t, min(paper_id) OVER (PARTITION BY t) AS first FROM (SELECT paper_id, trim(regexp_replace(lower(title), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM papers))"""
_PAIRS = """SELECT a, b, common, round(common / (na + nb - common), 6) AS jaccard FROM (SELECT x.paper_id AS a, y.paper_id AS b, len(list_intersect(x.s, y.s)) AS common, len(x.s) AS na, len(y.s) AS nb
  FROM sets x JOIN sets y ON x.paper_id < y.paper_id AND x.paper_id = x.first AND y.paper_id = y.first) WHERE common / (na + nb - common) >= 0.25"""


def _titles(spark, sf):
    return views.papers(spark, sf).where("title IS NOT NULL")


@query(oracle("SELECT paper_id, len(s) AS n FROM sets", sets=_SETS))
def title_shingles(spark, sf):
    return _titles(spark, sf).select("paper_id", F.size(shingles(F.col("title"))).alias("n"))


@query(oracle(_PAIRS, sets=_SETS))
def shingle_jaccard(spark, sf):
    return jaccard_pairs(_titles(spark, sf), "paper_id", "title")


@query(oracle("""SELECT p.paper_id, CASE WHEN p.paper_id <> p.first OR b.a IS NOT NULL THEN 'join' ELSE 'new' END AS decision, CASE WHEN p.paper_id <> p.first THEN p.first ELSE b.a END AS series_of,
  CASE WHEN p.paper_id <> p.first THEN 1.0::DOUBLE ELSE coalesce(round(least(b.jaccard + 0.2, 1.0), 6), 1.0)::DOUBLE END AS confidence FROM sets p
  LEFT JOIN (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY b ORDER BY jaccard DESC, a) = 1) b ON p.paper_id = b.b""", sets=_SETS, pairs=_PAIRS))
def series_decisions(spark, sf):
    t = _titles(spark, sf)
    return series_decision(best_earlier(t, "paper_id", "title"), title_classes(t, "paper_id", "title"), "paper_id")


@query()
def series_minhash(spark, sf):
    return minhash_pairs(_titles(spark, sf), "paper_id", "title").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(oracle("""SELECT a.graph_id, a.concept_key AS concept_a, b.concept_key AS concept_b, count(*) AS n_shared FROM (SELECT *, unnest(aliases) AS alias FROM concepts) a
  JOIN (SELECT *, unnest(aliases) AS alias FROM concepts) b ON a.graph_id = b.graph_id AND a.alias = b.alias AND a.rank < b.rank GROUP BY ALL"""))
def alias_conflict_pairs(spark, sf):
    return alias_conflicts(views.concepts(spark, sf))


_SEQ = "SELECT graph_id, concept_key, aliases, rank, row_number() OVER (ORDER BY graph_id, rank) AS seq FROM concepts"


@query(oracle("""SELECT n.graph_id, n.concept_key, CASE WHEN rn > 1 THEN 'reject_duplicate' WHEN n.rank % 4 = 0 OR EXISTS (SELECT 1 FROM held h WHERE list_contains(n.aliases, h.alias) AND h.seq < n.seq) THEN 'needs_review' ELSE 'accept_candidate' END AS decision
  FROM firsts n""", firsts=f"SELECT *, row_number() OVER (PARTITION BY concept_key ORDER BY seq) AS rn FROM ({_SEQ})", held="SELECT alias, min(seq) AS seq FROM (SELECT seq, unnest(aliases) AS alias FROM firsts WHERE rn = 1) GROUP BY 1"))
def register_decisions(spark, sf):
    """All concepts of all graphs, registered one after the other in one registry."""
    c = views.concepts(spark, sf)
    # the order is data: any sortable key will do, so nothing is numbered across graphs
    new = c.select(F.struct("graph_id", "rank").alias("seq"), F.lit("*").alias("graph_id"), F.col("graph_id").alias("home"), "concept_key", "aliases", F.when(F.col("rank") % 4 == 0, "strict").otherwise("open").alias("merge_policy"))
    told = register_in_order(new, new.limit(0))
    return told.select(F.col("home").alias("graph_id"), "concept_key", "decision")


@query(oracle("""SELECT paper_id, CASE WHEN p <> '' THEN substr(p, 1, 25) ELSE 'c_' || substr(md5(title), 1, 8) END AS slug FROM (SELECT paper_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS p FROM papers)"""))
def canonical_keys(spark, sf):
    return views.papers(spark, sf).select("paper_id", slug(F.col("title")).alias("slug"))


@query(oracle("""SELECT paper_id, array_to_string(terms, '|') AS terms FROM (SELECT paper_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS terms FROM (SELECT paper_id,
  list_filter(list_transform(string_split(title || ',tag: ' || title || ',x', ','), lambda t: trim(regexp_replace(t, '^[^:：]*[:：]', ''))), lambda t: t <> '' AND length(t) <= 32 AND len(regexp_split_to_array(t, ' +')) <= 6) AS l FROM papers))"""))
def cleaned_terms(spark, sf):
    raw = F.split(F.concat("title", F.lit(",tag: "), "title", F.lit(",x")), ",")
    return views.papers(spark, sf).select("paper_id", F.array_join(clean_terms(raw), "|").alias("terms"))


_BRIDGES = """SELECT graph_id_a, concept_key_a, graph_id_b, concept_key_b, bridge_type, confidence, CASE WHEN bridge_type = 'same_as' AND confidence >= 0.8 AND ns THEN 'active' ELSE 'candidate' END AS review_status FROM (
  SELECT graph_id_a, concept_key_a, graph_id_b, concept_key_b, ns, CASE WHEN la = lb OR sa = sb OR n > 0 THEN 'same_as' WHEN ns AND chars >= 3 THEN 'analogous_to' ELSE 'applies_to' END AS bridge_type,
    CASE WHEN la = lb THEN 0.9::DOUBLE WHEN sa = sb THEN 0.8::DOUBLE WHEN n > 0 THEN round(least(0.7, 0.4 + 0.1 * n), 6)::DOUBLE WHEN ns AND chars >= 3 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS confidence
  FROM (SELECT a.graph_id AS graph_id_a, a.concept_key AS concept_key_a, b.graph_id AS graph_id_b, b.concept_key AS concept_key_b, lower(a.label) AS la, lower(b.label) AS lb, a.namespace = b.namespace AS ns,
      regexp_replace(a.concept_key, '^[^:]*:', '') AS sa, regexp_replace(b.concept_key, '^[^:]*:', '') AS sb, least(a.namespace, b.namespace) = 'concept' AND greatest(a.namespace, b.namespace) = 'framework' AS applies,
      len(list_intersect(a.aliases, b.aliases)) AS n, len(list_intersect(list_distinct(string_split(lower(a.label), '')), list_distinct(string_split(lower(b.label), '')))) AS chars
    FROM bridged a JOIN bridged b ON a.graph_id < b.graph_id AND a.status = 'active' AND b.status = 'active') WHERE la = lb OR sa = sb OR n > 0 OR (ns AND chars >= 3) OR applies)"""


@query(oracle(_BRIDGES, bridged="SELECT * FROM concepts"))
def bridges(spark, sf):
    return bridge_candidates(materialize(views.concepts(spark, sf), "concepts"))


@query(oracle(_BRIDGES, bridged="""SELECT graph_id, CASE WHEN rank % 2 = 0 THEN 'framework:' || label ELSE concept_key END AS concept_key, CASE WHEN n % 2 = 0 THEN label || ' ' || n ELSE label END AS label,
  aliases, status, CASE rank % 3 WHEN 0 THEN 'framework' WHEN 1 THEN 'concept' ELSE namespace END AS namespace FROM concepts"""))
def bridge_rules(spark, sf):
    """All five rules: keys after different prefixes, labels that differ by a count, frameworks and concepts."""
    c, even = views.concepts(spark, sf), lambda x: F.col(x) % 2 == 0
    renamed = c.select(
        "graph_id", "aliases", "status", F.when(even("rank"), F.concat(F.lit("framework:"), "label")).otherwise(F.col("concept_key")).alias("concept_key"),
        F.when(even("n"), F.concat_ws(" ", "label", F.col("n").cast("string"))).otherwise(F.col("label")).alias("label"),
        F.when(F.col("rank") % 3 == 0, "framework").when(F.col("rank") % 3 == 1, "concept").otherwise(F.col("namespace")).alias("namespace"),
    )
    return bridge_candidates(materialize(renamed, "concepts"))
