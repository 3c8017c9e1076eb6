"""Queries over the line and title rules, on document lines that were given the patterns to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from grapnel.functions import text as tx
from grapnel.functions.keywords import GENERAL, summary, titles
from grapnel.operators import structure
from grapnel.plans import views
from grapnel.plans.views import oracle, table
from grapnel.registry import query

# Lines with patterns that the tables lack, by ordinal; the SQL makes the same ones.
_DRESS = {
    "noise": ("CASE ord % 7 WHEN 0 THEN CAST(ord AS VARCHAR) WHEN 1 THEN '12 : 34' WHEN 2 THEN '25 mm' WHEN 3 THEN repeat('=', 17) ELSE text END"),
}


def _sections(spark, sf):
    return views.sections(spark, sf)


def _by_ord(n: int, cases: dict[int, object], other):
    out = other
    for k, v in cases.items():
        out = F.when(F.col("ord") % n == k, v).otherwise(out)
    return out


@query(oracle("""SELECT section_id, CASE WHEN ord % 4 = 0 THEN '知识图谱，模型' || text WHEN ord % 4 = 1 THEN '知识。A B' ELSE text END AS merged FROM sections"""))
def cjk_blank_merge(spark, sf):
    t = _by_ord(4, {0: F.concat(F.lit("知 识\t图 谱 ，模 型"), "text"), 1: F.lit("知  识 。A B")}, F.col("text"))
    return _sections(spark, sf).select("section_id", tx.merge_cjk_blanks(t).alias("merged"))


@query(oracle(f"""SELECT section_id, regexp_matches(t, '^[0-9]{{1,4}}$') OR (regexp_matches(t, '^[0-9 \\t.:：∶]+$') AND length(t) <= 15) OR regexp_matches(t, '^[0-9]+[ \\t]*(nm|mm|cm|m|km|g|kg|ml|L|mol|%)$')
  OR (length(t) >= 16 AND len(list_distinct(string_split(t, ''))) = 1) AS noise FROM (SELECT section_id, {_DRESS['noise']} AS t FROM sections)"""))
def noise_lines(spark, sf):
    t = _by_ord(7, {0: F.col("ord").cast("string"), 1: F.lit("12 : 34"), 2: F.lit("25 mm"), 3: F.lit("=" * 17)}, F.col("text"))
    return _sections(spark, sf).select("section_id", tx.is_noise_line(t).alias("noise"))


@query("""SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(trim(x), '^[0-9]{1,4}$'))) AS n_noise, len(l) - len(list_filter(l, lambda x: regexp_matches(trim(x), '^[0-9]{1,4}$'))) AS n_kept
 FROM (SELECT doc_id, string_split(text || chr(10) || ' 12 ' || chr(10) || '7', chr(10)) AS l FROM documents)""")
def filtered_lines(spark, sf):
    text = F.concat("text", F.lit("\n 12 \n7"))
    kept, n = tx.filter_lines(text)
    return table(spark, sf, "documents").select("doc_id", n.alias("n_noise"), F.size(F.split(kept, "\n")).alias("n_kept"))


@query("SELECT doc_id, doc_id % 3 = 0 AS poor FROM documents")
def poor_pages(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.lit("知\n识\n图\n谱\nxx")).when(F.col("doc_id") % 3 == 1, F.lit("知\n识")).otherwise(F.lit("知\n识\nabc\nde"))
    return table(spark, sf, "documents").select("doc_id", tx.is_poor_page(t).alias("poor"))


_TOC = "CASE ord % 6 WHEN 0 THEN '第 ' || (ord + 1) || ' 章 ' || left(label, 12) || ' ........ ' || (ord * 3) WHEN 1 THEN '第' || ord || '节' || left(label, 9) || '   ' || ord WHEN 2 THEN '第' || ord || '章 ' || left(label, 9) WHEN 3 THEN left(label, 12) || ' ..... 7' ELSE text END"
_LABELED = "SELECT *, regexp_replace(text, '[^a-z]', '', 'g') AS label FROM sections"


def _toc_lines(spark, sf):
    label = F.regexp_replace("text", "[^a-z]", "")
    o = F.col("ord").cast("string")
    t = _by_ord(6, {
        0: F.concat(F.lit("第 "), (F.col("ord") + 1).cast("string"), F.lit(" 章 "), F.left(label, F.lit(12)), F.lit(" ........ "), (F.col("ord") * 3).cast("string")),
        1: F.concat(F.lit("第"), o, F.lit("节"), F.left(label, F.lit(9)), F.lit("   "), o), 2: F.concat(F.lit("第"), o, F.lit("章 "), F.left(label, F.lit(9))), 3: F.concat(F.left(label, F.lit(12)), F.lit(" ..... 7")),
    }, F.col("text"))
    return _sections(spark, sf).select("section_id", "doc_id", "ord", "page", t.alias("line"))


@query(oracle("""SELECT section_id, CASE ord % 6 WHEN 0 THEN trim('第' || (ord + 1) || '章 ' || left(label, 12)) WHEN 1 THEN '第' || ord || '节 ' || left(label, 9) ELSE trim('第' || ord || '章 ' || left(label, 9)) END AS title,
  CASE WHEN ord % 6 = 1 THEN 2 ELSE 1 END::BIGINT AS level, CASE ord % 6 WHEN 0 THEN ord * 3 WHEN 1 THEN ord ELSE 0 END AS printed_page FROM labeled WHERE ord % 6 < 3 AND label <> ''""", labeled=_LABELED))
def toc_lines(spark, sf):
    parsed = _toc_lines(spark, sf).where(F.length(F.regexp_replace("line", "[^a-z]", "")) > 0).withColumn("e", tx.parse_toc_line(F.col("line"))).where("e IS NOT NULL")
    return parsed.select("section_id", "e.title", "e.level", "e.printed_page")


_NUMBERED = "CASE ord % 6 WHEN 0 THEN '144 ' || text WHEN 1 THEN 'P12 ' || text WHEN 2 THEN '第33页 ' || text WHEN 3 THEN '3/90 ' || text WHEN 4 THEN '2007 年 ' || text ELSE text END"


def _numbered(spark, sf):
    t = _by_ord(6, {0: F.concat(F.lit("144 "), "text"), 1: F.concat(F.lit("P12 "), "text"), 2: F.concat(F.lit("第33页 "), "text"), 3: F.concat(F.lit("3/90 "), "text"), 4: F.concat(F.lit("2007 年 "), "text")}, F.col("text"))
    return _sections(spark, sf).select("section_id", "doc_id", "ord", t.alias("line"))


@query(oracle("SELECT section_id, CASE WHEN ord % 6 = 4 THEN '2007 年 ' || text ELSE text END AS stripped FROM sections"))
def page_numbers_stripped(spark, sf):
    return _numbered(spark, sf).select("section_id", tx.strip_page_number(F.col("line")).alias("stripped"))


@query(oracle(f"""SELECT doc_id, number, count(*) AS n, min(ord) AS first_ord FROM (SELECT doc_id, ord, regexp_extract({_NUMBERED}, '^([0-9]{{1,4}})[ \\t]', 1) AS number FROM sections WHERE ord % 6 <> 4) WHERE number <> '' GROUP BY ALL"""))
def leading_numbers(spark, sf):
    """Leading numbers by document, those before date words aside: how often, and where first."""
    pattern = rf"^([0-9]{{1,4}})[ \t]+(?!{tx.DATE_WORDS})"
    found = _numbered(spark, sf).withColumn("number", F.regexp_extract("line", pattern, 1)).where("number <> ''")
    return found.groupBy("doc_id", "number").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query(oracle("""SELECT section_id, CASE WHEN length(one) >= 10 THEN one WHEN one <> '' AND length(two) >= 15 THEN two ELSE left(text, 50) END AS sentence FROM (SELECT section_id, text,
  regexp_extract(left(text, 151), '^[^。！？!?.\\n]*[。！？!?.\\n]') AS one, regexp_extract(left(text, 151), '^[^。！？!?.\\n]*[。！？!?.\\n][^。！？!?.\\n]*[。！？!?.\\n]') AS two FROM sections)"""))
def first_sentences(spark, sf):
    return _sections(spark, sf).select("section_id", tx.first_sentence(F.col("text")).alias("sentence"))


@query(oracle("SELECT section_id, ['前言', '目录', '参考文献', '附录', '', '', ''][ord % 7 + 1] AS label FROM sections"))
def special_blocks(spark, sf):
    h = views.pick(("Preface", "Table of Contents", "References", "附錄", "", "other", "Prefaces"), F.col("ord") % 7)
    return _sections(spark, sf).select("section_id", tx.special_block(F.col("text"), h).alias("label"))


@query(oracle("""SELECT section_id, array_to_string(list_filter([CASE WHEN length(t) < 50 THEN 'too_short' END, CASE WHEN ord % 5 = 0 OR NOT regexp_matches(t, '^[一-鿿a-zA-Z0-9"''(（\\[]') THEN 'suspicious_first_char' END,
   CASE WHEN ord % 5 = 0 THEN 'starts_with_punctuation' END], lambda x: x IS NOT NULL), ',') AS concerns FROM (SELECT section_id, ord, CASE WHEN ord % 5 = 0 THEN '，' || text ELSE text END AS t FROM sections)"""))
def quality_concerns(spark, sf):
    t = _by_ord(5, {0: F.concat(F.lit("，"), "text")}, F.col("text"))
    return _sections(spark, sf).select("section_id", F.array_join(tx.quality_concerns(t), ",").alias("concerns"))


_HEADS = ("目录", "12", "第3章 细胞", "讨论", "一、概念检测", "科学家访谈", "Some long heading", "short", "--- 12 ---")


@query(oracle("""SELECT section_id, CASE h WHEN '目录' THEN 'front_matter' WHEN '12' THEN 'noise' WHEN '第3章 细胞' THEN CASE WHEN ord % 2 = 0 THEN 'toc_entry' ELSE 'structural_heading' END WHEN '讨论' THEN 'context_heading'
  WHEN '一、概念检测' THEN 'context_heading' WHEN '科学家访谈' THEN 'decorative' WHEN '--- 12 ---' THEN 'noise' ELSE 'structural_heading' END AS role
  FROM (SELECT section_id, ord, ['目录', '12', '第3章 细胞', '讨论', '一、概念检测', '科学家访谈', 'Some long heading', 'short', '--- 12 ---'][ord % 9 + 1] AS h FROM sections)"""))
def heading_roles(spark, sf):
    h = views.pick(_HEADS, F.col("ord") % 9)
    return _sections(spark, sf).select("section_id", tx.heading_role(h, F.lit(2), F.col("ord") % 2 == 0).alias("role"))




@query(oracle("""SELECT section_id, CASE WHEN ord % 8 = 0 THEN 'noise' WHEN (place < 0.05 OR place > 0.95) AND ord % 8 = 3 THEN 'front' WHEN ord % 8 = 1 THEN 'structural' WHEN ord % 8 = 2 THEN 'context'
   WHEN (place < 0.05 OR place > 0.95) AND regexp_matches(lower(text), 'preface|foreword|acknowledgment|appendix|contents') THEN 'front' WHEN ord % 8 > 3 AND regexp_matches(text, '(?i)^([IVX]+\\.[ \\t]+|[0-9]+\\.[0-9]+[ \\t]+|[A-G]\\.[ \\t]+)') THEN 'structural' ELSE 'content' END AS role
  FROM (SELECT section_id, ord, text, (ord - 1)::DOUBLE / max(ord) OVER (PARTITION BY doc_id) AS place FROM sections)"""))
def block_roles(spark, sf):
    from pyspark.sql import Window

    s = _sections(spark, sf).withColumn("total", F.max("ord").over(Window.partitionBy("doc_id")))
    t = _by_ord(8, {0: F.lit("12"), 1: F.lit("Chapter 4 of it"), 2: F.lit("(3) a task"), 3: F.lit("foreword of mine")}, F.col("text"))
    return s.select("section_id", tx.block_role(t, F.col("ord") - 1, F.col("total"), F.lit(0)).alias("role"))


_PHRASES = "list_filter(list_transform(regexp_split_to_array({0}, '{1}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: regexp_matches(p, '[一-鿿a-zA-Z]{{2,}}') AND length(p) >= 3)"
_SPLIT, _IN = GENERAL.splitter, lambda words: ", ".join(f"'{w}'" for w in words)
_KEYWORDS = f"""WITH d AS (SELECT doc_id, text, substr(text, 1, 12) AS heading FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, heading, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?\\n；;]')[1:5], lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')[1:3], '') AS t FROM d),
 p AS (SELECT doc_id, {_PHRASES.format('t', _SPLIT)} AS found, {_PHRASES.format('heading', _SPLIT)} AS hs FROM s),
 f AS (SELECT doc_id, found, list_filter(found, lambda p: length(p) <= {GENERAL.longest} AND lower(p) NOT IN ({_IN(GENERAL.stops)}) AND p NOT IN ({_IN(GENERAL.unfit)}) AND NOT list_contains(hs, p)) AS fit FROM p),
 k AS (SELECT doc_id, CASE WHEN len(fit) > 0 THEN fit ELSE list_filter(found, lambda p: lower(p) NOT IN ({_IN(GENERAL.stops)})) END AS kept FROM f),
 c AS (SELECT doc_id, p, count(*) AS n, min(i) AS i FROM (SELECT doc_id, unnest(kept) AS p, generate_subscripts(kept, 1) AS i FROM k) GROUP BY ALL),
 o AS (SELECT *, count(*) FILTER (n = 1) OVER (PARTITION BY doc_id) >= 2 AS several FROM c),
 r AS (SELECT doc_id, list(p ORDER BY length(p) DESC, CASE WHEN several THEN 0 ELSE -n END, i) AS ps FROM o WHERE n = 1 OR NOT several GROUP BY doc_id),
 g AS (SELECT doc_id, ps, list_reduce(list_concat([''], ps), lambda acc, p: CASE WHEN length(acc) < 6 AND length(acc) + length(p) <= 18 AND NOT contains(acc, p) THEN acc || p ELSE acc END) AS t FROM r)"""


@query(_KEYWORDS + " SELECT d.doc_id, coalesce(substr(CASE WHEN length(t) < 6 THEN ps[1] ELSE t END, 1, 18), '') AS keywords FROM d LEFT JOIN g USING (doc_id)")
def keyword_summaries(spark, sf):
    """Keywords of whole documents whose heading is their beginning."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", summary(F.col("text"), F.substring("text", 1, 12)).alias("keywords"))


@query(oracle(f"""SELECT section_id, CASE role WHEN 'noise' THEN '' WHEN 'front' THEN heading WHEN 'structural' THEN heading ELSE '' END AS structure FROM (SELECT r.section_id, r.role, h.text AS heading FROM ({structure._ROLES}) r
  JOIN sections s USING (section_id) JOIN sections h ON h.doc_id = s.doc_id AND h.is_head AND h.chapter = s.chapter) WHERE role IN ('noise', 'front', 'structural')"""))
def augmented_titles(spark, sf):
    """Structure titles of the sections that take them from their chapter's heading."""
    s = structure.section_roles(views.sections(spark, sf))
    h = s.where("is_head").select("doc_id", "chapter", F.col("text").alias("heading"))
    made = s.join(h, ["doc_id", "chapter"]).withColumn("t", titles(F.col("heading"), F.col("text"), F.col("role"), F.lit("")))
    return made.where("role IN ('noise', 'front', 'structural')").select("section_id", F.col("t.structure").alias("structure"))


@query("""SELECT d.doc_id, b.item_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + length(b.text) AS stop FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def span_locate(spark, sf):
    """Benchmark passages in documents: the short list of passages is broadcast, the documents stream by."""
    d, b = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = d.join(F.broadcast(b), F.contains("text", "quote")).withColumn("at", tx.locate(F.col("text"), F.col("quote")))
    return hits.select("doc_id", "item_id", F.col("at.start").alias("start"), F.col("at.end").alias("stop"))


@query(oracle("SELECT section_id, sha256(text) AS content_hash, sha256(lower(regexp_replace(text, '[ \\t]+', '', 'g'))) AS normal_hash, length(text) // 4 AS tokens FROM sections"))
def content_hashes(spark, sf):
    return _sections(spark, sf).select("section_id", F.sha2("text", 256).alias("content_hash"), F.sha2(F.lower(F.regexp_replace("text", "[ \\t]+", "")), 256).alias("normal_hash"), tx.token_estimate(F.col("text")).alias("tokens"))


_ANSWERS = ('```json\n{"type": "Method", "score": 0.5}\n```', 'Sure: {"type": "result", "score": 2} done', "no json", '{"type": 5}')


@query(oracle("""SELECT section_id, ['method', 'result', 'other', 'other'][ord % 4 + 1] AS kind, CAST([0.5, 1.0, 0.5, 0.5][ord % 4 + 1] AS DOUBLE) AS score FROM sections"""))
def answer_parsing(spark, sf):
    """A model's answer to typed values: payload, tolerant JSON, enum default, clamped score."""
    got = F.from_json(tx.json_payload(views.pick(_ANSWERS, F.col("ord") % 4)), "type string, score double")
    kind = tx.coerced(F.coalesce(got["type"], F.lit("")), ("method", "result", "theory"), "other")
    return _sections(spark, sf).select("section_id", kind.alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got["score"], F.lit(0.5)))).alias("score"))
