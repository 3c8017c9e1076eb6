"""Ordered document dataflow: outlines, heading paths, windows, stitching, groups, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grapnel.functions import text as tx
from grapnel.operators import layout
from grapnel.plans import views
from grapnel.plans.views import oracle, table
from grapnel.registry import query


# ---- operators -------------------------------------------------------------------------------------

def asof_outline(sections: DataFrame, outline: DataFrame) -> DataFrame:
    """Each section's last outline entry at or before its page: one sorted pass over the union of both.

    Of the entries on the section's page one whose title stands in its text wins over the page rule.
    """
    entry = F.struct("title", "level", "place")
    o = outline.select("doc_id", F.col("page").alias("at"), F.lit(0).alias("kind"), F.col("place"), entry.alias("entry"), F.lit(None).cast("string").alias("section_id"))
    s = sections.select("doc_id", F.col("page").alias("at"), F.lit(1).alias("kind"), F.col("ord").alias("place"), F.lit(None).cast(o.schema["entry"].dataType).alias("entry"), "section_id")
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "place").rowsBetween(Window.unboundedPreceding, 0)
    asof = o.unionByName(s).withColumn("found", F.last("entry", ignorenulls=True).over(w)).where("kind = 1").select("section_id", "doc_id", "found")
    here = outline.select("doc_id", "page", "place", entry.alias("entry"), tx.normalize_title(F.col("title")).alias("normal")).where("normal <> ''")
    named = sections.join(here, ["doc_id", "page"]).where(F.contains(tx.normalize_title(F.col("text")), F.col("normal"))).groupBy("section_id").agg(F.max_by("entry", here["place"]).alias("named"))
    return asof.join(named, "section_id", "left").select("section_id", "doc_id", F.coalesce("named", "found").alias("e")).select("section_id", "doc_id", "e.*")


def outline_parents(outline: DataFrame, levels: int = 6) -> DataFrame:
    """Nearest prior entry of a lower level: the last seen of each lower level, the latest of those."""
    w = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("place")), ignorenulls=True).over(w)) for k in range(1, levels)]
    return outline.withColumn("parent_place", F.greatest(*last))


def section_counters(sections: DataFrame) -> DataFrame:
    """Heading path carried forward, block counter within it, and the structure label."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("is_head"), F.substring("text", 1, 30))
    path = sections.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).withColumn("chapter_no", F.sum(F.col("is_head").cast("int")).over(w))
    blocks = path.withColumn("block_no", F.row_number().over(Window.partitionBy("doc_id", "chapter_no").orderBy("ord")))
    return blocks.withColumn("label", F.format_string("C%02d-P%03d", F.col("chapter_no").cast("int"), F.col("block_no")))


def page_windows(pages: DataFrame, size: int = 4, overlap: int = 2) -> DataFrame:
    """Sliding windows over pages: ids by a stride of ``size - overlap``, the last one clipped."""
    step = size - overlap
    spans = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    starts = spans.select("doc_id", "last", F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("last") - overlap, F.lit(1)), F.lit(step).cast("bigint"))).alias("window_index", "first"))
    return starts.select("doc_id", "window_index", "first", F.least(F.col("first") + size - 1, "last").alias("last"))


def char_ratio(a: Column, b: Column) -> Column:
    """Upper bound on sequence similarity: twice the shared characters (as multisets) over both lengths."""
    ca, cb = F.split(a, ""), F.split(b, "")
    shared = F.aggregate(F.array_distinct(ca), F.lit(0), lambda acc, ch: acc + F.least(F.size(F.filter(ca, lambda x: x == ch)), F.size(F.filter(cb, lambda x: x == ch))))
    return 2 * shared / (F.length(a) + F.length(b))


def alignment(segment: Column, window: Column, start: Column, end: Column) -> Column:
    """Confidence that a segment comes from its window: whole 1.0, both quotes 0.92, characters 0.82 or more."""
    ratio = char_ratio(segment, window)
    return F.when(F.contains(window, segment), 1.0).when(F.contains(window, start) & F.contains(window, end), 0.92).when(ratio >= 0.82, ratio).otherwise(0.0)


def structure_groups(roles: DataFrame) -> DataFrame:
    """Content goes to the nearest open group: the last context since the last structural block, else that
    structural block.  Two carried values; the context is reset by numbering structural runs."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((F.col("role") == "structural").cast("int")).over(w)
    told = roles.withColumn("run", run).withColumn("structural", F.last(F.when(F.col("role") == "structural", F.col("section_id")), ignorenulls=True).over(w))
    inner = Window.partitionBy("doc_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("context", F.last(F.when(F.col("role") == "context", F.col("section_id")), ignorenulls=True).over(inner))
    return told.withColumn("group_id", F.when(F.col("role").isin("noise", "front"), F.col("role")).when(F.col("role") == "structural", F.col("section_id")).otherwise(F.coalesce("context", "structural", F.lit("root"))))


def page_of_offset(sections: DataFrame, quotes: DataFrame) -> DataFrame:
    """The page of a character offset: running lengths give the pages' intervals, an equi-join on the
    document with a range condition finds the first that holds the offset."""
    lengths = sections.groupBy("doc_id", "page").agg(F.sum(F.length("text") + 1).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("page")
    spans = lengths.withColumn("stop", F.sum("n").over(w)).withColumn("start", F.col("stop") - F.col("n"))
    return quotes.join(spans, "doc_id").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("stop"))).groupBy("doc_id", "offset").agg(F.min("page").alias("page"))


def gate_reasons(stats: DataFrame) -> DataFrame:
    """Reasons for which a segmentation is refused; shares are compared in whole numbers, as 180 * 0.35 is below 63 in doubles."""
    r = lambda cond, name: F.when(cond, name)
    return stats.withColumn("reasons", F.array_compact(F.array(
        r(F.col("n_short") * 5 > F.col("n"), "short_blocks"), r(F.col("n") < F.col("n_pages") * 2, "few_paragraphs"), r(F.col("n_low") * 20 > F.col("n") * 7, "low_confidence"), r(F.col("longest") > 2000, "long_block"),
    )))


def unwrapped(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Printed page to body page: the modal offset of title matches, first seen on ties; others inferred."""
    hit = outline.join(pages, "doc_id").where((F.col("page") > F.col("toc_page")) & F.contains("body", "normal")).groupBy("doc_id", "place", "printed_page").agg(F.min("page").alias("matched"))
    offsets = hit.withColumn("shift", F.col("matched") - F.col("printed_page")).groupBy("doc_id", "shift").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    best = offsets.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).where("rn = 1").select("doc_id", "shift")
    told = outline.join(hit.select("doc_id", "place", "matched"), ["doc_id", "place"], "left").join(best, "doc_id", "left")
    return told.withColumn("body_page", F.coalesce("matched", F.col("printed_page") + F.col("shift"), F.lit(0))).withColumn("how", F.when(F.col("matched").isNotNull(), "matched").when(F.col("shift").isNotNull(), "inferred").otherwise("none"))


def html_elements(pages: DataFrame) -> DataFrame:
    """Typed elements of raw pages in document order: h1, p and li, tags inside removed."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<(?:h1|p|li)[^>]*>.*?</(?:h1|p|li)>"), F.lit(0))).alias("order_index", "raw"))
    kind = F.regexp_extract("raw", "^<(h1|p|li)", 1)
    return found.select("page_id", "order_index", F.when(kind == "h1", "heading").when(kind == "p", "paragraph").otherwise("list_item").alias("type"), F.btrim(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"))


# ---- queries ---------------------------------------------------------------------------------------

_OUTLINE = "SELECT doc_id, page, ord AS place, (1 + length(text) % 5)::BIGINT AS level, substr(text, 1, 30) AS title FROM sections WHERE is_head"


def outline(spark, sf) -> DataFrame:
    """The first line of every chapter; its level follows from its length, so that all levels occur."""
    s = views.sections(spark, sf).where("is_head")
    return s.select("doc_id", "page", F.col("ord").alias("place"), (1 + F.length("text") % 5).cast("long").alias("level"), F.substring("text", 1, 30).alias("title"))


def _normal_sql(title: str) -> str:
    """``tx.normalize_title`` in DuckDB."""
    t = f"replace({title}, '　', ' ')"
    for pattern, to in tx.TITLE_RULES:
        t = f"regexp_replace({t}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"lower(regexp_replace({t}, '[ \\t\\r\\n]+', '', 'g'))"


_PLACED = f"""SELECT s.section_id, s.doc_id, s.ord, coalesce(h.title, a.title) AS title, coalesce(h.level, a.level) AS level, coalesce(h.place, a.place) AS place FROM sections s
  LEFT JOIN (SELECT s.section_id, o.* FROM sections s JOIN ol o ON o.doc_id = s.doc_id AND o.page <= s.page QUALIFY row_number() OVER (PARTITION BY s.section_id ORDER BY o.page DESC, o.place DESC) = 1) a USING (section_id)
  LEFT JOIN (SELECT s.section_id, o.* FROM sections s JOIN ol o ON o.doc_id = s.doc_id AND o.page = s.page WHERE {_normal_sql('o.title')} <> '' AND contains({_normal_sql('s.text')}, {_normal_sql('o.title')})
    QUALIFY row_number() OVER (PARTITION BY s.section_id ORDER BY o.place DESC) = 1) h USING (section_id)"""


@query(oracle(f"SELECT section_id, doc_id, title, level, place FROM ({_PLACED})", ol=_OUTLINE))
def outline_asof(spark, sf):
    return asof_outline(views.sections(spark, sf), outline(spark, sf))


@query(oracle("SELECT doc_id, place, level, (SELECT max(p.place) FROM ol p WHERE p.doc_id = o.doc_id AND p.place < o.place AND p.level < o.level) AS parent_place FROM ol o", ol=_OUTLINE))
def outline_tree(spark, sf):
    return outline_parents(outline(spark, sf)).select("doc_id", "place", "level", "parent_place")


@query(oracle("""SELECT section_id, heading, 'C' || lpad(chapter::VARCHAR, 2, '0') || '-P' || lpad((ord - (chapter - 1) * 5)::VARCHAR, 3, '0') AS label FROM (SELECT *, first_value(substr(text, 1, 30)) OVER (PARTITION BY doc_id, chapter ORDER BY ord) AS heading FROM sections)"""))
def section_labels(spark, sf):
    return section_counters(views.sections(spark, sf)).select("section_id", "heading", "label")


@query(oracle("""SELECT doc_id, (first - 1) // 2 AS window_index, first, least(first + 3, last) AS last FROM (SELECT doc_id, last, unnest(range(1, greatest(last - 2, 1) + 1, 2)) AS first FROM (SELECT doc_id, max(page) AS last FROM sections GROUP BY 1))"""))
def sliding_windows(spark, sf):
    return page_windows(views.sections(spark, sf).select("doc_id", "page"))


_RATIO = "CASE WHEN contains(b, a) THEN 1.0::DOUBLE WHEN contains(b, left(t, 10)) AND contains(b, right(t, 10)) THEN 0.92::DOUBLE WHEN r >= 0.82 THEN r ELSE 0.0::DOUBLE END"


@query(oracle(f"""SELECT section_id, round({_RATIO}, 6) AS confidence FROM (SELECT section_id, t, a, b, 2.0::DOUBLE * list_sum(list_transform(list_distinct(string_split(a, '')), lambda ch: least(length(a) - length(replace(a, ch, '')), length(b) - length(replace(b, ch, ''))))) / (length(a) + length(b)) AS r
  FROM (SELECT section_id, text AS t, CASE ord % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 20) || 'x' || substr(text, 21) ELSE reverse(text) END AS a, CASE ord % 3 WHEN 2 THEN text ELSE page_text END AS b
    FROM (SELECT *, string_agg(text, '|') OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page_text FROM sections)))"""))
def segment_alignment(spark, sf):
    """Whole sections, a third of them changed and a third reversed, against their pages (the last against themselves)."""
    s, o = views.sections(spark, sf), F.col("ord")
    whole = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("page_text", F.array_join(F.collect_list("text").over(whole), "|"))
    a = F.when(o % 3 == 0, F.col("text")).when(o % 3 == 1, F.concat(F.substring("text", 1, 20), F.lit("x"), F.expr("substring(text, 21)"))).otherwise(F.reverse("text"))
    b = F.when(o % 3 == 2, F.col("text")).otherwise(F.col("page_text"))
    return s.select("section_id", "text", a.alias("a"), b.alias("b")).select("section_id", F.round(alignment(F.col("a"), F.col("b"), F.left("text", F.lit(10)), F.right("text", F.lit(10))), 6).alias("confidence"))


_JOINS = """(acc[-1].p = x[1].p AND x[1].p <> '' AND (length(acc[-1].t) < 50 OR length(x[1].t) < 50) AND length(acc[-1].t) + length(x[1].t) < 2000)"""
_GOES = f"""(acc[-1].p = '' AND x[1].p = '' AND length(acc[-1].t) >= 20 AND length(x[1].t) >= 20 AND length(acc[-1].t) + length(x[1].t) <= 800 AND NOT regexp_matches(right(acc[-1].t, 5), '{tx.SENTENCE_END}')
    AND NOT regexp_matches(x[1].t, '{layout.HEADING_START}') AND NOT (length(x[1].t) < 100 AND regexp_matches(x[1].t, '{layout.EXERCISE_START}')))"""


@query(oracle(f"""SELECT doc_id, f[i].o AS ord, f[i].n AS n_parts, f[i].t AS text FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM (
  SELECT doc_id, list_reduce(list([{{'t': text, 'n': 1::BIGINT, 'o': ord, 'p': path}}] ORDER BY ord), lambda acc, x: CASE WHEN {_JOINS} OR {_GOES}
    THEN list_concat(acc[:-2], [{{'t': acc[-1].t || CASE WHEN acc[-1].p = '' THEN chr(10) ELSE chr(10) || chr(10) END || x[1].t, 'n': acc[-1].n + 1, 'o': acc[-1].o, 'p': acc[-1].p}}]) ELSE list_concat(acc, x) END) AS f FROM cut GROUP BY doc_id))""",
  cut="SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN rtrim(text, '.') ELSE text END AS text, CASE WHEN chapter % 2 = 1 THEN 'chapter ' || chapter ELSE '' END AS path FROM sections"))
def stitched_paragraphs(spark, sf):
    s = views.sections(spark, sf)
    path = F.when(F.col("chapter") % 2 == 1, F.array(F.concat(F.lit("chapter "), "chapter"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    text = F.when(F.col("ord") % 3 == 0, F.rtrim("text", F.lit("."))).otherwise(F.col("text"))
    return layout.stitched(s.select("doc_id", "ord", path.alias("path"), text.alias("text"))).select("doc_id", "ord", "n_parts", "text")


def _either(words: tuple[str, ...]) -> str:
    return "'" + "|".join(words) + "'"


_ROLES = f"""SELECT section_id, doc_id, ord, CASE WHEN NOT is_head AND (length(text) < 3 OR regexp_matches(text, '^[0-9]{{1,4}}[ \\t]*$') OR regexp_matches(text, '{tx.PAGE_RANGE}') OR dense < 0.2) THEN 'noise'
  WHEN (place < 0.05 OR place > 0.95) AND (regexp_matches(text, '{tx.LEADERS_END}') OR regexp_matches(lower(text), {_either(tx.FRONT_HINTS)})) THEN 'front' WHEN is_head OR regexp_matches(text, '{tx.NUMBERING}') THEN 'structural'
  WHEN regexp_matches(text, '{tx.BULLET}') OR (length(text) < 40 AND dense < 0.6 AND regexp_matches(lower(text), {_either(tx.CONTEXT_HINTS)})) THEN 'context' ELSE 'content' END AS role
  FROM (SELECT *, (ord - 1)::DOUBLE / max(ord) OVER (PARTITION BY doc_id) AS place, length(regexp_replace(text, '[^一-鿿a-zA-Z0-9]', '', 'g'))::DOUBLE / length(text) AS dense FROM sections)"""
_GROUPS = """SELECT section_id, doc_id, role, CASE WHEN role IN ('noise', 'front') THEN role WHEN role = 'structural' THEN section_id ELSE coalesce(CASE WHEN c.o > coalesce(s.o, 0) THEN c.id END, s.id, 'root') END AS group_id FROM (
  SELECT *, last_value(CASE WHEN role = 'context' THEN {'id': section_id, 'o': ord} END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN role = 'structural' THEN {'id': section_id, 'o': ord} END IGNORE NULLS) OVER w AS s
  FROM roles WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def section_roles(sections: DataFrame) -> DataFrame:
    """Sections with the role that their text, place and level give them."""
    total = F.max("ord").over(Window.partitionBy("doc_id"))
    return sections.withColumn("total", total).withColumn("role", tx.block_role(F.col("text"), F.col("ord") - 1, F.col("total"), F.col("is_head").cast("int"))).drop("total")


@query(oracle("SELECT section_id, role, group_id FROM groups", roles=_ROLES, groups=_GROUPS))
def grouped_sections(spark, sf):
    return structure_groups(section_roles(views.sections(spark, sf))).select("section_id", "role", "group_id")


@query(oracle("""SELECT q.doc_id, q."offset", min(p.page) AS page FROM (SELECT doc_id, unnest([10, 250, 900]) AS "offset" FROM documents) q JOIN (SELECT doc_id, page, stop, stop - n AS start FROM (SELECT doc_id, page, n, sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS stop FROM (SELECT doc_id, page, sum(length(text) + 1) AS n FROM sections GROUP BY ALL))) p
  ON p.doc_id = q.doc_id AND q."offset" >= p.start AND q."offset" < p.stop GROUP BY ALL""").replace('q."offset", min', 'q."offset"::BIGINT AS "offset", min'))
def offset_pages(spark, sf):
    q = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(10), F.lit(250), F.lit(900))).alias("offset"))
    return page_of_offset(views.sections(spark, sf), q)


@query(oracle("""SELECT doc_id, n, array_to_string(list_filter([CASE WHEN n_short > n * 0.2 THEN 'short_blocks' END, CASE WHEN n < n_pages * 2 THEN 'few_paragraphs' END, CASE WHEN n_low > n * 0.35 THEN 'low_confidence' END, CASE WHEN longest > 2000 THEN 'long_block' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (length(text) < 50) AS n_short, count(DISTINCT (ord - 1) // 3) AS n_pages, count(*) FILTER (confidence < 0.6) AS n_low, max(length(text)) AS longest FROM blocks GROUP BY doc_id)"""))
def quality_gate(spark, sf):
    b = views.blocks(spark, sf)
    stats = b.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 50).alias("n_short"), F.countDistinct(F.floor((F.col("ord") - 1) / 3)).alias("n_pages"), F.count_if(F.col("confidence") < 0.6).alias("n_low"), F.max(F.length("text")).alias("longest"))
    return gate_reasons(stats).select("doc_id", "n", F.array_join("reasons", ",").alias("reasons"))


@query(oracle("""SELECT o.doc_id, o.place, coalesce(h.matched, o.printed_page + b.shift, 0) AS body_page, CASE WHEN h.matched IS NOT NULL THEN 'matched' WHEN b.shift IS NOT NULL THEN 'inferred' ELSE 'none' END AS how
  FROM toc o LEFT JOIN hit h USING (doc_id, place) LEFT JOIN best b USING (doc_id)""",
  toc="SELECT doc_id, ord AS place, page AS printed_page, 0 AS toc_page, CASE WHEN chapter % 3 = 0 THEN 'nowhere at all' ELSE lower(regexp_replace(substr(text, 1, 24), '[ \\t]+', '', 'g')) END AS normal FROM sections WHERE is_head",
  bodies="SELECT doc_id, page + 6 AS page, string_agg(lower(regexp_replace(text, '[ \\t]+', '', 'g')), '|' ORDER BY ord) AS body FROM sections GROUP BY ALL",
  hit="SELECT t.doc_id, t.place, t.printed_page, min(b.page) AS matched FROM toc t JOIN bodies b ON t.doc_id = b.doc_id AND b.page > t.toc_page AND contains(b.body, t.normal) GROUP BY ALL",
  best="SELECT doc_id, shift FROM (SELECT doc_id, matched - printed_page AS shift, count(*) AS n, min(place) AS first FROM hit GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1"))
def aligned_pages(spark, sf):
    s = views.sections(spark, sf)
    flat = lambda c: F.lower(F.regexp_replace(c, "[ \\t]+", ""))
    normal = F.when(F.col("chapter") % 3 == 0, "nowhere at all").otherwise(flat(F.substring("text", 1, 24)))
    toc = s.where("is_head").select("doc_id", F.col("ord").alias("place"), F.col("page").alias("printed_page"), F.lit(0).alias("toc_page"), normal.alias("normal"))
    body = s.groupBy("doc_id", (F.col("page") + 6).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", flat(F.col("text")).alias("t")))), lambda x: x["t"]), "|").alias("body"))
    return unwrapped(toc, body).select("doc_id", "place", "body_page", "how")


@query(r"""SELECT page_id, i - 1 AS order_index, CASE WHEN starts_with(raw, '<h1') THEN 'heading' WHEN starts_with(raw, '<p') THEN 'paragraph' ELSE 'list_item' END AS type, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS text
 FROM (SELECT page_id, unnest(m) AS raw, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h1|p|li)[^>]*>.*?</(?:h1|p|li)>') AS m FROM pages))""")
def page_elements(spark, sf):
    return html_elements(table(spark, sf, "pages"))


_INLINE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g')"
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_MD_TEXT = "'# Title ' || doc_id || chr(10) || text || chr(10) || 'more [link](u) and ![i](v)' || chr(10) || chr(10) || '## Second' || chr(10) || 'the end of it'"


@query(f"""WITH l AS (SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split({_MD_TEXT}, chr(10)) AS s FROM documents)),
 t AS (SELECT doc_id, pos, {_TRIM.format('raw')} AS line FROM l), f AS (SELECT *, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS inside FROM t),
 k AS (SELECT *, CASE WHEN NOT inside AND regexp_matches(line, '^#{{1,6}}[ \\t]+.+$') THEN 'heading' WHEN NOT inside AND line = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM f WHERE NOT fence),
 i AS (SELECT *, count(*) FILTER (kind <> 'paragraph') OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM k),
 e AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level, {_TRIM.format(_INLINE.format("regexp_replace(line, '^#{1,6}[ \\t]+', '')"))} AS text, true AS head FROM i WHERE kind = 'heading'
   UNION ALL SELECT doc_id, min(pos), 0, {_TRIM.format(_INLINE.format("replace(string_agg(line, chr(10) ORDER BY pos), '　', ' ')"))}, false FROM i WHERE kind = 'paragraph' GROUP BY doc_id, island)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS order_index, level, text FROM e
 WHERE CASE WHEN head THEN text <> '' ELSE length(text) >= 8 AND NOT regexp_matches(text, '^[-*_`~ \\t\\n]+$') AND NOT regexp_matches(text, '^[0-9]{{1,4}}$') END""")
def markdown_blocks(spark, sf):
    """Whole documents read as markdown, with a title before and a part after."""
    md = F.concat(F.lit("# Title "), "doc_id", F.lit("\n"), "text", F.lit("\nmore [link](u) and ![i](v)\n\n## Second\nthe end of it"))
    return layout.markdown_document(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", md.alias("text"))).select("doc_id", "order_index", "level", "text")


@query(oracle("""SELECT doc_id, content_hash, min(ord) AS kept FROM (SELECT s.doc_id, s.ord, sha256(lower(replace(s.text, ' ', ''))) AS content_hash FROM sections s JOIN (SELECT doc_id, unnest(range(1, greatest(last - 2, 1) + 1, 2)) AS first, last FROM (SELECT doc_id, max(page) AS last FROM sections GROUP BY 1)) w
  ON w.doc_id = s.doc_id AND s.page >= w.first AND s.page <= least(w.first + 3, w.last)) GROUP BY ALL"""))
def window_overlap_dedup(spark, sf):
    """Segments seen by several overlapping windows count once: first by hash inside a document."""
    s = views.sections(spark, sf)
    w = page_windows(s.select("doc_id", "page"))
    seen = w.select("doc_id", F.explode(F.sequence("first", "last")).alias("page")).join(s.select("doc_id", "page", "ord", "text"), ["doc_id", "page"])
    return seen.groupBy("doc_id", F.sha2(F.lower(F.replace("text", F.lit(" "), F.lit(""))), 256).alias("content_hash")).agg(F.min("ord").alias("kept"))


@query(oracle("""SELECT DISTINCT a.section_id AS inner_id FROM sections a JOIN sections b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.page >= a.page - 1 AND contains(b.text, a.text) AND length(a.text) < length(b.text) * 0.75
  WHERE length(a.text) >= 40 OR regexp_matches(a.text, '[。！？.!?]')"""))
def containment_candidates(spark, sf):
    """Segments that stand in an earlier, clearly longer segment of a nearby page; labels aside."""
    s = views.sections(spark, sf).select("section_id", "doc_id", "ord", "page", "text")
    near = F.explode(F.array(F.col("page"), F.col("page") + 1))  # an interval join as an equi-join on the pages that a segment reaches
    reach = s.select("doc_id", F.col("ord").alias("o"), F.col("text").alias("t"), near.alias("page"))
    inner = s.where((F.length("text") >= 40) | F.col("text").rlike("[。！？.!?]"))
    hits = inner.join(reach, ["doc_id", "page"]).where((F.col("o") < F.col("ord")) & (F.length("text") < F.length("t") * 0.75) & F.contains("t", F.col("text")))
    return hits.select(F.col("section_id").alias("inner_id")).distinct()
