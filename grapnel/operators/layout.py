"""From pages and markdown to elements, outlines and sections.

Order is data: every flow carries (document, ordinal), and what a reader would carry along is a window over
that order.  Only the refinement of order-only outlines takes one greedy pass a document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from grapnel.functions import text as tx

# Patterns, labels and limits that decide results.
DOTS_PAGE = r"\.{4,}[ \t]*[0-9]{1,4}[ \t]*$"
LEADING_DOTS = r"^\.{4,}"
ENDING_PAGE = r"[ \t]+[0-9]{1,4}[ \t]*$"
PAGE_ONLY = r"^[0-9]{1,4}$"
NUMBERED = rf"第[ \t]*[{tx.NUMERAL}]+[ \t]*[章节]"
TOC_TITLE = r"^目[ \t]*录$"
TOC_HIT = rf"[.…·•]{{2,}}[ \t]*[0-9]{{1,4}}[ \t]*$|第[ \t]*[{tx.NUMERAL}]+[ \t]*[章节].+[ \t]+[0-9]{{1,4}}[ \t]*$"
STRUCTURAL = rf"^第[ \t]*[{tx.NUMERAL}]+[ \t]*[章节篇部]"
RULE_LINE = r"^[-*_`~ \t\n]+$"
CONTENT_TYPES = ("paragraph", "list_item", "table", "caption", "unknown")
SIDE_ROLES = ("sidebar", "activity", "exercise")
NEVER_MERGED = ("目录", "前言", "编写说明", "参考文献", "附录", "后记", "注释", "简介")
HEADING_START = rf"^(第[ \t]*[{tx.NUMERAL}]+[ \t]*[章节]|思考|讨论|探究|活动|练习|复习|本章|小结|实验|第[{tx.NUMERAL}]+单元)"
EXERCISE_START = r"^[0-9①②③④⑤⑥⑦⑧⑨⑩]+[ \t]*[.、．)\s]"
MIN_PARAGRAPH, MIN_SECTION, LONG_TOC = 30, 20, 4000
OUTLINE_SCHEMA = "doc_id long, place int, title string, level int, body_page int"
LEGACY_CHAPTER = rf"^第[ \t]*([{tx.NUMERAL}]+)[ \t]*([章节])[ \t　]*(.+?)(?:[ \t]*\.{{2,}}.*)?$"


def _w(*order: str, by: tuple[str, ...] = ("doc_id",)):
    return Window.partitionBy(*by).orderBy(*order)


def _until(*order: str, by: tuple[str, ...] = ("doc_id",)):
    return _w(*order, by=by).rowsBetween(Window.unboundedPreceding, 0)


def _before(*order: str, by: tuple[str, ...] = ("doc_id",)):
    return _w(*order, by=by).rowsBetween(Window.unboundedPreceding, -1)


def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), tx.trimmed), lambda x: x != "")


def n_lines(text: Column, *patterns: str) -> Column:
    return F.size(F.filter(lines_of(text), lambda x: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(x, p))))


# ---- pages -----------------------------------------------------------------------------------------

def is_toc_page(text: Column) -> Column:
    """Eight contents-like lines or more, or three that make up 30 % of a page that names a chapter."""
    lines = lines_of(text)
    count = lambda f: F.size(F.filter(lines, f))
    total = count(lambda x: x.rlike(DOTS_PAGE)) + count(lambda x: x.rlike(LEADING_DOTS)) + count(lambda x: x.rlike(ENDING_PAGE) & (F.length(x) < 60))
    return (total >= 8) | ((total >= 3) & F.exists(lines, lambda x: x.rlike(NUMBERED)) & (total >= F.size(lines) * 0.3))


def is_cover_page(text: Column, page: Column) -> Column:
    return (page <= 4) & (F.length(F.translate(text, "  \n", "")) < 100)


def has_body_signal(text: Column) -> Column:
    """Three long lines or more on a page that is not made of short or contents-like lines."""
    lines = lines_of(text)
    like = F.size(F.filter(lines, lambda x: x.rlike(DOTS_PAGE) | x.rlike(LEADING_DOTS) | x.rlike(PAGE_ONLY) | (x.rlike(ENDING_PAGE) & x.rlike(NUMBERED))))
    total = F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x))
    long = F.size(F.filter(lines, lambda x: F.length(x) > 40))
    return (F.size(lines) > 0) & (total >= 25 * F.size(lines)) & (long >= 3) & (like < F.size(lines) * 0.15)


def page_classes(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) with ``kind``: blank, toc, cover, front or body, and ``body_start``.

    The body begins at the first page that looks like text and is neither contents nor cover; pages
    before it are front matter.
    """
    kind = F.when(F.length(tx.trimmed(F.col("text"))) < 20, "blank").when(is_toc_page(F.col("text")), "toc").when(is_cover_page(F.col("text"), F.col("page")), "cover").when(has_body_signal(F.col("text")), "body").otherwise("weak")
    told = pages.withColumn("kind", kind).withColumn("__first", F.min(F.when(F.col("kind") == "body", F.col("page"))).over(Window.partitionBy("doc_id")))
    front = F.col("kind").isin("body", "weak") & (F.col("__first").isNull() | (F.col("page") < F.col("__first")))
    body = F.col("kind").isin("body", "weak") & ~front
    return told.withColumn("kind", F.when(front, "front").when(body, "body").otherwise(F.col("kind"))).withColumn("body_start", F.coalesce("__first", F.lit(1))).drop("__first")


def toc_pages(pages: DataFrame, most: int = 20) -> DataFrame:
    """The contents pages: from the first with a contents title or two entries to before the next without any."""
    entries = n_lines(F.col("text"), tx.TOC_DOTS, tx.TOC_SPACED)
    told = pages.withColumn("place", F.row_number().over(_w("page"))).where(F.col("place") <= most)
    told = told.withColumns({"n_entries": entries, "opens": F.exists(lines_of(F.col("text")), lambda x: x.rlike(TOC_TITLE)) | (entries >= 2)})
    whole = Window.partitionBy("doc_id")
    told = told.withColumn("first", F.min(F.when(F.col("opens"), F.col("place"))).over(whole))
    told = told.withColumn("stop", F.min(F.when((F.col("place") > F.col("first")) & (F.col("n_entries") == 0) & ~F.col("opens"), F.col("place"))).over(whole))
    return told.where((F.col("place") >= F.col("first")) & (F.col("stop").isNull() | (F.col("place") < F.col("stop")))).select("doc_id", "page", "n_entries", "text")


def toc_entries(pages: DataFrame) -> DataFrame:
    """Parsed lines of the contents pages, the first of each (level, title, printed page)."""
    lines = toc_pages(pages).select("doc_id", F.col("page").alias("toc_page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parsed = lines.withColumn("e", tx.parse_toc_line(F.col("line"))).where("e IS NOT NULL").select("doc_id", "toc_page", "line_no", "e.*").withColumn("normal", tx.normalize_title(F.col("title")))
    first = Window.partitionBy("doc_id", "level", "normal", "printed_page").orderBy("toc_page", "line_no")
    kept = parsed.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    return kept.withColumn("place", F.row_number().over(_w("toc_page", "line_no")))


def is_rule_heading(text: Column) -> Column:
    """A short text of two lines at most that names a chapter or section."""
    t = tx.trimmed(text)
    head = F.substring(t, 1, 6)
    near = F.contains(head, F.lit("节")) | F.contains(head, F.lit("章")) | F.contains(head, F.lit("探究"))
    return (F.length(text) <= 120) & (F.size(F.split(t, "\n")) <= 2) & (t.rlike(NUMBERED) | F.startswith(t, F.lit("第")) | ((F.length(t) < 40) & near))


def rule_paragraphs(pages: DataFrame, least: int = MIN_PARAGRAPH) -> DataFrame:
    """Paragraphs of the body pages as one running text: blank lines part blocks, inside a block a line with
    more than six CJK characters goes on with the line before.  (doc_id, order_index, type, page, text)."""
    body = page_classes(pages).where("kind = 'body'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"), F.first("body_start").alias("body_start"))
    # pages are joined by one blank, so a line can go on over a page's end
    joined = body.select("doc_id", "body_start", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("t"), F.transform("p", lambda x: F.struct(x["page"], F.length(x["text"]).alias("n"))).alias("sizes"))
    lines = joined.select("doc_id", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(_before("line_no")), F.lit(0)))
    lines = lines.withColumn("line", tx.trimmed(F.regexp_replace("line", " {2,}", " ")))
    blocks = lines.withColumn("block", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(_until("line_no"))).where("line <> ''")
    size = Window.partitionBy("doc_id", "block")
    blocks = blocks.withColumn("n", F.sum(F.length("line") + 1).over(size) - 1).where(F.col("n") >= least)
    cjk = F.length(F.regexp_replace("line", "[^一-鿿]", ""))
    opens = (F.row_number().over(_w("line_no", by=("doc_id", "block"))) == 1) | (cjk <= 6)
    islands = blocks.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(_until("line_no")))
    made = islands.groupBy("doc_id", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("text"), F.min("at").alias("at"))
    like = (F.length("text") < 100) & (F.col("text").rlike(DOTS_PAGE) | F.col("text").rlike(LEADING_DOTS))
    kept = made.where((F.length("text") >= least) & ~like)
    spans = joined.select("doc_id", "body_start", F.posexplode("sizes").alias("i", "s")).select("doc_id", "body_start", "i", "s.page", "s.n")
    spans = spans.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(_before("i")), F.lit(0)))
    at = kept.select("doc_id", "island", "text", "at", F.lit(None).cast("long").alias("page")).unionByName(spans.select("doc_id", F.lit(None).cast("long").alias("island"), F.lit(None).cast("string").alias("text"), F.col("start").alias("at"), F.col("page").cast("long").alias("page")))
    placed = at.withColumn("found", F.last("page", ignorenulls=True).over(_w("at", F.col("page").isNull()).rowsBetween(Window.unboundedPreceding, 0))).where("text IS NOT NULL")
    return placed.select("doc_id", F.row_number().over(_w("island")).alias("order_index"), F.when(is_rule_heading(F.col("text")), "heading").otherwise("paragraph").alias("type"), F.col("found").alias("page"), "text")


# ---- markdown --------------------------------------------------------------------------------------

def clean_inline(text: Column) -> Column:
    """Images and tags go, links leave their words, blanks collapse."""
    for pattern, to in ((r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), ("<[^>]+>", ""), ("　", " "), ("[ \\t]+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return tx.trimmed(text)


def strip_markdown(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: clean_inline(F.regexp_replace(tx.trimmed(x), "^#{1,6}[ \\t]+", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def is_markdown_noise(text: Column) -> Column:
    """Under 8 characters, a rule, or a bare number."""
    t = tx.trimmed(text)
    return (F.length(t) < 8) | t.rlike(RULE_LINE) | t.rlike(PAGE_ONLY)


def is_toc_heading(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t　]+", "").isin("目录", "目錄")


def is_toc_block(text: Column) -> Column:
    return n_lines(text, TOC_HIT) >= 1


def is_real_toc(text: Column) -> Column:
    """A line that says contents, or a contents line in a text of under 4,000 characters."""
    named = F.exists(lines_of(text), lambda x: x.isin("目录", "目 录", "目　录"))
    return named | ((n_lines(text, TOC_HIT) >= 1) & (F.length(text) < LONG_TOC))


def is_partial_toc(text: Column) -> Column:
    t = tx.trimmed(text)
    head = F.substring(t, 1, 10)
    return (F.length(t) >= 10) & (F.contains(head, F.lit("目录")) | F.contains(head, F.lit("目 录")) | ((n_lines(t, TOC_HIT) >= 1) & (F.length(t) < LONG_TOC)))


def markdown_document(texts: DataFrame) -> DataFrame:
    """Markdown (doc_id, text) to elements (doc_id, order_index, type, level, text, role).

    A contents paragraph is one with contents lines that stands in a contents zone: since the last chapter
    heading there was a contents heading, or such a paragraph while the document was still at its front (no
    element yet, or at most 40 and a contents heading among the first eight).
    """
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", tx.trimmed(F.col("raw"))).drop("raw")
    fence = F.startswith("line", F.lit("```"))
    lines = lines.withColumn("inside", (F.sum(fence.cast("int")).over(_until("pos")) % 2 == 1) & ~fence).where(~fence)
    is_heading = ~F.col("inside") & F.col("line").rlike("^#{1,6}[ \\t]+.+$")
    lines = lines.withColumn("kind", F.when(is_heading, "heading").when(~F.col("inside") & (F.col("line") == ""), "blank").otherwise("paragraph"))
    lines = lines.withColumn("island", F.sum(F.when(F.col("kind") != "paragraph", 1).otherwise(0)).over(_until("pos")))
    heads = lines.where("kind = 'heading'").select("doc_id", "pos", F.lit("heading").alias("type"), F.length(F.regexp_extract("line", "^(#{1,6})", 1)).alias("level"), clean_inline(F.regexp_replace("line", "^#{1,6}[ \\t]+", "")).alias("text")).where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    paras = lines.where("kind = 'paragraph'").groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), joined.alias("text")).select("doc_id", "pos", F.lit("paragraph").alias("type"), F.lit(0).alias("level"), clean_inline(F.col("text")).alias("text"))
    e = heads.unionByName(paras.where((F.col("text") != "") & ~is_markdown_noise(F.col("text")))).withColumn("order_index", F.row_number().over(_w("pos")))
    heading, toc_head = F.col("type") == "heading", (F.col("type") == "heading") & is_toc_heading(F.col("text"))
    e = e.withColumns({
        "segment": F.sum(F.when(heading & ~toc_head & F.col("text").rlike(STRUCTURAL), 1).otherwise(0)).over(_until("pos")),
        "head_no": F.sum(heading.cast("int")).over(_until("pos")), "looks": ~heading & is_toc_block(F.col("text")), "toc_head": toc_head,
    })
    e = e.withColumn("front_head", F.max((F.col("toc_head") & (F.col("head_no") <= 8)).cast("int")).over(_before("pos")))
    zone = (F.col("order_index") == 1) | ((F.col("order_index") <= 41) & (F.col("front_head") == 1))
    e = e.withColumn("opens", F.coalesce(F.col("toc_head") | (F.col("looks") & zone), F.lit(False)).cast("int"))
    e = e.withColumn("toc", F.col("looks") & (F.max("opens").over(_until("pos", by=("doc_id", "segment"))) == 1))
    return e.select("doc_id", "order_index", F.when(F.col("toc"), "toc").otherwise(F.col("type")).alias("type"), "level", "text", F.when(F.col("toc"), "toc").when(heading, "heading").otherwise("body").alias("role"))


def match_key(title: Column) -> Column:
    """A title without blanks, dots and dashes."""
    return F.regexp_replace(title, "[ \\t\\r\\n　.\\-·•]+", "")


def is_pseudo_heading(title: Column) -> Column:
    """Activity and sidebar labels, and numbered questions."""
    t = tx.trimmed(title)
    return t.isin(*tx.PSEUDO_TITLES) | t.rlike("^[一二三四五六七八九十]+[、，．.][ \\t]*.+$")


def markdown_outline(elements: DataFrame) -> DataFrame:
    """(doc_id, place, title, level, body_page, printed_page, confidence): the outline in element order.

    With contents blocks: their lines, tied to the heading of the same name; a line without one hangs on
    the last that had one, and is left out if it names no page and nothing was tied yet.  Without: the
    structural headings.
    """
    role = lambda e: tx.heading_role(e["text"], e["level"], F.lit(False))
    heads = elements.where("type = 'heading'").withColumn("hrole", role({"text": F.col("text"), "level": F.col("level")}))
    structural = heads.where(F.col("hrole").isin("structural_heading", "toc_entry"))
    named = structural.withColumn("key", match_key(F.col("text"))).groupBy("doc_id", "key").agg(F.max(F.struct("order_index", "text")).alias("h"))
    lines = elements.where("type = 'toc'").select("doc_id", "order_index", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length(tx.trimmed(F.col("line"))) >= 4)
    parsed = lines.withColumn("e", tx.parse_toc_line(F.col("line"))).where("e IS NOT NULL").select("doc_id", "order_index", "line_no", "e.*").withColumn("entry", F.row_number().over(_w("order_index", "line_no")))
    good = parsed.where(tx.heading_role(F.col("title"), F.col("level"), F.lit(False)).isin("structural_heading", "toc_entry")).withColumn("key", match_key(F.col("title")))
    tied = good.join(named, ["doc_id", "key"], "left").withColumn("last", F.last("h.order_index", ignorenulls=True).over(_until("entry")))
    tied = tied.where(F.col("h").isNotNull() | F.col("last").isNotNull() | (F.col("printed_page") > 0))
    from_toc = tied.select("doc_id", F.col("entry").alias("place"), F.coalesce("h.text", "title").alias("title"), "level", F.coalesce("last", F.col("entry")).alias("body_page"), "printed_page", F.when(F.col("h").isNotNull(), 0.9).otherwise(0.45).alias("confidence"))
    has_toc = elements.where("type = 'toc'").select("doc_id").distinct()
    bare = structural.join(has_toc, "doc_id", "left_anti").select("doc_id", F.col("order_index").alias("place"), F.col("text").alias("title"), F.greatest("level", F.lit(1)).alias("level"), F.col("order_index").alias("body_page"), F.lit(0).alias("printed_page"), F.lit(0.95).alias("confidence"))
    return from_toc.unionByName(bare)


def document_report(elements: DataFrame, outline: DataFrame) -> DataFrame:
    """One row a document: counts, mean paragraph length, whether its structure needs review."""
    p = F.col("type") == "paragraph"
    e = elements.groupBy("doc_id").agg(F.count("*").alias("total_elements"), F.count_if(p).alias("paragraph_count"), F.count_if(F.col("type") == "heading").alias("heading_count"), F.round(F.coalesce(F.avg(F.when(p, F.length("text"))), F.lit(0.0)), 1).alias("average_paragraph_length"))
    o = outline.groupBy("doc_id").agg(F.count("*").alias("toc_entry_count"))
    return e.join(o, "doc_id", "left").withColumns({"toc_entry_count": F.coalesce("toc_entry_count", F.lit(0)), "needs_structure_review": F.col("paragraph_count") < 10})


# ---- elements to sections --------------------------------------------------------------------------

def heading_level(text: Column, level: Column) -> Column:
    t = tx.trimmed(text)
    return F.when(level > 0, level).when(t.rlike(rf"^第[ \t]*[{tx.NUMERAL}]+[ \t]*章"), 1).otherwise(2)


def element_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(tx.strip_page_number(text), "[ \\t]+", " "), "\n{3,}", "\n\n")


def reserved_label(type_: Column, role: Column, text: Column) -> Column:
    """The label of contents, preface and compile note elements, else an empty string."""
    head, longer = F.substring(text, 1, 80), F.substring(text, 1, 120)
    return (
        F.when(((type_ == "toc") | (role == "toc")) & is_real_toc(text), "目录").when((role == "front_matter") & F.contains(head, F.lit("前言")), "前言")
        .when((role == "front_matter") & F.contains(head, F.lit("编写")) & F.contains(longer, F.lit("说明")), "编写说明").otherwise("")
    )


def sections_from_elements(elements: DataFrame, least: int = MIN_SECTION) -> DataFrame:
    """Elements (doc_id, order_index, type, level, text, role, page) to sections in order.

    Headings give the path (chapter, then the last heading below it) and the counters; headings that only
    label what follows (activities, decoration, front matter) are the heading of the next section and of no
    other.  Where a document has headings, text before the first is left out.  A heading that names a special
    part (preface, references, ...) puts its label in the place of the whole path once text follows it.
    """
    e = elements.withColumn("text", element_text(F.col("text"))).where("text <> ''")
    e = e.withColumns({"label": reserved_label(F.col("type"), F.col("role"), F.col("text")), "hlevel": heading_level(F.col("text"), F.col("level"))})
    reserved = F.col("label") != ""
    e = e.where(reserved | ~((F.col("type") == "toc") | F.col("role").isin("toc", "front_matter", *SIDE_ROLES)))
    heading = ~reserved & F.col("type").isin("title", "heading")
    hrole = tx.heading_role(F.col("text"), F.col("hlevel"), F.lit(False))
    e = e.withColumn("kind", F.when(reserved, F.when(F.length("text") >= 6, "reserved")).when(heading, F.when(hrole.isin("context_heading", "decorative", "front_matter", "noise"), "context").otherwise("structural")).when(F.col("type").isin(*CONTENT_TYPES) & (F.length("text") >= least), "content")).where("kind IS NOT NULL")
    any_head = F.max(F.col("kind").isin("structural", "context").cast("int")).over(Window.partitionBy("doc_id"))
    w = _until("order_index")
    structural = F.col("kind") == "structural"
    e = e.withColumns({"any_head": any_head, "n_heads": F.sum(structural.cast("int")).over(w), "n_chapters": F.sum((structural & (F.col("hlevel") <= 1)).cast("int")).over(w)})
    content = F.col("kind") == "content"
    # texts before the first heading go, but a label that stood before them is theirs and goes with them
    e = e.withColumn("run", F.coalesce(F.sum(content.cast("int")).over(_before("order_index")), F.lit(0)))
    e = e.where(~(content & (F.col("any_head") == 1) & (F.col("n_heads") == 0)))
    e = e.withColumns({
        "context": F.last(F.when(F.col("kind") == "context", F.col("text")), ignorenulls=True).over(_until("order_index", by=("doc_id", "run"))),
        "current": F.last(F.when(structural, F.col("text")), ignorenulls=True).over(w),
    })
    special = F.when(content, tx.special_block(F.col("text"), F.coalesce("current", F.lit("")))).otherwise("")
    e = e.withColumn("special", special)
    # without headings the first special text labels all that follows
    first_label = F.first(F.when(content & (F.col("special") != "") & (F.col("n_heads") == 0), F.col("special")), ignorenulls=True).over(w)
    e = e.withColumn("special", F.when(content & (F.col("n_heads") == 0), F.coalesce(first_label, F.lit(""))).otherwise(F.col("special")))
    labelled = content & (F.col("special") != "")
    first_sub = structural & (F.col("hlevel") > 1) & (F.col("n_heads") == 1)
    root = F.when((structural & (F.col("hlevel") <= 1)) | first_sub, F.col("text")).when(labelled, F.col("special"))
    leaf = F.when(root.isNotNull(), F.struct(F.lit(None).cast("string").alias("t"))).when(structural, F.struct(F.col("text").alias("t")))
    e = e.withColumns({"root": F.last(root, ignorenulls=True).over(w), "leaf": F.last(leaf, ignorenulls=True).over(w)["t"]})
    e = e.withColumn("section_index", F.sum((structural & (F.col("hlevel") > 1)).cast("int")).over(_until("order_index", by=("doc_id", "n_chapters"))))
    s = e.where("kind IN ('content', 'reserved')").withColumn("ord", F.row_number().over(_w("order_index")))
    inner = F.row_number().over(_w("order_index", by=("doc_id", "n_heads", "kind")))
    is_reserved = F.col("kind") == "reserved"
    path = F.when(is_reserved, F.array("label")).otherwise(F.array_compact(F.array("root", "leaf")))
    title = F.when(is_reserved, F.col("label")).when(F.size("path") > 0, F.substring(F.element_at("path", -1), 1, 80)).otherwise(tx.first_sentence(F.col("text")))
    s = s.withColumns({"path": path, "block_index": F.when(is_reserved, F.col("ord")).otherwise(inner)}).withColumn("display_title", title)
    s = s.withColumn("heading", F.substring(F.when(is_reserved, F.col("label")).otherwise(F.coalesce("context", "display_title")), 1, 80))
    chapter, section = (F.when(is_reserved, 0).otherwise(F.coalesce(F.col(c), F.lit(0))) for c in ("n_chapters", "section_index"))
    return s.select("doc_id", "ord", "heading", "path", "display_title", chapter.cast("int").alias("chapter_index"), section.cast("int").alias("section_index"), F.col("block_index").cast("int").alias("block_index"), F.when(is_reserved, 1.0).when(F.size("path") > 0, 0.8).otherwise(0.3).alias("heading_confidence"), "page", "text")


def structure_label(chapter: Column, section: Column, block: Column, ord_: Column) -> Column:
    return F.when(chapter > 0, F.format_string("C%02d-S%02d-P%03d", chapter, section, block)).otherwise(F.format_string("P%03d", ord_))


def recovered_toc(elements: DataFrame) -> DataFrame:
    """One contents section a document from its contents and front matter blocks: all of them if together
    they are a contents list, else those that look like part of one."""
    blocks = elements.where((F.col("type") == "toc") | F.col("role").isin("toc", "front_matter"))
    entry = F.struct("order_index", "text")
    text_of = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: tx.trimmed(x["text"])), "\n\n")
    all_of = text_of(F.collect_list(F.when(F.length(tx.trimmed(F.col("text"))) >= 6, entry)))
    part_of = text_of(F.collect_list(F.when(is_partial_toc(F.col("text")), entry)))
    made = blocks.groupBy("doc_id").agg(all_of.alias("whole"), part_of.alias("part"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    real = (F.col("whole") != "") & is_real_toc(F.col("whole"))
    return made.select("doc_id", F.lit("目录").alias("heading"), F.when(real, "collected").otherwise("partial").alias("how"), "page_start", "page_end", F.when(real, F.col("whole")).otherwise(F.col("part")).alias("text")).where("text <> ''")


def stitched(sections: DataFrame) -> DataFrame:
    """Neighbouring sections (doc_id, ord, path, text) that are one paragraph, joined.

    Two of one path if either is under 50 characters and both together under 2,000; two without a path if
    both have 20 and together at most 800, the first doesn't end a sentence and the second doesn't begin
    a heading or an exercise.  A grown section is looked at again.  The fold carries lengths only; texts
    are joined once, at the end.
    """
    t = tx.trimmed(F.col("text"))
    starts = t.rlike(HEADING_START) | (t.rlike(EXERCISE_START) & (F.length(t) < 100))
    facts = F.struct("ord", F.length(t).alias("n"), F.substring(t, -5, 5).rlike(tx.SENTENCE_END).alias("ends"), starts.alias("starts"), F.array_join("path", "\x00").alias("path"), F.coalesce(F.get("path", F.lit(0)).isin(*NEVER_MERGED), F.lit(False)).alias("fixed"))
    docs = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(facts)).alias("f"))

    def step(acc: Column, x: Column) -> Column:
        short = (acc["path"] == x["path"]) & (x["path"] != "") & ((acc["n"] < 50) | (x["n"] < 50)) & (acc["n"] + x["n"] < 2000)
        goes_on = (acc["path"] == "") & (x["path"] == "") & (acc["n"] >= 20) & (x["n"] >= 20) & (acc["n"] + x["n"] <= 800) & ~acc["ends"] & ~x["starts"]
        joins = (acc["first"] >= 0) & ~acc["fixed"] & ~x["fixed"] & (short | goes_on)
        first = F.when(joins, acc["first"]).otherwise(x["ord"].cast("long"))
        n = F.when(joins, acc["n"] + x["n"] + F.when(short, 2).otherwise(1)).otherwise(x["n"])
        row = F.struct(x["ord"].alias("ord"), first.alias("first"), (joins & short).alias("gap"))
        return F.struct(first.alias("first"), n.alias("n"), x["ends"].alias("ends"), x["path"].alias("path"), x["fixed"].alias("fixed"), F.concat(acc["out"], F.array(row)).alias("out"))

    kind = sections.schema["ord"].dataType.simpleString()
    zero = F.struct(F.lit(-1).cast("long").alias("first"), F.lit(0).alias("n"), F.lit(False).alias("ends"), F.lit("").alias("path"), F.lit(False).alias("fixed"), F.expr(f"CAST(array() AS array<struct<ord:{kind},first:bigint,gap:boolean>>)").alias("out"))
    told = docs.select("doc_id", F.inline(F.aggregate("f", zero, step)["out"]))
    grown = sections.join(told, ["doc_id", "ord"])
    part = F.struct("ord", "gap", t.alias("t"))
    text = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(""), lambda a, x: F.when(a == "", x["t"]).otherwise(F.concat(a, F.when(x["gap"], F.lit("\n\n")).otherwise(F.lit("\n")), x["t"])))
    return grown.groupBy("doc_id", F.col("first").alias("ord")).agg(F.min_by("path", "ord").alias("path"), F.count("*").alias("n_parts"), text.alias("text"))


# ---- outlines --------------------------------------------------------------------------------------

def outline_by_page(sections: DataFrame, outline: DataFrame) -> DataFrame:
    """Sections (doc_id, ord, page, text) with the active entry of an outline (doc_id, place, title, level, body_page).

    The last entry at or before the section's page; of the entries on that page one whose title stands in
    the text wins.  The path begins with the last chapter at or before the entry's page.
    """
    o = outline.withColumn("rank", F.row_number().over(_w("body_page", "level", "title")))
    entry = F.struct("rank", "title", "level", "body_page")
    both = sections.select("doc_id", F.col("page").alias("at"), F.lit(1).alias("kind"), "ord", F.lit(None).cast("int").alias("rank"), F.lit(None).alias("entry")).unionByName(
        o.select("doc_id", F.col("body_page").alias("at"), F.lit(0).alias("kind"), F.lit(None).alias("ord"), "rank", entry.alias("entry")), allowMissingColumns=True
    )
    w = _w("at", "kind", "rank").rowsBetween(Window.unboundedPreceding, 0)
    asof = both.withColumn("last", F.last("entry", ignorenulls=True).over(w)).where("kind = 1").select("doc_id", "ord", "last")
    here = o.select("doc_id", F.col("body_page").alias("page"), entry.alias("here"), tx.normalize_title(F.col("title")).alias("normal")).where("normal <> ''")
    named = sections.join(here, ["doc_id", "page"]).where(F.contains(tx.normalize_title(F.col("text")), F.col("normal"))).groupBy("doc_id", "ord").agg(F.max("here").alias("same_page"))
    found = sections.join(asof, ["doc_id", "ord"]).join(named, ["doc_id", "ord"], "left").withColumn("entry", F.coalesce("same_page", "last"))
    return _with_chapter(found, o)


def outline_by_order(sections: DataFrame, outline: DataFrame) -> DataFrame:
    """The same for documents without pages: the entry's place is an order index."""
    return outline_by_page(sections.withColumn("page", F.col("ord")).withColumn("text", F.lit("")), outline).drop("page", "text")


def _with_chapter(found: DataFrame, o: DataFrame) -> DataFrame:
    """The last chapter at or before the page of each entry, and the path of both."""
    w = Window.partitionBy("doc_id").orderBy("body_page").rangeBetween(Window.unboundedPreceding, 0)
    chapters = o.withColumn("chapter", F.max(F.when(F.col("level") <= 1, F.struct("rank", "title"))).over(w)).select("doc_id", "rank", "chapter")
    numbers = o.where("level <= 1").select("doc_id", F.col("rank").alias("__chapter"), F.row_number().over(_w("rank")).alias("chapter_no"))
    told = found.withColumn("rank", F.col("entry.rank")).join(chapters, ["doc_id", "rank"], "left").withColumn("__chapter", F.col("chapter.rank")).join(numbers, ["doc_id", "__chapter"], "left")
    own = F.col("chapter.rank") != F.col("rank")
    path = F.when(F.col("rank").isNull(), F.expr("CAST(array() AS array<string>)")).when(own & ~((F.col("entry.level") <= 1) & (F.col("chapter.title") == F.col("entry.title"))), F.array("chapter.title", "entry.title")).otherwise(F.array("entry.title"))
    kept = [c for c in found.columns if c not in ("last", "same_page", "entry", "rank")]
    return told.withColumn("outline_path", path).select(*kept, F.col("entry.title").alias("anchor"), F.col("entry.level").alias("anchor_level"), F.coalesce("chapter_no", F.lit(0)).alias("chapter_no"), "outline_path")


def is_order_only(outline: DataFrame) -> DataFrame:
    """Documents whose outline has one position at most: no real pages."""
    return outline.groupBy("doc_id").agg((F.countDistinct("body_page") <= 1).alias("order_only"))


def search_keys(title: str) -> list[str]:
    """What of a title to look for, the longest first: its core, what follows a genitive, its parts, ASCII words."""
    import re

    core = re.sub(rf"^第[{tx.NUMERAL}]+[章节篇部]|^(?:chapter|section|part)[0-9ivx]+", "", title).strip()
    if not core:
        return []
    keys = [core, *re.findall(r"[a-z0-9]{2,}", core)]
    keys += [p.strip() for p in re.split(r"[和与及、/（）()《》“”\"'·\-]+", core) if len(p.strip()) >= 2]
    rest = core.partition("的")[2]
    keys += [rest] * (len(rest) >= 3) + [core[2:]] * (core.startswith("细胞") and len(core) > 4)
    return sorted(dict.fromkeys(k for k in keys if len(k) >= 2), key=len, reverse=True)


def refine_order_outline(outline: DataFrame, sections: DataFrame) -> DataFrame:
    """Order-only outlines pulled back to where their titles stand in the sections.

    Only where an entry lies beyond the last section.  Entries below chapters take, one after the other, the
    best later section (title hits before text hits, longer keys first), chapters then the place before
    their first child, and places never fall.  One greedy pass a document, in Arrow groups.
    """
    texts = sections.select("doc_id", F.col("ord").cast("int").alias("ord"), tx.normalize_title(F.concat_ws(" ", "heading", "display_title")).alias("head"), tx.normalize_title(F.substring("text", 1, 400)).alias("body"))
    rows = outline.select("doc_id", F.lit(0).alias("what"), F.col("place").cast("int").alias("place"), "title", tx.normalize_title(F.col("title")).alias("a"), F.col("level").cast("int").alias("level"), F.col("body_page").cast("int").alias("body_page")).unionByName(
        texts.select("doc_id", F.lit(1).alias("what"), F.col("ord").alias("place"), F.col("body").alias("title"), F.col("head").alias("a"), F.lit(0).alias("level"), F.lit(0).alias("body_page"))
    )

    def refine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        entries = group[group["what"] == 0].sort_values(["place", "level", "title"]).reset_index(drop=True)
        seen = group[group["what"] == 1].sort_values("place")
        out = pd.DataFrame({"doc_id": entries["doc_id"], "place": entries["place"], "title": entries["title"], "level": entries["level"], "body_page": entries["body_page"]})
        if len(entries) and len(seen) and entries["body_page"].max() > seen["place"].max():
            out["body_page"] = _settled(list(zip(entries["a"], entries["level"], entries["body_page"])), list(zip(seen["place"], seen["a"], seen["title"])))
        return out

    return rows.groupBy("doc_id").applyInPandas(refine, OUTLINE_SCHEMA)


def _settled(entries: list[tuple[str, int, int]], texts: list[tuple[int, str, str]]) -> list[int]:
    at, last = [int(b) for _, _, b in entries], 0
    for i, (title, level, _) in enumerate(entries):
        if level < 2:
            continue
        keys, best = search_keys(title), (0, 0)
        for order, head, body in texts:
            if order > last:
                score = max([100 + len(k) if k in head else len(k) if k in body else 0 for k in keys], default=0)
                if score > best[0]:
                    best = (score, order)
                if score >= 104:
                    break
        found = best[1] or next((order for order, _, _ in texts if order > last), 0)
        if found and (not at[i] or at[i] > found):
            at[i] = int(found)
        last = at[i] = max(at[i] or 1, last + 1)
    for i, (_, level, _) in enumerate(entries):
        if level <= 1:
            end = next((j for j in range(i + 1, len(entries)) if entries[j][1] <= level), len(entries))
            if children := at[i + 1 : end]:
                at[i] = min(at[i] or min(children), max(0, min(children) - 1))
    before, above = -1, 0
    for i, (_, level, _) in enumerate(entries):
        if at[i] < before or (at[i] == before and level <= above):
            at[i] = before + 1
        before, above = at[i], level
    return at


def legacy_toc(pages: DataFrame) -> DataFrame:
    """Chapter and section lines that end in a page number, first of each chapter: (doc_id, place, level, title, page)."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("no", "raw")).withColumn("line", tx.trimmed(F.col("raw")))
    number = F.coalesce(F.nullif(F.regexp_extract("line", r"\.{2,}[ \t]*([0-9]+)[ \t]*$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"[ \t]+([0-9]{1,3})[ \t]*$", 1), F.lit(""))).cast("int")
    named = lines.where(F.col("line").rlike(LEGACY_CHAPTER)).select("doc_id", "page", "no", F.when(F.regexp_extract("line", LEGACY_CHAPTER, 2) == "章", 1).otherwise(2).alias("level"), F.concat(F.lit("第"), F.regexp_extract("line", LEGACY_CHAPTER, 1), F.regexp_extract("line", LEGACY_CHAPTER, 2), F.lit(" "), tx.trimmed(F.regexp_extract("line", LEGACY_CHAPTER, 3))).alias("title"), number.alias("printed")).where("printed > 0 AND printed < 300")
    first = Window.partitionBy("doc_id", "level", "title").orderBy("page", "no")
    kept = named.withColumn("rn", F.row_number().over(first)).where("rn = 1 OR level = 2")
    return kept.select("doc_id", F.row_number().over(_w("page", "no")).alias("place"), "level", "title", "printed")


def legacy_labels(blocks: DataFrame, toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, page) with a heading path from a contents list.

    A title's body page is the second page that holds its first eight characters (the first is the contents
    page), or the only one.  Pages before the first body page are front matter; after it the last chapter
    and the last section of that chapter count.
    """
    bare = lambda c: F.regexp_replace(c, "[ 　\n]+", "")
    keyed = toc.withColumn("key", bare(F.substring("title", 1, 8)))
    hits = keyed.join(pages.select("doc_id", "page", bare(F.col("text")).alias("flat")), "doc_id").where(F.contains("flat", F.col("key"))).groupBy("doc_id", "place", "level", "title").agg(F.array_sort(F.collect_set("page")).alias("p"))
    found = hits.select("doc_id", "place", "level", "title", F.coalesce(F.get("p", F.lit(1)), F.get("p", F.lit(0))).alias("body_page"))
    starts = found.groupBy("doc_id").agg(F.min("body_page").alias("first_page"))
    both = blocks.select("doc_id", F.col("page").alias("at"), F.lit(1).alias("kind"), "ord", F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title")).unionByName(
        found.select("doc_id", F.col("body_page").alias("at"), F.lit(0).alias("kind"), F.lit(None).alias("ord"), "place", "level", "title")
    )
    w = _w("at", "kind", "place").rowsBetween(Window.unboundedPreceding, 0)
    # of all chapters that have begun the one listed last counts
    chapter = F.max(F.when(F.col("level") == 1, F.struct("place", "title", "at"))).over(w)
    told = both.withColumn("chapter", chapter)
    section = F.max(F.when(F.col("level") == 2, F.struct("place", "title", "at"))).over(w)
    told = told.withColumn("section", section).where("kind = 1").join(starts, "doc_id", "left")
    inside = F.when(F.col("section.at") >= F.coalesce(F.col("chapter.at"), F.lit(0)), F.col("section.title"))
    path = F.when(F.col("at") < F.coalesce("first_page", F.lit(8)), F.array(F.lit("前言/目录"))).otherwise(F.array_compact(F.array(F.col("chapter.title"), inside)))
    return told.select("doc_id", "ord", path.alias("path"))


# ---- fallbacks and block streams -------------------------------------------------------------------

def page_sections(pages: DataFrame, least: int = MIN_SECTION) -> DataFrame:
    """A section a page, where splitting into paragraphs gave too little."""
    kept = pages.withColumn("text", tx.trimmed(F.col("text"))).where(F.length("text") >= least)
    return kept.select("doc_id", F.row_number().over(_w("page")).alias("ord"), "page", tx.first_sentence(F.col("text")).alias("display_title"), "text")


def sections_or_pages(sections: DataFrame, pages: DataFrame, least_blocks: int = 3) -> DataFrame:
    """The sections (doc_id, ord, page, display_title, text), or the pages of documents with too few of them."""
    enough = sections.groupBy("doc_id").count().where(F.col("count") >= least_blocks).select("doc_id")
    return sections.join(enough, "doc_id", "left_semi").unionByName(page_sections(pages.join(enough, "doc_id", "left_anti")))


def is_block_noise(text: Column) -> Column:
    """Under 10 characters, or nothing but digits, dots and blanks."""
    t = tx.trimmed(text)
    return (F.length(t) < 10) | t.rlike(r"^\.{3,}$|^[0-9]{1,3}$|^[・·.]{5,}$") | t.rlike(r"^[0-9\s.]*$")


def merged_blocks(blocks: DataFrame, least: int = 15) -> DataFrame:
    """Layout blocks (doc_id, ord, page, text) with continuations joined and noise dropped.

    A block goes on if the text so far ends no sentence and is under 40 characters, or both are under 200
    and it ends in none of ``.!?;``.  The carried length decides, so it is a fold over lengths.
    """
    t = tx.trimmed(F.col("text"))
    b = blocks.withColumn("text", tx.merge_cjk_blanks(t)).where(F.length("text") >= least)
    last = F.substring("text", -1, 1)
    facts = F.struct("ord", F.length("text").alias("n"), last.isin(*"。！？!?」】)）").alias("ends"), last.isin(*".!?;").alias("stops"))
    kind = blocks.schema["ord"].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ends"), F.lit(True).alias("stops"), F.lit(-1).cast("long").alias("first"), F.expr(f"CAST(array() AS array<struct<ord:{kind},first:bigint>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        joins = (acc["first"] >= 0) & ~acc["ends"] & ((acc["n"] < 40) | ((acc["n"] < 200) & (x["n"] < 200) & ~acc["stops"]))
        first = F.when(joins, acc["first"]).otherwise(x["ord"].cast("long"))
        return F.struct(F.when(joins, acc["n"] + 1 + x["n"]).otherwise(x["n"]).alias("n"), x["ends"].alias("ends"), x["stops"].alias("stops"), first.alias("first"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), first.alias("first")))).alias("out"))

    told = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(facts)).alias("f")).select("doc_id", F.inline(F.aggregate("f", zero, step)["out"]))
    joined = b.join(told, ["doc_id", "ord"]).groupBy("doc_id", "first").agg(F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    kept = joined.where(~is_block_noise(F.col("text")))
    return kept.select("doc_id", F.row_number().over(_w("first")).alias("order_index"), F.lit("paragraph").alias("type"), "page", "text")


def sparse_reasons(n: Column, n_pages: Column, n_chars: Column, n_toc: Column) -> Column:
    """Why a parse of blocks is too thin: five thresholds."""
    return F.array_compact(F.array(
        F.when(n < 10, "few_elements"), F.when((n_pages > 0) & (n < n_pages), "fewer_than_pages"), F.when((n_pages > 0) & (n < F.greatest(F.lit(20), n_pages * 1.5)), "sparse_vs_pages"),
        F.when(n_chars < F.greatest(F.lit(2000), n_pages * 200), "little_text"), F.when((n_toc > 0) & (n < F.greatest(n_toc * 2, n_toc + 10)), "sparse_vs_toc"),
    ))


def may_continue(a: Column, b: Column) -> Column:
    """Whether it is worth asking a model if block ``b`` goes on with ``a``: neither a sentence's end nor a new heading."""
    end, start = F.substring(tx.trimmed(a), -1, 1), F.substring(tx.trimmed(b), 1, 6)
    ended = end.isin("。", "！", "？") & ~F.contains(F.lit("一二三四五六七八九"), start)
    return (a != "") & (b != "") & ~ended & ~start.rlike("^(第|思考|探究|练习|本章|复习)")

