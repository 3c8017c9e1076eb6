"""Document structure on literal pages and markdown, and folds against plain Python."""

import random

from pyspark.sql import functions as F

from grapnel.operators import layout

LONG = "This is a long line of running text that says something about cells. "
TOC = "目录\n第1章 走近细胞 ........ 3\n第1节 细胞是什么 ........ 3\n第2章 组成细胞的分子 ........ 9"


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")


def elements(spark, rows):
    """rows: (type, level, text, role, page)"""
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "doc_id long, order_index int, type string, level int, text string, role string, page int")


def test_page_kinds(spark):
    body = (LONG + "\n") * 5
    p = pages(spark, "Cover of a book, 2001 edition", TOC + "\n第2节 x ........ 12", "", "short lines\nof a preface\nthat goes on\n" * 12, body, "one more page\n" * 40)
    got = [(r["kind"], r["body_start"]) for r in layout.page_classes(p).orderBy("page").collect()]
    assert got == [("cover", 5), ("toc", 5), ("blank", 5), ("front", 5), ("body", 5), ("body", 5)]


def test_contents_pages_and_entries(spark):
    p = pages(spark, "cover", TOC, "第3章 细胞的结构 ........ 20\nwords", "nothing of the kind", "第4章 x ........ 30\n第5章 y ........ 40")
    assert [r["page"] for r in layout.toc_pages(p).orderBy("page").collect()] == [2, 3]
    got = [(r["level"], r["title"], r["printed_page"]) for r in layout.toc_entries(p).orderBy("place").collect()]
    assert got == [(1, "第1章 走近细胞", 3), (2, "第1节 细胞是什么", 3), (1, "第2章 组成细胞的分子", 9), (1, "第3章 细胞的结构", 20)]


def test_rule_paragraphs(spark):
    line = "细胞是生命活动的基本单位而且十分重要，需要我们认真地进行观察和研究并且记录下来直到完全理解它的结构为止"
    p = pages(spark, f"{line}\n{line}\n\nshort\n\n{LONG}\n{LONG}\n\n{line}", f"{line}\n{LONG}\n{LONG}\n第2章 细胞的结构与功能以及其他需要了解的很多内容和知识点")
    got = [(r["type"], r["page"], r["text"]) for r in layout.rule_paragraphs(p).orderBy("order_index").collect()]
    one = LONG.strip()
    assert got == [("paragraph", 1, line + line), ("paragraph", 1, one), ("paragraph", 1, one), ("paragraph", 1, f"{line} {line}"), ("paragraph", 2, one), ("heading", 2, one + "第2章 细胞的结构与功能以及其他需要了解的很多内容和知识点")]


MARKDOWN = f"""## 目录
## 栏目
第1章 走近细胞 ........ 3
第2章 细胞的分子 ........ 9

# 第1章 走近细胞
{LONG}
more [words](u) ![i](v) <b>bold</b>

```
# not a heading

kept as it is here
```
### 讨论
tiny
第9章 at the front ........ 99

# 第2章 细胞的分子
{LONG}
"""


def test_markdown_document_and_outline(spark):
    e = layout.markdown_document(spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string"))
    got = [(r["type"], r["level"], r["text"].split("\n")[0][:24]) for r in e.orderBy("order_index").collect()]
    assert got == [
        ("heading", 2, "目录"), ("heading", 2, "栏目"), ("toc", 0, "第1章 走近细胞 ........ 3"), ("heading", 1, "第1章 走近细胞"), ("paragraph", 0, LONG[:24]), ("paragraph", 0, "# not a heading"),
        ("heading", 3, "讨论"), ("toc", 0, "tiny"), ("heading", 1, "第2章 细胞的分子"), ("paragraph", 0, LONG[:24]),
    ]
    o = [(r["title"], r["level"], r["body_page"], r["printed_page"], r["confidence"]) for r in layout.markdown_outline(e).orderBy("place").collect()]
    assert o == [("第1章 走近细胞", 1, 4, 3, 0.9), ("第2章 细胞的分子", 1, 9, 9, 0.9), ("第9章 at the front", 1, 9, 99, 0.45)]
    bare = layout.markdown_document(spark.createDataFrame([(2, "# 第1章 甲乙丙\n\nwords of a paragraph\n\n## 讨论\n\n## 第1节 丁戊己\n")], "doc_id long, text string"))
    assert [(r["title"], r["body_page"]) for r in layout.markdown_outline(bare).orderBy("place").collect()] == [("第1章 甲乙丙", 1), ("第1节 丁戊己", 4)]
    report = layout.document_report(e, layout.markdown_outline(e)).first()
    assert (report["paragraph_count"], report["heading_count"], report["toc_entry_count"], report["needs_structure_review"]) == (3, 5, 3, True)


def test_sections_from_elements(spark):
    body = "A paragraph with enough of text."
    rows = [
        ("paragraph", 0, "text before the first heading goes away", "body", 1), ("toc", 0, TOC, "toc", 1), ("heading", 1, "第1章 走近细胞", "heading", 2), ("paragraph", 0, "12 " + body, "body", 2), ("heading", 3, "讨论", "heading", 2),
        ("paragraph", 0, body + " B", "body", 2), ("paragraph", 0, body + " C", "body", 3), ("heading", 2, "第1节 从生物圈到细胞", "heading", 3), ("paragraph", 0, body + " D", "sidebar", 3), ("paragraph", 0, body + " E", "body", 4), ("header", 0, "a header of the page, long", "body", 4),
        ("heading", 1, "第2章 组成细胞的分子", "heading", 5), ("paragraph", 0, "tiny", "body", 5), ("table", 0, body + " F", "body", 5),
    ]
    s = layout.sections_from_elements(elements(spark, rows)).orderBy("ord").collect()
    assert [(r["heading"], r["path"], r["chapter_index"], r["section_index"], r["block_index"]) for r in s] == [
        ("目录", ["目录"], 0, 0, 1), ("第1章 走近细胞", ["第1章 走近细胞"], 1, 0, 1), ("讨论", ["第1章 走近细胞"], 1, 0, 2), ("第1章 走近细胞", ["第1章 走近细胞"], 1, 0, 3),
        ("第1节 从生物圈到细胞", ["第1章 走近细胞", "第1节 从生物圈到细胞"], 1, 1, 1), ("第2章 组成细胞的分子", ["第2章 组成细胞的分子"], 2, 0, 1),
    ]
    assert s[1]["text"] == body
    plain = layout.sections_from_elements(elements(spark, [("paragraph", 0, body, "body", 1), ("paragraph", 0, "Preface", "body", 1), ("paragraph", 0, "Preface\n" + body, "body", 1), ("paragraph", 0, body, "body", 1)])).orderBy("ord").collect()
    assert [r["path"] for r in plain] == [[], ["前言"], ["前言"]]
    label = plain and spark.range(1).select(layout.structure_label(F.lit(2), F.lit(3), F.lit(4), F.lit(9)).alias("a"), layout.structure_label(F.lit(0), F.lit(3), F.lit(4), F.lit(9)).alias("b")).first()
    assert tuple(label) == ("C02-S03-P004", "P009")


def test_recovered_contents(spark):
    got = layout.recovered_toc(elements(spark, [("toc", 0, TOC, "toc", 2), ("toc", 0, "tiny", "toc", 2), ("paragraph", 0, "words of a preface", "front_matter", 3), ("paragraph", 0, "body", "body", 4)])).first()
    assert (got["how"], got["page_start"], got["page_end"], got["text"]) == ("collected", 2, 3, TOC + "\n\nwords of a preface")


def stitch_plainly(rows):
    """rows: (path, text)"""
    import re

    out = []
    for path, text in rows:
        t = text.strip()
        if out:
            p, old, n = out[-1]
            fixed = any(x and x[0] in layout.NEVER_MERGED for x in (p, path))
            short = p == path and p and (len(old) < 50 or len(t) < 50) and len(old) + len(t) < 2000
            starts = re.match("^(第|思考|讨论)", t) or (re.match(r"^[0-9]+[.、]", t) and len(t) < 100)
            goes = not p and not path and len(old) >= 20 and len(t) >= 20 and len(old) + len(t) <= 800 and not re.search(r"[。！？.!?」】)）]$", old) and not starts
            if not fixed and (short or goes):
                out[-1] = (p, old + ("\n\n" if short else "\n") + t, n + 1)
                continue
        out.append((path, text.strip(), 1))
    return out


def test_stitching_is_a_fold(spark):
    r = random.Random(5)
    docs = {d: [(r.choice([[], [], ["a"], ["a", "b"], ["前言"]]), r.choice(["word " * r.randrange(1, 60), "ends here.", "讨论 of it all, and more", "1. do it", "x" * r.randrange(10, 500)])) for _ in range(40)] for d in range(12)}
    frame = spark.createDataFrame([(d, i, p, t) for d, rows in docs.items() for i, (p, t) in enumerate(rows)], "doc_id long, ord int, path array<string>, text string")
    got = layout.stitched(frame).orderBy("doc_id", "ord").collect()
    for d, rows in docs.items():
        assert [(x["path"], x["text"], x["n_parts"]) for x in got if x["doc_id"] == d] == stitch_plainly(rows)


def test_blocks_are_merged_by_carried_length(spark):
    r = random.Random(6)
    texts = [r.choice(["word " * r.randrange(3, 50), "It ends with a stop; as", "Closed sentence here。", "12 . 13 . 14 . 15 . 16 . 17", "nine char"]).strip() for _ in range(80)]
    out = []
    for t in texts:
        if len(t) < 15:
            continue
        if out and out[-1][-1] not in "。！？!?」】)）" and (len(out[-1]) < 40 or (len(out[-1]) < 200 and len(t) < 200 and out[-1][-1] not in ".!?;")):
            out[-1] += " " + t
        else:
            out.append(t)
    want = [t for t in out if len(t) >= 10 and not set(t) <= set("0123456789. ")]
    got = layout.merged_blocks(spark.createDataFrame([(1, i, i // 5, t) for i, t in enumerate(texts)], "doc_id long, ord int, page int, text string")).orderBy("order_index").collect()
    assert [x["text"] for x in got] == want


def test_outline_by_page_and_order(spark):
    o = spark.createDataFrame([(1, 1, "第1章 甲", 1, 3), (1, 2, "第1节 乙", 2, 3), (1, 3, "第2节 丙", 2, 5), (1, 4, "第2章 丁", 1, 8)], layout.OUTLINE_SCHEMA)
    s = spark.createDataFrame([(1, 1, 2, "x"), (1, 2, 3, "x"), (1, 3, 3, "在 第1章 甲 里"), (1, 4, 6, "x"), (1, 5, 9, "x")], "doc_id long, ord int, page int, text string")
    got = layout.outline_by_page(s, o).orderBy("ord").collect()
    assert [r["outline_path"] for r in got] == [[], ["第1章 甲", "第1节 乙"], ["第1章 甲"], ["第1章 甲", "第2节 丙"], ["第2章 丁"]]
    assert [r["chapter_no"] for r in got] == [0, 1, 1, 1, 2]
    assert [r["outline_path"] for r in layout.outline_by_order(s, o).orderBy("ord").collect()] == [[], [], ["第1章 甲", "第1节 乙"], ["第1章 甲", "第1节 乙"], ["第1章 甲", "第2节 丙"]]
    assert not layout.is_order_only(o).first()["order_only"]


def test_order_only_outline_is_pulled_back(spark):
    o = spark.createDataFrame([(1, 1, "第1章 甲的世界", 1, 40), (1, 2, "第1节 细胞是什么", 2, 41), (1, 3, "第2节 从生物圈到细胞", 2, 50), (1, 4, "第2章 组成", 1, 60), (1, 5, "第1节 水与盐", 2, 61)], layout.OUTLINE_SCHEMA)
    s = spark.createDataFrame([(1, i, "h", t, "text about " + t) for i, t in enumerate(["开头", "细胞是什么呢", "过渡", "从生物圈到细胞", "水与盐的作用", "尾声"], 1)], "doc_id long, ord int, heading string, display_title string, text string")
    got = layout.refine_order_outline(o, s).orderBy("place").collect()
    assert [r["body_page"] for r in got] == [1, 2, 4, 5, 5]
    near = spark.createDataFrame([(1, 1, "x", 1, 2)], layout.OUTLINE_SCHEMA)
    assert layout.refine_order_outline(near, s).first()["body_page"] == 2
    assert layout.search_keys("第1章细胞的结构和功能abc") == ["细胞的结构和功能abc", "的结构和功能abc", "结构和功能abc", "细胞的结构", "功能abc", "abc"]


def test_legacy_labels(spark):
    p = pages(spark, "目录\n第1章 走近细胞 .... 1\n第1节 细胞是什么 .... 1\n第2章 分子 .... 9", "前言", "第1章 走近细胞\n第1节 细胞是什么", "words", "第2章 分子")
    toc = layout.legacy_toc(p)
    assert [(r["level"], r["title"], r["printed"]) for r in toc.orderBy("place").collect()] == [(1, "第1章 走近细胞", 1), (2, "第1节 细胞是什么", 1), (1, "第2章 分子", 9)]
    b = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "doc_id long, ord int, page int")
    assert [r["path"] for r in layout.legacy_labels(b, toc, p).orderBy("ord").collect()] == [["前言/目录"], ["前言/目录"], ["第1章 走近细胞", "第1节 细胞是什么"], ["第1章 走近细胞", "第1节 细胞是什么"], ["第2章 分子"]]


def test_fallbacks_and_gates(spark):
    s = spark.createDataFrame([(1, i, 1, "t", "x") for i in range(3)] + [(2, 1, 1, "t", "x")], "doc_id long, ord int, page int, display_title string, text string")
    p = spark.createDataFrame([(2, 1, "A page with text enough."), (2, 2, "tiny"), (1, 1, "A page with text enough.")], "doc_id long, page int, text string")
    assert sorted((r["doc_id"], r["text"]) for r in layout.sections_or_pages(s, p).collect()) == [(1, "x")] * 3 + [(2, "A page with text enough.")]
    rows = spark.createDataFrame([(5, 9, 100, 4), (40, 10, 9000, 0)], "n int, p int, c int, t int").select(layout.sparse_reasons(F.col("n"), F.col("p"), F.col("c"), F.col("t")).alias("r")).collect()
    assert [len(r["r"]) for r in rows] == [5, 0]
    pairs = [("ends。", "new"), ("ends。", "一二三四五六"), ("open", "第2章"), ("open", "goes on"), ("", "x")]
    assert [r["m"] for r in spark.createDataFrame(pairs, "a string, b string").select(layout.may_continue(F.col("a"), F.col("b")).alias("m")).collect()] == [False, True, False, True, False]
    text = spark.createDataFrame([("# T\n\n![i](v) [w](u) <b>x</b>",)], "t string")
    assert text.select(layout.strip_markdown(F.col("t")).alias("t")).first()["t"] == "T\nw x"
    assert text.select(layout.is_pseudo_heading(F.lit("讨论")).alias("a"), layout.is_pseudo_heading(F.lit("第1章 讨论")).alias("b"), layout.is_rule_heading(F.lit("探究 一下")).alias("c"), layout.is_rule_heading(F.lit("x" * 50)).alias("d")).first() == (True, False, True, False)
