"""Line and title rules as column expressions.

Character classes are written out, so blanks outside ASCII mean the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Character classes, patterns and labels that decide results.
CJK = "一-鿿㐀-䶿豈-﫿"
CJK_MARKS = "　-〿＀-￯"
NUMERAL = "一二三四五六七八九十0-9"
PAGE_NUMBER = r"^[0-9]{1,4}$"
RATIO_FRAGMENT = r"^[0-9 \t.:：∶]+$"
UNIT_FRAGMENT = r"^[0-9]+[ \t]*(nm|μm|mm|cm|m|km|g|kg|ml|L|mol|℃|%)$"
TOC_DOTS = r"^(.+?)[.…·•]{2,}[ \t]*([0-9]{1,4})[ \t]*$"
TOC_SPACED = rf"^(第[ \t]*[{NUMERAL}]+[ \t]*[章节].+?)[ \t]+([0-9]{{1,4}})[ \t]*$"
TOC_BARE = rf"^(第[ \t]*[{NUMERAL}]+[ \t]*[章节][ \t]*.+?)[.…·•]?[ \t]*$"
CHAPTER = rf"第[ \t]*[{NUMERAL}]+[ \t]*章"
SECTION = rf"第[ \t]*[{NUMERAL}]+[ \t]*节"
DATE_WORDS = "年|月|日|世纪|年代|万年|亿年"
NEVER_STRIP = r"年|月|日|世纪|年代|万年|亿年|章|节|篇|部|条|款|项|\.[0-9]|%|％|°|℃|℉"
SENTENCE_END = r"[。！？.!?」】)）]$"
FRONT_TITLES = (
    "目录", "目 录", "目次", "Contents", "Table of Contents", "前言", "序言", "序", "Foreword", "Preface", "编写说明", "编辑说明", "凡例", "使用说明", "后记", "跋", "结语", "後記",
    "致谢", "Acknowledgments", "参考文献", "References", "Bibliography", "附录", "Appendix", "附錄", "注释", "Notes", "译者简介", "作者简介", "编者简介",
)
CONTEXT_TITLES = (
    "问题探讨", "讨论", "本节聚焦", "思考与讨论", "探究·实践", "探究与实践", "实验", "实践活动", "练习与应用", "练习", "复习与提高", "复习题", "自我检测", "本章小结", "内容提要", "本节要点",
    "材料用具", "方法步骤", "结果和结论", "目的要求", "实验原理", "实验步骤", "实验结果", "讨论与思考", "相关信息", "与社会的联系", "学科交叉", "科学方法",
)
PSEUDO_TITLES = (
    "问题探讨", "讨论", "本节聚焦", "相关信息", "材料用具", "方法步骤", "练习与应用", "思考与讨论", "探究与实践", "知识链接", "拓展视野", "与社会的联系", "学科交叉", "科学方法", "实验",
    "本节要点", "内容提要", "本章小结", "自我检测", "复习题",
)
DECORATIVE_TITLES = ("科学家访谈", "科学·技术·社会", "科学•技术•社会", "与生物学有关的职业", "生物科技进展", "知识链接", "拓展视野", "课外阅读", "课外实践", "STS", "STSE", "袁隆平", "育种工作者", "遗传咨询师")
FRONT_HINTS = ("preface", "foreword", "acknowledgment", "appendix", "前言", "序", "后记", "附录", "致谢", "目录", "contents")
CONTEXT_HINTS = ("discussion", "example", "note", "exercise", "activity", "讨论", "案例", "练习", "注意", "提示", "说明", "问题")
LEADING_PAGES = (r"^[pP][ \t]*[0-9]{1,4}[ \t]*", r"^第?[0-9]{1,4}[页頁][ \t]*", r"^[0-9]{1,4}[ \t]*/[ \t]*[0-9]{1,4}[ \t]*", rf"^[0-9]{{1,4}}[ \t]+(?!{DATE_WORDS})")
GOOD_FIRST = "^[一-鿿぀-ゟ゠-ヿa-zA-Z0-9\"'“‘（(《〈【\\[]"
BAD_FIRST = "，。！？、；：」』）】》"
NUMBERED_ITEM = r"^[一二三四五六七八九十]+[、，．.][ \t]*.+"
CHAPTER_START = rf"^(第[ \t]*[{NUMERAL}]+[ \t]*[章节篇部]|Chapter[ \t]+[0-9]+|Part[ \t]+[0-9]+)"
DOTTED_END = r"[.…·•]{2,}[ \t]*[0-9]{1,4}[ \t]*$"
NUMBERED_END = rf"第[ \t]*[{NUMERAL}]+[ \t]*[章节].+[0-9]{{1,4}}[ \t]*$"
PAGE_LABEL = r"^第?[0-9]{1,4}[页頁]?[ \t]*$"
PAGE_RANGE = r"^[0-9]{1,4}[ \t]*[-–—][ \t]*[0-9]{1,4}[ \t]*$"
LEADERS_END = r"[.…·•]{3,}[ \t]*[0-9]{1,4}[ \t]*$"
NUMBERING = rf"(?i)^(第[ \t]*[{NUMERAL}]+[ \t]*[章节篇部]|Chapter[ \t]+[0-9]+|Part[ \t]+[0-9]+|Section[ \t]+[0-9]+|[IVX]+\.[ \t]+|[0-9]+\.[0-9]+[ \t]+|[A-G]\.[ \t]+)"
BULLET = r"^([0-9①②③④⑤⑥⑦⑧⑨⑩]+[.、．)]|[(（][0-9]+[)）]|[•·●○])"
TITLE_RULES = (
    (r"[.…·•]{2,}.*$", ""), (r"[ \t]*[.…·•]+[ \t]*[0-9]{1,4}[ \t]*$", ""), (r"[ \t\r\n]+", " "), (r"^ +| +$", ""), (r"[.…·• ]+$", ""),
    (rf"第[ \t]+([{NUMERAL}]+)[ \t]*([章节篇部])", "第$1$2"), (rf"(第[{NUMERAL}]+[章节篇部])([^ \t，,.．。；;：:])", "$1 $2"),
)
SPECIAL_BLOCKS = (
    (("前言", "序言", "序", "Foreword", "Preface", "编者序", "作者序", "译者序", "推荐序", "代序"), "前言"),
    (("目录", "目次", "Contents", "Table of Contents"), "目录"),
    (("编写说明", "编辑说明", "凡例", "使用说明", "导读"), "编写说明"),
    (("参考文献", "References", "Bibliography", "引用文献"), "参考文献"),
    (("附录", "Appendix", "附錄"), "附录"),
    (("后记", "跋", "结语", "後記", "あとがき"), "后记"),
    (("注释", "Notes", "注釈", "注解"), "注释"),
    (("译者简介", "作者简介", "编者简介"), "简介"),
)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))


def merge_cjk_blanks(text: Column) -> Column:
    """Blanks and tabs between CJK characters, and before CJK marks, go; line feeds stay."""
    text = F.regexp_replace(text, f"(?<=[{CJK}])[ \\t]+(?=[{CJK}])", "")
    return F.regexp_replace(text, f"(?<=[{CJK}])[ \\t]+(?=[{CJK_MARKS}])", "")


def is_noise_line(line: Column) -> Column:
    """A page number, a short ratio, a number with a unit, or one character 16 times or more."""
    t = trimmed(line)
    return (t != "") & (t.rlike(PAGE_NUMBER) | (t.rlike(RATIO_FRAGMENT) & (F.length(t) <= 15)) | t.rlike(UNIT_FRAGMENT) | t.rlike(r"^(.)\1{15,}$"))


def filter_lines(text: Column) -> tuple[Column, Column]:
    """(kept text, number of noise lines)."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~is_noise_line(x))
    return F.array_join(kept, "\n"), F.size(lines) - F.size(kept)


def is_poor_page(text: Column) -> Column:
    """Three lines or more, over 60 % of them a single CJK character: the page needs recognition."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    single = F.filter(lines, lambda x: x.rlike("^[一-鿿]$"))
    return (F.size(lines) >= 3) & (F.size(single) > F.size(lines) * 0.6)


def clean_title(title: Column) -> Column:
    """Leaders and page numbers at the end go, blanks collapse, numbering is spaced one way."""
    t = F.replace(title, F.lit("　"), F.lit(" "))
    for pattern, to in TITLE_RULES:
        t = F.regexp_replace(t, pattern, to)
    return t


def normalize_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(clean_title(title), "[ \\t\\r\\n]+", ""))


def title_level(title: Column) -> Column:
    return F.when(title.rlike(CHAPTER), 1).otherwise(2)


def parse_toc_line(line: Column) -> Column:
    """struct(title, level, printed_page) of a table-of-contents line, else null; page 0 if it has none."""
    raw = trimmed(line)
    title = F.when(raw.rlike(TOC_DOTS), F.regexp_extract(raw, TOC_DOTS, 1)).when(raw.rlike(TOC_SPACED), F.regexp_extract(raw, TOC_SPACED, 1)).when(raw.rlike(TOC_BARE), F.regexp_extract(raw, TOC_BARE, 1))
    page = F.when(raw.rlike(TOC_DOTS), F.regexp_extract(raw, TOC_DOTS, 2)).when(raw.rlike(TOC_SPACED), F.regexp_extract(raw, TOC_SPACED, 2)).otherwise("0")
    t = clean_title(title)
    return F.when((t != "") & (t.rlike(CHAPTER) | t.rlike(SECTION)), F.struct(t.alias("title"), title_level(t).alias("level"), page.cast("int").alias("printed_page")))


def strip_page_number(text: Column) -> Column:
    """Leading page numbers go; numbers before words of date or count stay."""
    t = trimmed(text)
    for p in LEADING_PAGES:
        t = F.regexp_replace(t, p, "")
    return trimmed(t)


def first_sentence(text: Column, most: int = 50) -> Column:
    """The first sentence of 10 characters or more, else the first two if 15 or more, else a prefix."""
    t = strip_page_number(text)
    head = F.substring(t, 1, 3 * most + 1)
    one = F.regexp_extract(head, r"^[^。！？!?.\n]*[。！？!?.\n]", 0)
    two = F.regexp_extract(head, r"^[^。！？!?.\n]*[。！？!?.\n][^。！？!?.\n]*[。！？!?.\n]", 0)
    return F.when(F.length(one) >= 10, one).when((one != "") & (F.length(two) >= 15), two).otherwise(F.substring(t, 1, most))


def special_block(text: Column, heading: Column) -> Column:
    """The label of a structural block (preface, contents, ...), else an empty string."""
    first = trimmed(F.substring(F.when(heading != "", heading).otherwise(F.get(F.split(text, "\n"), F.lit(0))), 1, 40))
    out = F.lit("")
    for names, label in reversed(SPECIAL_BLOCKS):
        out = F.when(first.isin(*names), label).otherwise(out)
    return out


def quality_concerns(text: Column) -> Column:
    """Array of concerns about a block."""
    first = F.substring(text, 1, 1)
    return F.array_compact(F.array(
        F.when(F.length(text) < 50, "too_short"), F.when((text != "") & ~text.rlike(GOOD_FIRST), "suspicious_first_char"),
        F.when((first != "") & F.contains(F.lit(BAD_FIRST), first), "starts_with_punctuation"),
    ))


def heading_role(text: Column, level: Column, in_toc: Column) -> Column:
    """One of six roles, by the first rule that applies."""
    t = trimmed(text)
    numbered = t.rlike(NUMBERED_ITEM)
    chapter = t.rlike(CHAPTER_START)
    toc_line = t.rlike(DOTTED_END) | t.rlike(NUMBERED_END)
    letters = F.length(F.regexp_replace(t, "[^\\p{L}]", ""))
    named = t.isin(*CONTEXT_TITLES) | t.isin(*DECORATIVE_TITLES) | numbered
    return (
        F.when(t == "", "noise").when(t.isin(*FRONT_TITLES), "front_matter")
        .when((F.length(t) < 2) | t.rlike(PAGE_LABEL) | (letters / F.length(t) < 0.3), "noise")
        .when(in_toc & (chapter | toc_line), "toc_entry").when(chapter, "structural_heading")
        .when((level <= 2) & (F.length(t) > 5) & ~named, "structural_heading")
        .when(t.isin(*CONTEXT_TITLES) | numbered, "context_heading").when(t.isin(*DECORATIVE_TITLES), "decorative").otherwise("structural_heading")
    )


def block_role(text: Column, order_index: Column, total: Column, level: Column) -> Column:
    """structural, context, content, front or noise, from position, numbering, hints and density."""
    t = trimmed(text)
    low = F.lower(t)
    hint = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    density = F.length(F.regexp_replace(t, "[^一-鿿a-zA-Z0-9]", "")) / F.greatest(F.length(t), F.lit(1))
    noise = (F.length(t) < 3) | t.rlike(r"^[0-9]{1,4}[ \t]*$") | t.rlike(PAGE_RANGE) | (density < 0.2)
    place = order_index / F.greatest(total, F.lit(1))
    edge = (place < 0.05) | (place > 0.95)
    dots = t.rlike(LEADERS_END)
    number = t.rlike(NUMBERING)
    bullet = t.rlike(BULLET)
    return (
        F.when(t == "", "noise").when((level == 0) & noise, "noise").when(edge & (dots | hint(FRONT_HINTS)), "front")
        .when((level >= 1) | number, F.when((level >= 2) & hint(CONTEXT_HINTS), "context").when(level <= 3, "structural").otherwise("context"))
        .when(bullet, "context").when((F.length(t) < 40) & (density < 0.6) & hint(CONTEXT_HINTS), "context").otherwise("content")
    )


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def locate(text: Column, quote: Column) -> Column:
    """struct(start, end, exact): where a quote stands (code points from 0), exactly or with blanks and case
    aside; the second kind counts in the normalised text and says so.  Null if it is nowhere."""
    flat = lambda c: F.lower(F.regexp_replace(c, "[ \\t\\r\\n]+", ""))
    at = F.call_function("instr", text, quote) - 1
    near = F.call_function("instr", flat(text), flat(quote)) - 1
    return F.when(at >= 0, F.struct(at.alias("start"), (at + F.length(quote)).alias("end"), F.lit(True).alias("exact"))).when(near >= 0, F.struct(near.alias("start"), (near + F.length(flat(quote))).alias("end"), F.lit(False).alias("exact")))


def json_payload(answer: Column) -> Column:
    """The JSON in a model's answer: fences go; else the first object or array."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(trimmed(answer), r"^```[a-zA-Z]*[ \t]*\n?", ""), r"\n?```$", ""))
    return F.when(bare.rlike(r"(?s)^(\{.*\}|\[.*\])$"), bare).otherwise(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1))


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """An enum value, or its default."""
    v = F.lower(trimmed(value))
    return F.when(v.isin(*allowed), v).otherwise(default)
