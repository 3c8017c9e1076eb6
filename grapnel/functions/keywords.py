"""Keyword summaries and display titles as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from grapnel.functions import text as tx

# Word lists and delimiters that decide results.
STOP_CJK = (
    "的", "了", "是", "在", "和", "与", "等", "这", "那", "一个", "一种", "可以", "能够", "通过", "以及", "因此", "所以", "但是", "然而", "如果", "虽然", "因为", "或者", "并且", "而且", "不仅", "已经", "正在", "将", "会", "被", "把",
    "从", "对", "向", "以", "用", "为", "也", "就", "都", "还", "要", "能", "可", "所", "其", "更", "最", "很", "较", "不", "没", "有", "上", "下", "中", "里", "外", "内", "前", "后", "我们", "它们", "他们", "自己", "什么", "怎么",
)
STOP_ASCII = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "may", "might", "shall", "should", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "and", "or", "but", "not", "no", "if", "so", "as", "than", "this", "that", "these", "those", "it", "its", "they", "them", "we", "us", "our", "their", "his", "her", "my", "your",
)
FUNCTION_CJK = ("问题", "讨论", "本节", "聚焦", "探究", "实践", "相关", "信息", "资料", "阅读", "分析", "思考", "练习", "应用", "检测", "拓展", "小结", "复习", "目的", "要求", "材料", "用具", "方法", "步骤", "结果", "结论", "注意", "提示", "说明", "简介", "背景")
FUNCTION_ASCII = ("discussion", "example", "exercise", "note", "summary", "objective", "method", "result", "conclusion", "reference", "introduction", "background", "overview")
GENERIC_CJK = (
    "细胞", "分子", "结构", "过程", "作用", "功能", "组成", "变化", "物质", "生物", "实验", "研究", "方法", "结果", "发生", "形成", "存在", "进行", "具有", "主要", "不同", "重要", "基本", "特点",
    "单位", "生命", "活动", "系统", "环境", "条件", "内容", "部分", "方面", "情况", "关系",
)
GENERIC_ASCII = ("cell", "structure", "function", "process", "method", "result", "analysis", "data", "study", "research", "system", "example", "figure", "table")
VERBS_CJK = (
    "看到", "可以", "能够", "通过", "进行", "具有", "揭示", "提出", "发现", "显示", "表明", "说明", "包括", "含有", "存在", "形成", "产生", "组成", "构成", "获得", "使得", "引起", "导致", "影响", "利用", "采用", "根据", "按照", "关于", "对于",
    "主要", "需要", "可能", "应该", "必须", "一定", "然后", "首先", "其次", "最后", "接着", "之后", "其中", "那个", "这些", "那些", "什么", "一种", "各种", "不同", "相同", "类似",
)
VERBS_ASCII = ("shows", "show", "shown", "found", "indicates", "suggests", "demonstrates", "provides")
DELIMITERS = r"[,，、；;：:。！？!?\s的在了和与等对向以用为是]"
SENTENCES = "[。！？!?\n；;]"
OLD_GENERIC, OLD_VERBS = (*GENERIC_CJK, "问题"), ("这个", *VERBS_CJK)


@dataclass(frozen=True)
class Keywords:
    """One way to pick keywords; the lists are its rules."""

    splitter: str
    unfit: tuple[str, ...]
    stops: tuple[str, ...]
    longest: int
    fold_case: bool


GENERAL = Keywords(f"(?i){DELIMITERS}|" + "|".join((*VERBS_CJK, *VERBS_ASCII)), (*FUNCTION_CJK, *FUNCTION_ASCII, *GENERIC_CJK, *GENERIC_ASCII), (*STOP_CJK, *STOP_ASCII), 12, True)
OLDER = Keywords(f"{DELIMITERS}|" + "|".join(OLD_VERBS), (*FUNCTION_CJK, *OLD_GENERIC, *OLD_VERBS), (*STOP_CJK, *FUNCTION_CJK), 10, False)


def phrases(text: Column, rules: Keywords = GENERAL) -> Column:
    """What delimiters and verbs leave: three characters or more with two letters side by side, or (older) three CJK ones."""
    parts = F.transform(F.split(text, rules.splitter), tx.trimmed)
    if rules.fold_case:
        return F.filter(parts, lambda p: p.rlike("[一-鿿a-zA-Z]{2,}") & (F.length(p) >= 3))
    return F.filter(parts, lambda p: F.length(F.regexp_replace(p, "[^一-鿿]", "")) >= 3)


def summary(text: Column, heading: Column, rules: Keywords = GENERAL, least: int = 6, most: int = 18) -> Column:
    """Six to 18 characters from the first three sentences: fit phrases, those said once before others, longer before
    shorter, put together until six are reached; an empty string without any."""
    first = F.slice(F.filter(F.transform(F.slice(F.split(text, SENTENCES), 1, 5), tx.trimmed), lambda s: s != ""), 1, 3)
    lower = (lambda p: F.lower(p)) if rules.fold_case else (lambda p: p)
    is_stop = lambda p: lower(p).isin(*rules.stops)

    def chosen(found: Column) -> Column:
        # the heading's phrases are taken apart once, not for each phrase of the text
        good = F.filter(found, lambda p: (F.length(p) >= 3) & (F.length(p) <= rules.longest) & ~is_stop(p) & ~p.isin(*rules.unfit))
        fit = F.get(F.transform(F.array(phrases(heading, rules)), lambda own: F.filter(good, lambda p: ~F.array_contains(own, p))), F.lit(0))
        return F.get(F.transform(F.array(fit), lambda f: F.when(F.size(f) > 0, f).otherwise(F.filter(found, lambda p: ~is_stop(p)))), F.lit(0))

    def ranked(kept: Column) -> Column:
        counted = F.transform(F.array_distinct(kept), lambda p, i: F.struct(p.alias("p"), F.size(F.filter(kept, lambda x: x == p)).alias("n"), i.alias("i")))

        def ordered(c: Column) -> Column:
            once = F.filter(c, lambda x: x["n"] == 1)
            several = F.size(once) >= 2
            rows = F.when(several, once).otherwise(c)
            key = F.transform(rows, lambda x: F.struct((-F.length(x["p"])).alias("l"), F.when(several, 0).otherwise(-x["n"]).alias("n"), x["i"].alias("i"), x["p"].alias("p")))
            return F.transform(F.array_sort(key), lambda x: x["p"])

        return F.get(F.transform(F.array(counted), ordered), F.lit(0))

    def together(ps: Column) -> Column:
        told = F.aggregate(ps, F.lit(""), lambda acc, p: F.when((F.length(acc) < least) & (F.length(acc) + F.length(p) <= most) & ~F.contains(acc, p), F.concat(acc, p)).otherwise(acc))
        return F.get(F.transform(F.array(told), lambda t: F.when((F.length(t) < least) & (F.size(ps) > 0), F.substring(F.get(ps, F.lit(0)), 1, most)).otherwise(F.substring(t, 1, most))), F.lit(0))

    step = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.coalesce(step(phrases(F.array_join(first, ""), rules), lambda found: step(chosen(found), lambda kept: step(ranked(kept), together))), F.lit(""))


def titles(heading: Column, text: Column, role: Column, toc_title: Column) -> Column:
    """struct(structure, display) by block role; context blocks get keywords, structural ones if there are four characters of them."""
    h, start = F.coalesce(heading, F.lit("")), F.substring(text, 1, 40)
    named = F.when(F.coalesce(toc_title, F.lit("")) != "", toc_title).otherwise(h)
    bar = lambda t, kw, least: F.when(F.length(kw) >= least, F.concat(t, F.lit("｜"), kw)).otherwise(t)
    kw = summary(text, F.when(role == "structural", named).when(role == "context", h).otherwise(""))

    def made(k: Column) -> Column:
        both = lambda a, b: F.struct(a.alias("structure"), b.alias("display"))
        none = F.lit("")
        return (
            F.when(role == "front", both(named, F.when(h != "", h).otherwise(named))).when(role == "structural", both(named, F.when(named == "", none).otherwise(bar(named, k, 4))))
            .when(role == "context", both(h, F.when(h == "", start).otherwise(bar(h, k, 1)))).when(role == "content", both(F.when(h != "", h).otherwise(k), F.when(h != "", h).when(k != "", k).otherwise(start)))
            .when(role == "noise", both(none, none)).otherwise(both(h, F.when(h != "", h).otherwise(start)))
        )

    return F.get(F.transform(F.array(kw), made), F.lit(0))


def older_title(heading: Column, text: Column, role: Column) -> Column:
    """The display title by heading role, with keywords of the older kind."""
    h = F.coalesce(heading, F.lit(""))
    kw = summary(text, h, OLDER)
    least = F.when(role == "context_heading", 1).when(role == "structural_heading", 4)
    made = lambda k: F.when(h == "", F.when(k != "", k).otherwise(F.substring(text, 1, 40))).when(F.length(k) >= least, F.concat(h, F.lit("｜"), k)).otherwise(h)
    return F.get(F.transform(F.array(kw), made), F.lit(0))
