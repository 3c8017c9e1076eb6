"""Pairs of titles by blocks against plain loops, and that no pair goes through a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from grapnel.operators import allpairs, linkage


@pytest.fixture(scope="module")
def titles():
    r = random.Random(5)
    words = ["graph", "cell", "theory", "of", "deep", "learning", "models", "🙂é", "noise", "a", "\0b"]
    return [(i, " ".join(r.choices(words, k=r.randrange(1, 9)))) for i in r.sample(range(1000), 150)] + [(2000, "ab"), (2001, ""), (2002, None), (2003, " A  b"), (2004, "a b")]


def plainly(titles):
    """(classes, {(a, b): (shared, Jaccard)}) of titles by loops."""
    first = {}
    for i, t in sorted(titles):
        if t is not None:
            first.setdefault(" ".join(t.lower().split(" ")).strip() if "  " not in t else " ".join(t.lower().split()), i)
    sets = {i: {t} if len(t) < 3 else {t[j : j + 3] for j in range(len(t) - 2)} for t, i in first.items()}
    both = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    return {p: (n, int((n * 2_000_000 + m) // (2 * m)) / 1e6) for p, (n, m) in both.items() if 4 * n >= m}


@pytest.mark.parametrize("rows", [7, 4096])
def test_pairs_of_blocks(spark, titles, rows):
    frame, want = spark.createDataFrame(titles, "k long, t string"), plainly(titles)
    got = linkage.jaccard_pairs(frame, "k", "t", rows=rows).collect()
    assert len(got) == len(want) and {(x["a"], x["b"]): (x["common"], x["jaccard"]) for x in got} == want
    best = {}
    for (a, b), (_, j) in sorted(want.items()):
        if b not in best or j > best[b][1]:
            best[b] = (a, j)
    told = linkage.series_decision(linkage.best_earlier(frame, "k", "t", rows=rows), linkage.title_classes(frame, "k", "t"), "k").where("confidence < 1 OR decision = 'join'").collect()
    assert {x["k"]: x["series_of"] for x in told if x["k"] in best} == {b: a for b, (a, _) in best.items()}
    sketch = {(x["a"], x["b"]) for x in linkage.minhash_pairs(frame, "k", "t", rows=rows).collect()}
    assert sketch <= set(want) and len(sketch) >= 0.95 * len(want)


def test_sketch_is_what_min_hashes_say(spark, titles):
    """With one table a pair is found if and only if its two min-hashes agree."""
    frame, want = spark.createDataFrame(titles, "k long, t string"), plainly(titles)
    marks = linkage.different_titles(frame, "k", "t").select("id", F.array_min(F.transform(linkage.shingles(F.col("t")), lambda x: F.xxhash64(F.lit(0), x))).alias("h"))
    least = {x["id"]: x["h"] for x in marks.collect()}
    got = {(x["a"], x["b"]) for x in linkage.minhash_pairs(frame, "k", "t", tables=1, rows=40).collect()}
    assert got == {p for p in want if least[p[0]] == least[p[1]]} and 0 < len(got) < len(want)


@pytest.mark.parametrize("find", [linkage.jaccard_pairs, linkage.minhash_pairs])
def test_no_pair_goes_through_a_shuffle(spark, titles, find):
    frame = find(spark.createDataFrame(titles, "k long, t string"), "k", "t")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_a_block_pair_sends_one_best_for_each_title(spark):
    """Titles that are all alike: their pairs grow with the square, what leaves the blocks does not."""
    frame = spark.createDataFrame([(i, f"one and the same long title of everything {i:03d}") for i in range(120)], "k long, t string")
    assert linkage.jaccard_pairs(frame, "k", "t").count() == 120 * 119 // 2
    assert linkage.best_earlier(frame, "k", "t", rows=4096).count() < 5 * 120


def test_codes_are_exact():
    texts = ["", "a", "\0", "a\0", "\0a", "ab", "abc", "\0ab", "🙂🙂🙂", "\U0010ffff" * 3]
    assert len({tuple(allpairs.codes(t)) for t in texts}) == len(texts) and len(allpairs.codes("aaaa")) == 1
