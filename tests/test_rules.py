"""Rules on literals that the tables lack: CJK titles, contents lines, folds, parsers, sources."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from grapnel import catalog
from grapnel.functions import keywords, text as tx
from grapnel.operators import answers, linkage, repair, retrieval, traversal
from grapnel.sources import config, connectors
from grapnel.streaming import progress


def one(spark, value, rule):
    return spark.createDataFrame([(value,)], "v string").select(rule(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("line,want", [("第 1 章 走近细胞 ........ 12", ("第1章 走近细胞", 1, 12)), ("第2节 细胞的多样性   7", ("第2节 细胞的多样性", 2, 7)), ("第3章走近细胞", ("第3章 走近细胞", 1, 0)), ("plain words .... 4", None), ("", None)])
def test_toc_lines(spark, line, want):
    got = one(spark, line, tx.parse_toc_line)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize("text,want", [("144 text", "text"), ("P12 text", "text"), ("第33页 text", "text"), ("3/90 text", "text"), ("2007 年 text", "2007 年 text"), ("21 世纪", "21 世纪")])
def test_page_numbers(spark, text, want):
    assert one(spark, text, tx.strip_page_number) == want


@pytest.mark.parametrize("text,want", [("知 识\t图 谱", "知识图谱"), ("知识 ，模", "知识，模"), ("a b 知 c", "a b 知 c"), ("知\n识", "知\n识")])
def test_cjk_blanks(spark, text, want):
    assert one(spark, text, tx.merge_cjk_blanks) == want


@pytest.mark.parametrize("text,want", [("12", True), ("1 : 2.5", True), ("25 mm", True), ("=" * 16, True), ("=" * 15, False), ("words", False), ("  ", False)])
def test_noise(spark, text, want):
    assert one(spark, text, tx.is_noise_line) is want


@pytest.mark.parametrize("question,mode", [("什么是细胞", "explain"), ("A和B的区别与差异", "compare"), ("有哪些证据", "audit"), ("hello", "explain"), ("综述 vs 总结", "synthesis")])
def test_mode(spark, question, mode):
    assert one(spark, question, retrieval.mode_of) == mode


def test_locate_marks_inexact(spark):
    rows = spark.createDataFrame([("ab cd ef", "cd e"), ("ab cd ef", "CDEF"), ("ab", "zz")], "t string, q string").select(tx.locate(F.col("t"), F.col("q")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in rows] == [(3, 7, True), (2, 6, False), None]


def test_auto_parse_prefers_good_then_last(spark):
    rows = [(1, "mineru_api", True), (1, "external_markdown", False), (1, "pdfplumber", False), (2, "mineru_api", True), (2, "external_markdown", True), (2, "pdfplumber", True)]
    got = connectors.auto_parse(spark.createDataFrame(rows, "doc_id long, parser string, needs_review boolean"))
    assert {r["doc_id"]: r["parser"] for r in got.collect()} == {1: "external_markdown", 2: "pdfplumber"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo".encode())
    spark.dataSource.register(connectors.PagesSource)
    pages = spark.read.format("document_pages").option("paths", str(tmp_path / "a.txt")).load()
    assert sorted((r["page_num"], r["text"]) for r in pages.collect()) == [(1, "one"), (2, "two")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.json").write_text('{"event": "fallback", "timestamp": 2.0}\nnot json\n{"event": "ok", "timestamp": 1.0}\n')
    assert connectors.read_audit(spark, str(tmp_path / "log"), "fallback").count() == 1
    (tmp_path / "m.md").write_text("# T\n\ntext")
    assert connectors.read_markdown(spark, str(tmp_path / "m.md")).first()["text"] == "# T\n\ntext"


def heap_walk(nodes, edges, starts, plan):
    """The walk as a priority queue: what the levels have to equal."""
    used, seen, order, tokens = dict.fromkeys(plan.pointers, 0), set(), [], 0
    queue = [(0.0, s, 0) for s in starts]
    heapq.heapify(queue)
    trail = []
    while queue and len(order) < plan.max_nodes and tokens < plan.budget:
        _, n, d = heapq.heappop(queue)
        if n in seen or n not in nodes or d > plan.max_depth:
            continue
        kind, text, span = nodes[n]
        if plan.require_span and kind in traversal.SPAN_GATED and not span:
            continue
        seen.add(n)
        order.append(n)
        tokens += len(text) // 4
        if d >= plan.max_depth:
            continue
        for t in plan.pointers:
            if used[t] >= plan.edge_cap:
                continue
            near = {}
            for e in sorted((e for e in edges if e[3] == t and e[4] >= plan.min_confidence and e[1] != e[2] and e[1] == n), key=lambda e: (-e[5], e[6], e[0])):
                near.setdefault(e[2], e)
            if t in traversal.BOTH_WAYS:
                for e in sorted((e for e in edges if e[3] == t and e[4] >= plan.min_confidence and e[1] != e[2] and e[2] == n), key=lambda e: (-e[5], e[6], e[0])):
                    near.setdefault(e[1], e)
            used[t] += len(near)
            for m, e in near.items():
                trail.append((n, t, m))
                if m not in seen:
                    heapq.heappush(queue, ((d + 1) * 100 + e[6] * 10 - e[5] * 3 - e[4] * 2, m, d + 1))
    return order, sorted(trail)


@pytest.mark.parametrize("seed", range(4))
def test_walk_equals_the_priority_queue(spark, seed):
    r = random.Random(seed)
    plan = traversal.WalkPlan("test", ("supports", "belongs_to", "contradicts"), 3, r.choice([5, 12, 40]), r.choice([3, 8, 100]), r.choice([40, 4000]))
    names = [f"n{i:02d}" for i in range(25)]
    nodes = {n: (r.choice(["claim", "section"]), "x" * r.randrange(0, 40), r.random() < 0.9) for n in names}
    edges = [(f"e{i:03d}", r.choice(names), r.choice(names), r.choice(plan.pointers), round(r.random(), 2), round(r.random(), 2), round(r.uniform(0, 9), 1)) for i in range(90)]
    nf = spark.createDataFrame([(n, k, "g", t, 0.5, 0.5, s) for n, (k, t, s) in nodes.items()], "node_id string, node_type string, graph_id string, text string, confidence double, importance double, has_span boolean")
    ef = spark.createDataFrame(edges, "relation_id string, source_id string, target_id string, relation_type string, confidence double, importance double, cost double")
    starts = ["n00", "n07", "missing"]
    got = traversal.walk(nf, ef, starts, plan)
    order, trail = heap_walk(nodes, edges, starts, plan)
    assert [x["node_id"] for x in got.visited.orderBy("pop_order").collect()] == order
    if got.stop == "exhausted":
        assert sorted((x["node"], x["type"], x["neighbor"]) for x in got.edges.collect()) == trail


def test_bridge_rules_in_order(spark):
    rows = [
        ("g1", "concept:cell", "cell", "topic", []), ("g2", "entity:cell", "zzz", "topic", []), ("g2", "concept:nucleus", "qqq", "method", []),
        ("g1", "concept:nucleus", "www", "entity", []), ("g1", "framework:f", "ff", "framework", []), ("g3", "concept:c", "kk", "concept", ["x"]), ("g4", "framework:g", "gg", "framework", ["x"]),
    ]
    c = spark.createDataFrame([(*r, "active") for r in rows], "graph_id string, concept_key string, label string, namespace string, aliases array<string>, status string")
    got = {(r["concept_key_a"], r["concept_key_b"]): (r["bridge_type"], r["confidence"], r["review_status"]) for r in linkage.bridge_candidates(c).collect()}
    assert got == {
        ("concept:cell", "entity:cell"): ("same_as", 0.8, "active"), ("concept:nucleus", "concept:nucleus"): ("same_as", 0.8, "candidate"),
        ("framework:f", "concept:c"): ("applies_to", 0.3, "candidate"), ("concept:c", "framework:g"): ("same_as", 0.5, "candidate"),
    }


def test_transfer_walks_bridges(spark, monkeypatch):
    nodes = spark.createDataFrame([(n, "section", g, "", 1.0, 1.0, True) for n, g in [("a", "g1"), ("b", "g2"), ("c", "g3"), ("d", "g4"), ("e", "g5"), ("x", "g2"), ("y", "g2"), ("z", "g2")]], "node_id string, node_type string, graph_id string, text string, confidence double, importance double, has_span boolean")
    edges = spark.createDataFrame([], "relation_id string, source_id string, target_id string, relation_type string, confidence double, importance double, cost double")
    made = [("g1", "a", "b", "analogous_to", "active", 0.9), ("g2", "b", "c", "transfers_to", "active", 0.9), ("g3", "c", "d", "applies_to", "active", 0.9), ("g4", "d", "e", "applies_to", "active", 0.9)]
    made += [("g9", "a", "x", "analogous_to", "active", 0.9), ("g1", "a", "y", "analogous_to", "candidate", 0.9), ("g1", "a", "z", "same_as", "active", 0.9)]
    bridges = spark.createDataFrame([(*m, 5.0) for m in made], "source_graph_id string, source_id string, target_id string, bridge_type string, review_status string, confidence double, cost double")
    monkeypatch.setattr(answers, "open_store", lambda spark, sf: answers.GraphStore(nodes, edges, answers.both_ways(edges), nodes, bridges))
    monkeypatch.setattr(traversal, "_starts", lambda store: ["a"])
    got = catalog.QUERIES["walk_transfer"](spark, "")
    assert [r["node_id"] for r in got.orderBy("pop_order").collect()] == ["a", "b", "c", "d"]  # three jumps and no more


def test_keywords_and_titles(spark):
    rows = [
        ("光合作用的过程，叶绿体吸收光能。类囊体薄膜", "光合作用", "context", ""), ("the chloroplast absorbs light energy. chloroplast again, chloroplast", "", "content", ""), ("", "h", "structural", "toc"), ("of the", "", "context", ""), ("x", "x", "noise", ""), ("some preface", "h", "front", "t"),
    ]
    d = spark.createDataFrame(rows, "t string, h string, r string, c string")
    got = d.select(keywords.summary(F.col("t"), F.col("h")).alias("k"), keywords.titles(F.col("h"), F.col("t"), F.col("r"), F.col("c")).alias("x")).collect()
    assert [g["k"] for g in got] == ["叶绿体吸收光能类囊体薄膜", "absorbs", "", "", "", "preface"]
    assert [tuple(g["x"]) for g in got] == [("光合作用", "光合作用｜叶绿体吸收光能类囊体薄膜"), ("absorbs", "absorbs"), ("toc", "toc"), ("", "of the"), ("", ""), ("t", "h")]
    assert d.select(keywords.older_title(F.col("h"), F.col("t"), F.lit("context_heading")).alias("x")).first()["x"].startswith("光合作用｜")


def test_leading_numbers_of_pages(spark):
    s = spark.createDataFrame([(1, 1, "144 the text"), (1, 2, "2007 年 text"), (1, 3, "144 again"), (1, 4, "3 章 x"), (1, 5, "no number"), (2, 1, "7\tbody")], "doc_id long, ord int, text string")
    n = repair.page_numbers(s)
    assert sorted((r["doc_id"], r["number"], r["n"], r["context"], r["is_page"]) for r in n.collect()) == [(1, "144", 2, "144 the text", True), (2, "7", 1, "7\tbody", True)]
    assert [r["text"] for r in repair.without_page_numbers(s, n).orderBy("doc_id", "ord").collect()] == ["the text", "2007 年 text", "again", "3 章 x", "no number", "body"]


def test_parsers_of_files(spark, tmp_path):
    for name, text in (("a.pdf", "one\ftwo"), ("b.pdf", "")):
        (tmp_path / name).write_bytes(text.encode())
    got = connectors.read_pages(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["page"], r["text"]) for r in got) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]  # an empty file has no page

    def broken(data):
        raise ImportError("no such library")

    extract = connectors.first_that_works(broken, lambda d: [""], lambda d: ["知\n识\n图"], recognize=lambda d: ["seen"])
    assert extract(b"") == ["seen"] and connectors.first_that_works(broken)(b"") == [] and connectors.first_that_works(lambda d: ["text"])(b"") == ["text"]
    sources = spark.createDataFrame([("x/a.pdf",), ("x/b.pdf",), ("x/c.md",), ("x/d.pdf",)], "path string")
    files = spark.createDataFrame([("x/a.markdown",), ("x/a.md",), ("data/parsed_markdown/b.md",), ("x/c.md",)], "path string")
    assert {r["source"]: r["markdown"] for r in connectors.sidecars(sources, files).collect()} == {"x/a.pdf": "x/a.md", "x/b.pdf": "data/parsed_markdown/b.md", "x/c.md": "x/c.md"}
    made = spark.createDataFrame([("s", "o/a.md", 5), ("s", "o/b.MD", 9), ("s", "o/c.txt", 99)], "source string, path string, size int")
    assert connectors.largest_markdown(made).first()["markdown"] == "o/b.MD"
    docs = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    assert connectors.convert(docs, lambda path, data: [("a.md", "short"), ("b.md", "the longer"), ("c.txt", "x" * 99)]).first()["text"] == "the longer"
    calls = []

    def post(path, data):
        calls.append(path)
        return "application/json", '{"results": {"f": {"md_content": "# T"}}}'

    assert connectors.ask_service(docs, post).first()["text"] == "# T"
    bodies = [("application/json", '{"md": "m", "text": "t"}', "m"), ("application/json; x", '{"results": {"a": {"other": 1}}}', None), ("text/markdown", "# raw", "# raw"), ("application/json", '{"results": {"a": {"text": "n"}}, "md": "top"}', "n")]
    frame = spark.createDataFrame([b[:2] for b in bodies], "c string, b string").select(connectors.markdown_of_response(F.col("c"), F.col("b")).alias("r"))
    assert [r["r"] for r in frame.collect()] == [b[2] for b in bodies]
    for name in ("docling", "mineru_api", "pymupdf", "pdfplumber", "marker_markdown"):
        assert connectors.create_parser(name)
    with pytest.raises(ValueError):
        connectors.create_parser("none")


def test_vector_index_and_embedding(spark, tmp_path):
    index = connectors.VectorIndex(spark, f"{tmp_path}/v")
    texts = spark.createDataFrame([(f"c{i}", "gh"[i % 2], f"text {i}") for i in range(6)], "id string, graph_id string, text string")
    vectors = connectors.embed(texts, "id", "text", lambda ts: [[float(t.split()[1]), 0.0] for t in ts])
    index.build(texts.join(vectors, "id"))
    assert [r["id"] for r in index.search([2.2, 0.0], 3).collect()] == ["c2", "c3", "c1"]
    assert [r["id"] for r in index.search([2.2, 0.0], 3, ("g",)).collect()] == ["c2"]
    index.delete_graph("g")
    assert [r["id"] for r in index.search([2.2, 0.0], 3).collect()] == ["c3", "c1", "c5"]


def test_settings_and_endpoints(tmp_path):
    env = {"GRAPNEL_MODEL": "all", "GRAPNEL_REVIEW_MODEL": "own", "GRAPNEL_REVIEW_API_KEY": "abcdefghijklmnop"}
    e = config.endpoints(env)
    assert (e["default"].model, e["review"].model) == ("all", "own") and e["review"].public()["api_key"] == "" and e["review"].public()["api_key_masked"] == "abc…mnop"
    assert config.segmenter("auto", e["review"]) == "model" and config.segmenter("auto", e["segment"]) == "rule"
    path, base = str(tmp_path / "s.json"), {"a": {"b": 1, "c": 2}}
    assert config.load(path, base) == base
    config.save(path, base, {"a": {"b": 9}, "d": 4})
    assert config.load(path, base) == {"a": {"b": 9, "c": 2}, "d": 4} and base == {"a": {"b": 1, "c": 2}}


def test_progress_extras(spark, tmp_path):
    rows = [(1, 1, 0.0), (1, 2, 0.3), (1, 3, 9.0), (1, 4, 40.0), (1, 5, 41.0), (2, 6, 5.0)]
    e = spark.createDataFrame([(u, i, t) for u, i, t in rows], "user_id long, event_id long, t double").select("user_id", "event_id", F.timestamp_micros((F.lit(10**15) + F.col("t") * 1_000_000).cast("long")).alias("ts"))
    assert [(r["event_id"], r["tick"], r["sent"]) for r in progress.polled(e, 0.5, 20).orderBy("event_id").collect()] == [(1, 0, True), (2, 1, True), (3, 18, True), (4, 80, False), (5, 82, False), (6, 0, True)]
    beats = progress.with_heartbeats(e, 15).where("kind = 'heartbeat'").collect()
    assert len(beats) == 2
    assert progress.removed(e, e.where("user_id = 1")).count() == 1 and progress.opened(e.limit(1)).first()["seq"] == 0
    seen = []
    e.write.parquet(f"{tmp_path}/e.parquet")
    q = progress.stream_upsert(spark, f"{tmp_path}/e.parquet", e.withColumns({"event_type": F.lit("x"), "value": F.lit(1.0)}).schema, lambda frame, batch: seen.append(frame.count()), f"{tmp_path}/c")
    q.awaitTermination()
    assert sum(seen) == 2


def test_logs_are_appended(spark, tmp_path):
    for n in (1, 2):
        connectors.write_log(spark.createDataFrame([("found", f"p{n}", float(n))], "event string, paper_id string, timestamp double"), f"{tmp_path}/log")
    assert [r["paper_id"] for r in connectors.read_audit(spark, f"{tmp_path}/log", "found").orderBy("timestamp").collect()] == ["p1", "p2"]


def test_title_pairs_against_all_pairs(spark):
    r = random.Random(9)
    words = ["graph", "cell", "theory", "of", "deep", "learning", "models", "🙂é", "noise", "a"]
    titles = [(i, " ".join(r.choices(words, k=r.randrange(1, 7)))) for i in range(60)] + [(60, "Deep  Learning"), (61, "deep learning"), (62, "ab")]
    flat = {i: " ".join(t.lower().split()) for i, t in titles}
    first = {}
    for i, t in flat.items():
        first.setdefault(t, i)
    sets = {i: {t} if len(t) < 3 else {t[j : j + 3] for j in range(len(t) - 2)} for t, i in first.items()}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    frame = spark.createDataFrame(titles, "k long, t string")
    assert {(x["a"], x["b"]): x["jaccard"] for x in linkage.jaccard_pairs(frame, "k", "t").collect()} == want
    found = {(x["a"], x["b"]): round(x["jaccard"], 6) for x in linkage.minhash_pairs(frame, "k", "t").collect()}
    assert found.items() <= want.items() and len(found) >= 0.9 * len(want)
    assert {x["k"]: x["first"] for x in linkage.title_classes(frame, "k", "t").collect()} == {i: first[t] for i, t in flat.items()}
