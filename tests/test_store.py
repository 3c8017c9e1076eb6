"""The written store, repairs, window merging, concepts and answers, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from grapnel.operators import answers, concepts, mending, segments, traversal
from grapnel.sources.tables import TABLES, Tables


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/store")


def test_tables_insert_upsert_update_delete(spark, store):
    store.create()
    assert {r["n"] for r in store.counts().collect()} == {0} and store.counts().count() == len(TABLES) == 24
    cards = spark.createDataFrame([("p1", "g1", "One", 1999), ("p2", "g1", "Two", None), ("p3", "g2", None, 2001)], "paper_id string, graph_id string, title string, year int")
    store.insert("paper_cards", cards)
    got = {r["paper_id"]: r for r in store.read("paper_cards").collect()}
    assert got["p3"]["title"] == "" and got["p2"]["year"] is None and got["p1"]["authors"] == [] and got["p1"]["research_type"] == "other" and got["p1"]["created_at"] is not None
    with pytest.raises(ValueError, match="not new"):
        store.insert("paper_cards", cards.limit(1))
    with pytest.raises(ValueError, match="no column"):
        store.insert("paper_cards", cards.withColumn("odd", F.lit(1)))
    store.insert_new("paper_cards", spark.createDataFrame([("p1", "other"), ("p4", "g2"), ("p4", "g2")], "paper_id string, graph_id string"))
    assert sorted(r["paper_id"] for r in store.read("paper_cards").collect()) == ["p1", "p2", "p3", "p4"]
    store.upsert("paper_cards", spark.createDataFrame([("p1", "g9", "new"), ("p5", "g9", "five")], "paper_id string, graph_id string, title string"))
    assert store.update("paper_cards", F.col("graph_id") == "g9", {"year": F.lit(2020)}) == 2
    assert store.delete("paper_cards", F.col("paper_id") == "p4") == 1 and store.delete("paper_cards", F.col("paper_id") == "p4") == 0
    assert [(r["paper_id"], r["year"]) for r in store.list_top("paper_cards", "year", 3).collect()] == [("p1", 2020), ("p5", 2020), ("p3", 2001)]


def test_tables_cascade_and_views(spark, store):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    store.ensure_graph("g1")
    store.ensure_graph("g1")
    store.ensure_graph("g2")
    store.insert("paper_cards", frame([("p1", "g1"), ("p2", "g2")], "paper_id string, graph_id string"))
    store.insert("section_blocks", frame([("s1", "g1", "p1", 2), ("s2", "g1", "p1", 1), ("s3", "g2", "p2", 1)], "section_id string, graph_id string, paper_id string, global_order_index int"))
    store.insert("claim_blocks", frame([("c1", "g1", "p1", "candidate"), ("c2", "g2", "p2", "candidate")], "claim_id string, graph_id string, paper_id string, status string"))
    store.insert("graph_relations", frame([("r1", "g1", "c1", "s1"), ("r2", "g2", "c2", "s3")], "relation_id string, graph_id string, source_id string, target_id string"))
    store.insert("concept_keys", frame([("concept:a", "g1"), ("concept:a", "g2")], "concept_key string, graph_id string"))
    store.insert("source_spans", frame([("x2", "p1", 9), ("x1", "p1", 3)], "span_id string, paper_id string, char_start int"))
    store.insert("structure_groups", frame([("k1", "p1", 2), ("k2", "p1", 1)], "group_id string, paper_id string, order_index int"))
    store.insert("group_members", frame([("k1", "s1", 2), ("k1", "s2", 1)], "group_id string, section_id string, member_order int"))
    for i, n in enumerate((3, 7)):
        store.insert("parse_quality_reports", frame([(f"q{i}", "p1", json.dumps({"total_elements": n}))], "report_id string, paper_id string, quality_json string"))
    store.insert("series_groups", frame([("z", ["g1"])], "group_id string, graph_ids array<string>"))
    assert store.add_to_group("z", "g2") == 1 and store.groups_of_graph("g2").count() == 1 and store.groups_of_graph("g3").count() == 0
    assert store.latest_report("p1").first()["n_elements"] == 7
    assert [r["span_id"] for r in store.spans("p1").collect()] == ["x1", "x2"]
    assert [(r["group_id"], r["members"]) for r in store.groups_with_members("p1").collect()] == [("k2", []), ("k1", ["s2", "s1"])]
    assert store.set_concept("concept:a", "active", "g1") == 1 and store.set_concept("concept:a", "merged", "g2", into="concept:b") == 1
    assert {r["graph_id"]: (r["status"], r["do_not_merge_with"]) for r in store.read("concept_keys").collect()} == {"g1": ("active", []), "g2": ("merged", ["concept:b"])}
    store.start_run(frame([("run1", "p1", "g1"), ("run2", "p1", "g1")], "run_id string, paper_id string, graph_id string"))
    assert store.finish_run("run1", 5, 4) == 1 and store.fail_run("run2", "no answer") == 1
    runs, counts = store.extraction_status("p1")
    assert sorted((r["status"], r["items_produced"]) for r in runs.collect()) == [("completed", 5), ("failed", 0)]
    assert counts.first().asDict() == {"total_claims": 1, "total_evidence": 0, "total_limitations": 0, "total_concepts": 1}
    out = store.export("g1")
    assert {k: v.count() for k, v in out.items()} == {"claims": 1, "evidence": 0, "limitations": 0, "concepts": 1, "relations": 1, "sections": 2}
    gone = store.delete_documents(frame([("p1",)], "paper_id string"))
    assert gone["section_blocks"] == 2 and gone["graph_relations"] == 1 and gone["group_members"] == 2 and gone["paper_cards"] == 1 and gone["series_graphs"] == 1 and gone["concept_keys"] == 1
    left = {r["table_name"]: r["n"] for r in store.counts().collect() if r["n"]}
    assert left == {"corpora": 1, "series_graphs": 1, "series_groups": 1, "paper_cards": 1, "section_blocks": 1, "claim_blocks": 1, "graph_relations": 1, "concept_keys": 1}


SECTION = "doc_id long, ord int, section_id string, heading string, level string, heading_confidence double, status string, page_start int, page_end int, text string"


def sections(spark, n=6, doc=1):
    return spark.createDataFrame([(doc, i, f"s{i}", f"h{i}" if i % 2 else "", "section", 1.0, "clean", i, i, f" text {i}\nmore ") for i in range(n)], SECTION)


@pytest.mark.parametrize("seed", range(4))
def test_merges_follow_the_order(spark, seed):
    r = random.Random(seed)
    n = 30
    wanted = sorted(r.sample([(i, i + 1) for i in range(n - 1)], 16)) + [(3, 5)]
    rows = [[f"s{i}", f" text {i}\nmore "] for i in range(n)]
    for a, b in wanted:
        ids = [x[0] for x in rows]
        if f"s{a}" in ids and f"s{b}" in ids and ids.index(f"s{b}") - ids.index(f"s{a}") == 1 and b == a + 1:
            i = ids.index(f"s{a}")
            rows[i][1] = rows[i][1].rstrip() + "\n\n" + rows[i + 1][1].lstrip()
            del rows[i + 1]
    got = mending.merge_pairs(sections(spark, n), spark.createDataFrame([(f"s{a}", f"s{b}") for a, b in wanted], "section_id string, other_id string"))
    assert [(x["section_id"], x["text"].strip()) for x in got.orderBy("ord").collect()] == [(a, t.strip()) for a, t in rows]


def test_repair_modes(spark):
    found = spark.createDataFrame([
        (1, "adjacent_merge", "s0", "s1", 0.9), (1, "heading_role", "s3", None, 0.5), (1, "heading_role", "s4", None, 0.4), (1, "toc_boundary", "s5", None, 0.8), (1, "front_matter_boundary", "s2", None, 0.3), (1, "chapter_boundary", "s2", "s3", 0.7), (1, "structure_gap", "s2", "s3", 0.4), (1, "heading_role", "s1", None, 0.5),
    ], "doc_id long, repair_type string, section_id string, other_id string, priority double")
    scores = {"adjacent_merge": 0.9, "toc_boundary": 0.6, "front_matter_boundary": 0.95, "chapter_boundary": 0.7, "structure_gap": 0.99}
    score = F.when(F.col("section_id") == "s4", 0.1).otherwise(F.coalesce(F.create_map(*(F.lit(x) for p in scores.items() for x in p))[F.col("repair_type")], F.lit(0.9)))
    said = spark.createDataFrame([(1, "toc_boundary", "s5", '{"is_toc": true, "confidence": 0.8}'), (1, "chapter_boundary", "s2", '{"action": "mark", "confidence": 0.6}')], "doc_id long, repair_type string, section_id string, answer string")
    s = sections(spark)
    same, seen = mending.repaired(s, found, score, "dry_run")
    assert {r["action"] for r in seen.collect()} == {"logged_only"} and same.count() == 6
    auto, told = mending.repaired(s, found, score, "auto_only", said)
    rows = {r["section_id"]: r for r in auto.collect()}
    assert set(rows) == {"s0", "s2", "s3", "s4", "s5"} and rows["s0"]["text"] == " text 0\nmore\n\ntext 1\nmore" and rows["s0"]["status"] == "reconstructed" and rows["s0"]["page_end"] == 1
    assert (rows["s3"]["heading"], rows["s3"]["level"], rows["s3"]["heading_confidence"], rows["s3"]["text"]) == ("", "paragraph_group", 0.4, "h3\n text 3\nmore ")
    assert (rows["s4"]["heading"], rows["s4"]["heading_confidence"]) == (" text 4", 0.6) and (rows["s2"]["heading"], rows["s2"]["heading_confidence"]) == ("前言", 0.5) and rows["s5"]["heading"] == "h5"
    full, decided = mending.repaired(s, found, score, "full", said)
    assert {r["section_id"]: r["heading"] for r in full.collect()}["s5"] == "目录"
    r = mending.report(decided, s, full).first()
    assert (r["candidates_found"], r["auto_fixed"], r["llm_triggered"], r["llm_applied"], r["sections_before"], r["sections_after"]) == (8, 6, 2, 1, 6, 5)
    assert mending.log_entries(decided, s, full, "full").where("after_state IS NOT NULL").count() == 6
    text = mending.judge_texts(found, s).where("repair_type = 'chapter_boundary'").first()["document"]
    assert text == "层级=section 标题=(无)\n→\n层级=section 标题=h3"


def test_quotes_slice_windows(spark):
    w = "Some Words  before.\nThe quick  brown fox\njumps over the lazy dog. And after."
    cases = [("", "the Quick brown", "lazy DOG.", "The quick brown fox\njumps over the lazy dog."), ("", "quick brown", "nowhere", "quick brown fox\njumps over the lazy dog. And after."), ("", "nowhere", "x", ""), ("written out by the model in full", "a", "b", "written out by the model in full"), ("short", None, None, "short")]
    rows = spark.createDataFrame([(w, *c[:3]) for c in cases], "w string, t string, a string, b string").select(segments.slice_by_quotes(F.col("w"), F.col("t"), F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in rows] == [c[3] for c in cases]


def test_windows_merge_in_order(spark):
    long = "A paragraph about cells that is long enough to be kept as one segment of the text. "
    said = [
        (1, 1, 1, 1, long * 2), (1, 2, 2, 2, "A label"), (2, 1, 1, 2, (long * 2).upper()), (2, 2, 1, 1, "is long enough to be kept as one segment of the text."), (2, 3, 2, 2, "A label of it"), (3, 1, 9, 9, long[:60] + " on another page"), (3, 2, 2, 2, (long * 2)[:-3] + "xyz "), (3, 3, 4, 4, long), (4, 1, 4, 4, long[:-32]),
    ]
    rows = [(1, w, n, t, "paragraph", "body", 0.9, a, b, 1.0, None, False) for w, n, a, b, t in said]
    frame = spark.createDataFrame(rows, "doc_id long, window_index int, seg_no int, text string, type string, role string, confidence double, page_start int, page_end int, score double, reason string, is_low boolean")
    got = {(r["window_index"], r["seg_no"]): r["dropped"] for r in segments.merged(frame).collect()}
    assert got == {(1, 1): None, (1, 2): None, (2, 1): "duplicate", (2, 2): "contained", (2, 3): None, (3, 1): None, (3, 2): None, (3, 3): None, (4, 1): "contained"}
    report = segments.window_report(segments.merged(frame), spark.createDataFrame([(1, 5), (2, 1)], "doc_id long, n_pages int"), spark.createDataFrame([(1, float(i), i == 3) for i in range(1, 21)], "doc_id long, seconds double, failed boolean")).orderBy("doc_id").collect()
    assert report[0]["p95_seconds"] == 19.0 and report[0]["body_start"] == 1 and "containment_duplicates_detected" in report[0]["reasons"] and report[0]["needs_review"]
    assert report[1]["reasons"] == ["paragraph_count_low_vs_pages", "body_start_unknown"]
    ends = spark.createDataFrame([(None, None), (9.0, 2.0), (3.0, None)], "a double, b double").select(*(c.alias(n) for c, n in zip(segments.clamped(F.col("a"), F.col("b"), F.lit(2.0), F.lit(5.0)), "xy"))).collect()
    assert [tuple(r) for r in ends] == [(2.0, 2.0), (5.0, 5.0), (3.0, 3.0)]
    assert [r["t"] for r in spark.createDataFrame([("Table_Text",), ("what",)], "t string").select(segments.element_type(F.col("t")).alias("t")).collect()] == ["table", "paragraph"]


def test_segments_are_judged(spark):
    w = spark.createDataFrame([(1, 1, 3, 6, "The first sentence of the page stands here. Another one follows it.")], "doc_id long, window_index int, first int, last int, text string")
    s = [(1, 1, i, t, a, b, k, r, c, p, q) for i, (t, a, b, k, r, c, p, q) in enumerate([
        ("The first sentence of the page", None, None, "body", None, "0.9", "1", "99"), ("nothing of the kind QZXW 0123456789 0123456789", None, None, "odd", "activity", None, None, None), ("short", "", "", "toc", None, "x", "4", None), ("", "the FIRST sentence", "follows it.", "heading", None, "0.2", "5", "4")])]
    got = segments.judged(spark.createDataFrame(s, "doc_id long, window_index int, seg_no int, text string, start_quote string, end_quote string, type string, role string, confidence string, page_start string, page_end string"), w).orderBy("seg_no").collect()
    assert [(r["reason"], r["page_start"], r["page_end"], r["is_low"]) for r in got] == [(None, 3, 6, False), ("alignment_failed", 3, 3, False), ("too_short", 4, 4, False), (None, 5, 5, True)]


def test_concepts_are_registered_in_order(spark):
    r = random.Random(2)
    names = [f"k{i}" for i in range(8)]
    known = [("g", "k0", ["a", "b"]), ("h", "k1", ["c"])]
    new = [(i, r.choice("gh"), r.choice(names), r.sample("abcdefgh", 2), r.choice(["strict", "open", "open"])) for i in range(40)]
    taken = {("g", "k0"), ("h", "k1")}
    held = {("g", "a"), ("g", "b"), ("h", "c")}
    want = []
    for _i, g, k, al, policy in new:
        if (g, k) in taken:
            want.append("reject_duplicate")
            continue
        want.append("needs_review" if policy == "strict" or any((g, x) in held for x in al) else "accept_candidate")
        taken.add((g, k))
        held |= {(g, x) for x in al}
    got = concepts.register_in_order(spark.createDataFrame(new, "seq long, graph_id string, concept_key string, aliases array<string>, merge_policy string"), spark.createDataFrame(known, "graph_id string, concept_key string, aliases array<string>"))
    assert [x["decision"] for x in got.orderBy("seq").collect()] == want


def test_concept_terms_keys_and_lookup(spark):
    one = lambda rule, *v: spark.createDataFrame([v], ", ".join(f"v{i} string" for i in range(len(v)))).select(rule(*(F.col(f"v{i}") for i in range(len(v)))).alias("r")).first()["r"]
    for raw, want in ((" 细胞，", "细胞"), ("教育", ""), ("我们认为", ""), ("x" * 25, ""), (None, ""), ("a  b", "a b")):
        assert one(concepts.clean_term, raw) == want
    assert one(lambda t: concepts.clean_term(t, english=True), "one two three four five six seven") == ""
    for ns, term, english, key in (("framework", "Cpe 3-df model of all things", "", "framework:CPE_3_DF_MODEL_OF_AL"), ("concept", "认知负荷", "x", "concept:cognitive_load"), ("method", "虚拟", "Virtual Lab!", "method:Virtual_Lab"), ("concept", "Deep-Learning net", "", "concept:deep_learning_net"), ("concept", "细胞", "", "concept:" + hashlib.md5("细胞".encode()).hexdigest()[:8])):
        assert one(concepts.canonical_key, ns, term, english) == key
    c = spark.createDataFrame([("g", "concept:a", "cell", ["unit", "x"], []), ("g", "concept:b", "unit", ["x"], ["concept:a"]), ("g", "concept:c", "z", ["x", "unit"], [])], "graph_id string, concept_key string, label string, aliases array<string>, do_not_merge_with array<string>")
    t = spark.createDataFrame([("g", "unit"), ("g", "none")], "graph_id string, term string")
    assert [(r["concept_key"], r["how"]) for r in concepts.lookup(t, c).orderBy("place").collect()] == [("concept:b", "label"), ("concept:a", "alias"), ("concept:c", "alias")]
    b = spark.createDataFrame([("b1", "g", ["unit", "method:q", "gone", "concept_x:1"]), ("b2", "g", ["gone"])], "block_id string, graph_id string, terms array<string>")
    assert [(r["block_id"], r["concept_keys"]) for r in concepts.resolve_blocks(b, c).collect()] == [("b1", ["concept:b", "method:q"])]
    pairs = concepts.conflicts(c)
    assert sorted((r["a"], r["b"], tuple(r["overlap"])) for r in pairs.collect()) == [("concept:a", "concept:c", ("unit", "x")), ("concept:b", "concept:c", ("x",))]
    assert concepts.conflict_items(pairs).where("priority = 'high'").count() == 2
    change = spark.createDataFrame([("concept:a", "g", "activate", None), ("concept:b", "g", "merge", "concept:a")], "concept_key string, graph_id string, action string, into string")
    done = concepts.set_status(c.withColumns({"status": F.lit("candidate"), "review_status": F.lit("pending")}), change)
    assert {r["concept_key"]: (r["status"], r["review_status"]) for r in done.collect()} == {"concept:a": ("active", "approved"), "concept:b": ("merged", "pending"), "concept:c": ("candidate", "pending")}
    al = spark.createDataFrame([(["a", " a ", None, "y" * 49, "b，"],)], "x array<string>").select(concepts.clean_aliases(F.col("x"), F.lit("L"), F.lit("a")).alias("r"), concepts.short_terms(F.array(F.lit(" tag: one "), F.lit("one"), F.lit("方法"), F.lit("z" * 33))).alias("s")).first()
    assert al["r"] == ["a", "b", "L"] and al["s"] == ["one"]


def test_answers_become_blocks(spark):
    answer = "```json\n" + json.dumps({"c": [{"text": "A claim", "type": "empirical", "confidence": 7, "terms": ["x: y"]}, {"text": ""}, {"text": "B", "type": "odd"}], "e": [{"text": "E", "strength": "strong", "claims": [0, 1, 9, 0]}], "l": [{"text": "L", "type": "scope", "claims": [2]}]}) + "\n```"
    claims, evidence, limits, edges = concepts.parse_blocks(spark.createDataFrame([("s1", answer), ("s2", "no json at all"), ("s3", None)], "section_id string, answer string"))
    assert sorted((r["claim_id"], r["claim_type"], r["extraction_confidence"], tuple(r["concept_keys"])) for r in claims.collect()) == [("c-s1-0", "empirical", 1.0, ("y",)), ("c-s1-2", "theoretical", 0.5, ())]
    assert evidence.first()["strength"] == "strong" and evidence.first()["evidence_type"] == "other" and limits.first()["risk_type"] == "scope"
    assert sorted(map(tuple, edges.collect())) == [("e-s1-0", "c-s1-0", "supports", 0.8), ("l-s1-0", "c-s1-2", "constrains", 0.8)]
    got = concepts.parse_concepts(spark.createDataFrame([("s1", json.dumps({"concepts": [{"namespace": "Method", "term": "虚拟实验", "aliases": ["VL"], "parent": "细胞"}, {"term": "教育"}]}))], "section_id string, answer string")).collect()
    assert [(r["concept_key"], r["aliases"], r["parents"]) for r in got] == [("method:virtual_lab", ["VL", "虚拟实验"], ["细胞"])]
    card = concepts.cards(spark.createDataFrame([("p1", "f.pdf", '{"title": "T", "year": 2001, "research_type": "odd"}'), ("p2", "g.pdf", "?")], "paper_id string, source_file string, answer string")).orderBy("paper_id").collect()
    assert [(r["title"], r["year"], r["research_type"], r["keywords"]) for r in card] == [("T", 2001, "other", []), ("g.pdf", None, "other", [])]
    best = concepts.model_matches(spark.createDataFrame([("p", f"g{i}", i, json.dumps({"score": s})) for i, s in enumerate((10, 70, 90), 1)], "paper_id string, group_id string, rank int, answer string")).first()
    assert (best["group_id"], best["confidence"]) == ("g2", 0.7)
    assert concepts.new_groups(spark.createDataFrame([("p", "g", "T" * 60, "")], "paper_id string, graph_id string, title string, main_framework string")).first()["name"] == "T" * 50


@pytest.mark.parametrize("seed", range(3))
def test_many_walks_are_single_walks(spark, seed):
    r = random.Random(seed)
    plan = traversal.WalkPlan("test", ("supports", "belongs_to", "contradicts"), 3, r.choice([5, 12]), r.choice([3, 8]), r.choice([40, 400]), ("applies_to",), 3)
    names = [f"n{i:02d}" for i in range(24)]
    nodes = spark.createDataFrame([(n, r.choice(["claim", "section"]), r.choice("gh"), "x" * r.randrange(0, 60), 0.5, 0.5, r.random() < 0.9) for n in names], "node_id string, node_type string, graph_id string, text string, confidence double, importance double, has_span boolean").cache()
    edges = spark.createDataFrame([(f"e{i:03d}", r.choice(names), r.choice(names), r.choice(plan.pointers), round(r.random(), 2), round(r.random(), 2), round(r.uniform(0, 9), 1)) for i in range(80)], "relation_id string, source_id string, target_id string, relation_type string, confidence double, importance double, cost double").cache()
    bridges = spark.createDataFrame([(r.choice("gh"), r.choice(names), r.choice(names), "applies_to", "active", 0.9, 5.0) for _ in range(20)], "source_graph_id string, source_id string, target_id string, bridge_type string, review_status string, confidence double, cost double").cache()
    store = answers.GraphStore(nodes, edges, answers.both_ways(edges), nodes, bridges)
    asked = {q: r.sample(names, 3) + ["missing"] for q in range(4)}
    visited, steps = answers.walk_many(store, spark.createDataFrame([(q, n) for q, ns in asked.items() for n in ns], "question_id long, node_id string"), plan)
    visited, steps = visited.collect(), steps.collect()
    for q, starts in asked.items():
        one = traversal.walk(nodes, edges, starts, plan, bridges)
        assert [x["node_id"] for x in sorted((v for v in visited if v["question_id"] == q), key=lambda v: v["pop_order"])] == [x["node_id"] for x in one.visited.orderBy("pop_order").collect()]
        if one.stop == "exhausted":
            assert sorted((s["node"], s["type"], s["neighbor"]) for s in steps if s["question_id"] == q) == sorted((s["node"], s["type"], s["neighbor"]) for s in one.edges.collect())


def test_linked_walk_uses_edges_where_pointers_lack(spark):
    s = spark.createDataFrame([("a", None, "b"), ("b", "a", None), ("c", "b", "d"), ("d", "c", "gone")], "section_id string, prev_id string, next_id string")
    e = spark.createDataFrame([("b", "x", "section_next", 0.1), ("b", "c", "section_next", 0.4)], "source_id string, target_id string, relation_type string, importance double")
    seeds = spark.createDataFrame([("b",), ("nowhere",)], "section_id string")
    assert sorted((r["section_id"], r["offset"]) for r in answers.linked_walk(s, seeds, 2, e).collect()) == [("a", -1), ("b", 0), ("c", 1), ("d", 2)]
    assert answers.intent("q" * 60, "audit") == "audit:" + "q" * 50


def test_edges_are_completed_once(spark, store):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    store.insert("section_blocks", frame([("s1", "g", "p", 1, ["A", "B"], "first words"), ("s2", "g", "p", 2, ["A", "C"], "other text"), ("s3", "g", "q", 1, ["A"], "more words")], "section_id string, graph_id string, paper_id string, global_order_index int, heading_path array<string>, raw_text string"))
    store.insert("claim_blocks", frame([("c1", "g", "p", "s1", "a claim", ["concept:a_b", "concept:x"]), ("c2", "g", "p", None, "b", [])], "claim_id string, graph_id string, paper_id string, section_id string, claim_text string, concept_keys array<string>"))
    store.insert("evidence_blocks", frame([("e1", "g", "p", "s2", ["c1", "c2"], ["concept:x"])], "evidence_id string, graph_id string, paper_id string, section_id string, supports_claim_ids array<string>, concept_keys array<string>"))
    store.insert("limitation_blocks", frame([("l1", "g", "p", "s2", ["c1"])], "limitation_id string, graph_id string, paper_id string, section_id string, affected_claim_ids array<string>"))
    store.insert("graph_relations", frame([("r1", "g", "c1", "concept:gone", "mentions"), ("r2", "g", "c1", "s1", "belongs_to")], "relation_id string, graph_id string, source_id string, target_id string, relation_type string"))
    store.insert("concept_keys", frame([("concept:x", "g")], "concept_key string, graph_id string"))
    assert store.connectivity("g").first().asDict() == {"blocks_without_belongs_to": 3, "missing_concept_nodes": 1, "paragraphs": 3, "claims": 2, "evidence": 1, "limitations": 1, "concepts": 1}
    assert store.complete_edges("g") == {"section_next": 1, "belongs_to": 2, "mentions": 2, "evidence_supports": 2, "limitation_constrains": 1, "concepts_created": 1}
    assert set(store.complete_edges("g").values()) == {0}
    assert {r["label_zh"] for r in store.read("concept_keys").collect()} == {"", "a b"}
    assert sorted((r["node_type"], r["block_id"]) for r in store.blocks_of_concept("concept:x").collect()) == [("claim", "c1"), ("evidence", "e1")]
    assert [r["section_id"] for r in store.search("section_blocks", "WORDS x").collect()] == ["s1", "s3"]
    assert [(r["level"], r["title"]) for r in store.outline("p").collect()] == [(1, "A")]
    store.upsert("outline_nodes", frame([("o2", "p", "Two", 2), ("o1", "p", "One", 1)], "outline_id string, paper_id string, title string, order_index int"))
    assert [r["title"] for r in store.outline("p").collect()] == ["One", "Two"]
