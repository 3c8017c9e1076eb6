"""Queries against their SQL on small tables that hold what the given tables hold rarely or never."""

import duckdb

from grapnel import catalog
from tests.test_oracles import plain

LINE = "Words of a plain line that is long enough for a section"


def agrees(spark, folder, name, texts):
    """Rows of a query over ``texts`` (doc_id by position, from 1), which have to be those of its SQL."""
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    frame = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    relation = con.sql(catalog.ORACLES[name])
    at = [list(relation.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == want
    return [dict(zip(columns, r)) for r in got]


def test_label_before_dropped_texts_goes_with_them(spark, tmp_path):
    """A first line of few letters is a label; the texts after it go, as no heading stands before them."""
    label = "12 +1 (607) 555-6433 48.95.59.146 4756652817084003 a"
    first = "\n".join([label, *(f"{LINE} {x}" for x in "bcdefghij")])
    second = "\n".join([*(f"{LINE} {x}" for x in "abcde"), label, *(f"{LINE} {x}" for x in "ghij")])
    got = agrees(spark, tmp_path, "document_sections", [first, second, label])
    assert {r["heading"] for r in got if r["doc_id"] == 1} == {f"{LINE} f"}
    assert [r["heading"].startswith("+1 (607)") or r["heading"].startswith("12 +1") for r in sorted((r for r in got if r["doc_id"] == 2), key=lambda r: r["ord"])] == [False] * 4 + [True] + [False] * 3


def test_shares_of_blocks_at_their_bounds(spark, tmp_path):
    """63 of 180 blocks are 35 % and not more; 1 of 5 is 20 % and not more.  In doubles, 180 * 0.35 is below 63."""
    low, high, short = "x" * 60, "x" * 100, "x" * 20 + " " + "y" * 20  # confidence 0.4, 0.8, 0.81
    made = lambda *parts: "\n".join(t for t, n in parts for _ in range(n))
    texts = [made((low, 63), (high, 117)), made((low, 64), (high, 116)), made((low, 119), (high, 221)), made((short, 1), (high, 4)), made((short, 2), (high, 3))]
    got = agrees(spark, tmp_path, "quality_gate", texts)
    assert [r["reasons"] for r in got] == ["", "low_confidence", "", "", "short_blocks"]
