"""The knowledge store as versioned Parquet tables: schemas, inserts, upserts, updates, deletes.

A table is a folder of versions.  Inserts add files to the current version; whatever changes rows writes the
next version from the current one and is seen once its ``_SUCCESS`` mark is there, so a lost executor or
driver leaves the old version in force.  There is one writer at a time.  The two latest versions are kept,
so frames that were read before a change can still be used.

Changes are joins and ``when`` over whole tables, never row by row; the numbers of rows they touched are
the only thing that reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from grapnel.operators.store import text_search
from grapnel.scratch import materialize


@dataclass(frozen=True)
class Table:
    """Columns with their defaults (None: null), and the columns that identify a row."""

    key: tuple[str, ...]
    fields: tuple[tuple[str, str, object], ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in self.fields))


_KINDS = {"s": ("string", ""), "n": ("string", None), "i": ("int", 0), "p": ("int", None), "d": ("double", 0.0), "a": ("array<string>", "[]"), "b": ("boolean", False), "t": ("timestamp", "now"), "u": ("timestamp", None)}


def _table(key: str, text: str) -> Table:
    """``name:kind[=default]`` by blanks: s text, n text or null, i int, p int or null, d double, a array, b flag, t now, u time or null."""
    fields = []
    for word in text.split():
        name, _, rest = word.partition(":")
        kind, _, default = rest.partition("=")
        sql, usual = _KINDS[kind]
        fields.append((name, sql, usual if not default else type(usual)(default) if isinstance(usual, (int, float)) else default))
    return Table(tuple(key.split()), tuple(fields))


# Table formats (names, columns, kinds, defaults).
TABLES: dict[str, Table] = {
    "corpora": _table("corpus_id", "corpus_id:s name:s corpus_type:s=paper_collection domain:s description:s source_items:a integration_policy:s=bridge_review created_at:t updated_at:t"),
    "series_graphs": _table("graph_id", "graph_id:s corpus_id:s name:s graph_type:s=paper_collection domain:s description:s concept_namespace:s merge_policy:s=review_required cross_graph_policy:s=strict status:s=building created_at:t updated_at:t"),
    "series_groups": _table("group_id", "group_id:s name:s graph_ids:a domain:s description:s confidence:d=0.5 created_at:t updated_at:t"),
    "paper_cards": _table("paper_id", "paper_id:s graph_id:s title:s authors:a year:p source_file:s abstract:s abstract_summary:s keywords:a research_type:s=other main_framework:s raw_text_hash:s page_count:i created_at:t updated_at:t"),
    "section_blocks": _table("section_id", """section_id:s graph_id:s paper_id:s heading:s heading_path:a heading_level:s=section heading_confidence:d=1.0 display_title:s structure_status:s=clean
        chapter_index:i section_index:i block_index:i global_order_index:i raw_text:s summary:s keyword_summary:s block_role:s=content structure_title:s group_id:n page_start:p page_end:p toc_anchor_id:n toc_anchor_title:n
        parser_name:s parser_element_id:s parser_confidence:d=1.0 concept_keys:a parent_section_id:n prev_section_id:n next_section_id:n content_hash:s created_at:t updated_at:t"""),
    "source_spans": _table("span_id", """span_id:s paper_id:s section_id:n span_type:s=paragraph source_text:s char_start:i char_end:i page_start:p page_end:p line_start:p line_end:p pdf_bbox:n content_hash:s normalized_text:n
        verified:b verified_by:n verified_at:u created_at:t updated_at:t"""),
    "claim_blocks": _table("claim_id", """claim_id:s graph_id:s paper_id:s section_id:n claim_text:s normalized_claim:s claim_type:s=theoretical concept_keys:a evidence_refs:a limitation_refs:a extraction_confidence:d claim_confidence:d
        importance:s=supporting status:s=candidate source_span_id:n extraction_run_id:n created_at:t updated_at:t"""),
    "evidence_blocks": _table("evidence_id", "evidence_id:s graph_id:s paper_id:s section_id:n supports_claim_ids:a evidence_text:s evidence_type:s=other strength:s=unassessed concept_keys:a source_span_id:n extraction_run_id:n status:s=candidate created_at:t updated_at:t"),
    "limitation_blocks": _table("limitation_id", "limitation_id:s graph_id:s paper_id:s section_id:n limitation_text:s affected_claim_ids:a risk_type:s=other severity:s=unassessed concept_keys:a source_span_id:n extraction_run_id:n status:s=candidate created_at:t updated_at:t"),
    "concept_keys": _table("concept_key graph_id", """concept_key:s graph_id:s namespace:s=concept label_zh:s label_en:s definition:s aliases:a parent_keys:a child_keys:a related_keys:a do_not_merge_with:a status:s=candidate review_status:s=pending
        merge_policy:s=strict extraction_run_id:n created_at:t updated_at:t"""),
    "graph_relations": _table("relation_id", "relation_id:s graph_id:s source_id:s target_id:s source_type:s target_type:s relation_type:s confidence:d=0.8 importance:d=0.5 traversal_cost:d=1.0 extraction_run_id:n evidence_json:s created_at:t updated_at:t"),
    "bridge_relations": _table("bridge_id", "bridge_id:s source_graph_id:s target_graph_id:s source_key:s target_key:s bridge_type:s bridge_confidence:d=0.5 evidence_json:s warning:s review_status:s=candidate extraction_run_id:n traversal_cost:d=5.0 created_at:t updated_at:t"),
    "extraction_runs": _table("run_id", """run_id:s paper_id:s graph_id:s target:s=all status:s=running model:s prompt_version:s=v0.2 prompt_template:s section_ids:a input_token_count:i items_produced:i items_accepted:i items_rejected:i
        output_token_count:i started_at:u completed_at:u total_cost_usd:d rolled_back_at:u rolled_back_by:n error_message:s created_at:t"""),
    "extraction_run_items": _table("item_id", "item_id:s run_id:s target_type:s target_id:s raw_llm_output:s extraction_confidence:d accepted:b reviewer_notes:s created_at:t"),
    "parse_quality_reports": _table("report_id", "report_id:s paper_id:s graph_id:s parser_name:s parser_version:s quality_json:s={} needs_structure_review:b created_at:t"),
    "review_inbox": _table("inbox_id", """inbox_id:s inbox_type:s item_id:s item_type:s title:s description:s source_text:s extraction_confidence:d priority:s=medium decision:s=pending decided_by:n decided_at:u decision_notes:s
        merge_target_id:n extraction_run_id:n graph_id:n paper_id:n suggested_actions:a created_at:t updated_at:t"""),
    "traversal_traces": _table("trace_id", "trace_id:s query:s plan_json:s={} result_json:s={} created_at:t"),
    "node_index": _table("node_id", "node_id:s node_type:s graph_id:s paper_id:s section_id:s created_at:t"),
    "block_concepts": _table("concept_key block_id", "concept_key:s block_id:s block_type:s graph_id:s"),
    "claim_evidence_links": _table("claim_id evidence_id", "claim_id:s evidence_id:s graph_id:s"),
    "claim_limitation_links": _table("claim_id limitation_id", "claim_id:s limitation_id:s graph_id:s"),
    "outline_nodes": _table("outline_id", "outline_id:s paper_id:s graph_id:s title:s normalized_title:s level:i=1 toc_page:p printed_page:p body_page:p parent_outline_id:n order_index:i confidence:d source:s"),
    "structure_groups": _table("group_id", "group_id:s paper_id:s graph_id:s role:s=context structure_title:s display_title:s keyword_summary:s heading_path_json:s=[] parent_group_id:n order_index:i confidence:d created_at:t updated_at:t"),
    "group_members": _table("group_id section_id", "group_id:s section_id:s member_order:i"),
}
#: What hangs on a document, and by which column.
OF_DOCUMENT = {
    "section_blocks": "paper_id", "source_spans": "paper_id", "claim_blocks": "paper_id", "evidence_blocks": "paper_id", "limitation_blocks": "paper_id", "extraction_runs": "paper_id", "parse_quality_reports": "paper_id",
    "review_inbox": "paper_id", "node_index": "paper_id", "outline_nodes": "paper_id", "structure_groups": "paper_id",
}
#: Link tables: columns that name a block of the document.
OF_BLOCK = {"graph_relations": ("source_id", "target_id"), "block_concepts": ("block_id",), "claim_evidence_links": ("claim_id", "evidence_id"), "claim_limitation_links": ("claim_id", "limitation_id")}
BLOCKS = (("section_blocks", "section_id"), ("claim_blocks", "claim_id"), ("evidence_blocks", "evidence_id"), ("limitation_blocks", "limitation_id"))


class Tables:
    """The store below one folder (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions ----

    def _versions(self, name: str) -> list[int]:
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        folder = self._path(f"{self.root}/{name}")
        if not self._files.exists(folder):
            return []
        found = (s.getPath() for s in self._files.listStatus(folder))
        return sorted(int(p.getName()[1:]) for p in found if self._files.exists(self._path(f"{p}/_SUCCESS")))

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def _rewrite(self, name: str, frame: DataFrame) -> None:
        known = self._versions(name)
        target = self._folder(name, (known[-1] if known else 0) + 1)
        frame.select(*TABLES[name].schema.names).write.mode("overwrite").parquet(target)  # what an attempt without a mark left goes
        for old in known[:-1]:
            self._files.delete(self._path(self._folder(name, old)), True)

    # ---- reading ----

    def read(self, name: str) -> DataFrame:
        known, schema = self._versions(name), TABLES[name].schema
        return self.spark.read.schema(schema).parquet(self._folder(name, known[-1])) if known else self.spark.createDataFrame([], schema)

    def create(self) -> None:
        """Every table, empty where it isn't there yet."""
        for name in TABLES:
            if not self._versions(name):
                self._rewrite(name, self.read(name))

    # ---- writing ----

    def shaped(self, name: str, frame: DataFrame) -> DataFrame:
        """The frame in the table's columns: missing ones and nulls take the default, unknown ones are refused."""
        fields = TABLES[name].fields
        if unknown := set(frame.columns) - {f[0] for f in fields}:
            raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
        if lost := set(TABLES[name].key) - set(frame.columns):
            raise ValueError(f"{name} needs {', '.join(sorted(lost))}")

        def one(column: str, kind: str, default) -> Column:
            usual = F.current_timestamp() if default == "now" else F.expr(f"CAST(array() AS {kind})") if kind.startswith("array") else F.lit(default).cast(kind)
            return (F.coalesce(F.col(column).cast(kind), usual) if column in frame.columns else usual).alias(column)

        return frame.select(*(one(*f) for f in fields))

    def insert(self, name: str, frame: DataFrame) -> None:
        """Add rows whose keys are new; if any key is there already or comes twice, nothing is added."""
        key, rows = list(TABLES[name].key), self.shaped(name, frame)
        keys = rows.select(*key).unionByName(self.read(name).select(*key))
        wanted = rows.select(*key).distinct()
        if again := keys.join(wanted, key, "left_semi").groupBy(*key).count().where("count > 1").limit(1).collect():
            raise ValueError(f"{name}: {again[0].asDict()} is not new")
        known = self._versions(name)
        if known:
            rows.write.mode("append").parquet(self._folder(name, known[-1]))
        else:
            self._rewrite(name, rows)

    def insert_new(self, name: str, frame: DataFrame) -> None:
        """Add the rows whose keys are new and leave out the others."""
        key = list(TABLES[name].key)
        rows = self.shaped(name, frame).dropDuplicates(key).join(self.read(name).select(*key), key, "left_anti")
        known = self._versions(name)
        if known:
            rows.write.mode("append").parquet(self._folder(name, known[-1]))
        else:
            self._rewrite(name, rows)

    def upsert(self, name: str, frame: DataFrame, order: list[Column] | None = None) -> None:
        """Insert or replace; of rows with one key the first by ``order`` counts."""
        key, rows = list(TABLES[name].key), self.shaped(name, frame)
        w = Window.partitionBy(*key).orderBy(*(order or [F.xxhash64(*rows.columns)]))
        first = rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
        self._rewrite(name, self.read(name).join(first.select(*key), key, "left_anti").unionByName(first))

    def update(self, name: str, where: Column, values: dict[str, Column]) -> int:
        """Set columns where a condition holds; the number of rows that it held for."""
        old, hit = self.read(name), F.coalesce(where, F.lit(False))
        if "updated_at" in old.columns:
            values = {"updated_at": F.current_timestamp(), **values}
        n = old.where(hit).count()
        if n:
            kinds = dict(old.dtypes)
            self._rewrite(name, old.select(*(F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns)))
        return n

    def delete(self, name: str, where: Column) -> int:
        old, hit = self.read(name), F.coalesce(where, F.lit(False))
        n = old.where(hit).count()
        if n:
            self._rewrite(name, old.where(~hit))
        return n

    def _drop(self, name: str, gone: DataFrame, key: str, column: str) -> int:
        old = self.read(name)
        gone = gone.select(F.col(key).alias(column)).distinct()
        n = old.join(gone, column, "left_semi").count()
        if n:
            self._rewrite(name, old.join(gone, column, "left_anti"))
        return n

    def clear_documents(self, papers: DataFrame) -> dict[str, int]:
        """All that was made of these documents (``paper_id``) goes; the cards stay.  Removed rows by table."""
        out: dict[str, int] = {}
        blocks = None
        for name, column in BLOCKS:
            own = self.read(name).join(papers.select("paper_id").distinct(), "paper_id", "left_semi").select(F.col(column).alias("id"))
            blocks = own if blocks is None else blocks.unionByName(own)
        runs = self.read("extraction_runs").join(papers.select("paper_id").distinct(), "paper_id", "left_semi").select("run_id")
        groups = self.read("structure_groups").join(papers.select("paper_id").distinct(), "paper_id", "left_semi").select("group_id")
        for name, columns in OF_BLOCK.items():
            out[name] = sum(self._drop(name, blocks, "id", c) for c in columns)
        out["extraction_run_items"] = self._drop("extraction_run_items", runs, "run_id", "run_id")
        out["group_members"] = self._drop("group_members", groups, "group_id", "group_id")
        for name, column in OF_DOCUMENT.items():
            out[name] = self._drop(name, papers, "paper_id", column)
        return out

    def delete_documents(self, papers: DataFrame) -> dict[str, int]:
        """The same with the cards, and the graphs that have no document left."""
        graphs = self.read("paper_cards").join(papers.select("paper_id").distinct(), "paper_id", "left_semi").select("graph_id").distinct()
        papers, graphs = materialize(papers.select("paper_id").distinct(), "deleted"), materialize(graphs, "graphs")
        out = self.clear_documents(papers)
        out["paper_cards"] = self._drop("paper_cards", papers, "paper_id", "paper_id")
        orphans = graphs.join(self.read("paper_cards").select("graph_id").distinct(), "graph_id", "left_anti")
        out["concept_keys"] = self._drop("concept_keys", orphans, "graph_id", "graph_id")
        out["series_graphs"] = self._drop("series_graphs", orphans, "graph_id", "graph_id")
        return out

    # ---- what the store is asked ----

    def counts(self) -> DataFrame:
        out = None
        for name in TABLES:
            one = self.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def latest_report(self, paper_id: str) -> DataFrame:
        """The newest quality report of a document, and the review flag inside its JSON."""
        mine = self.read("parse_quality_reports").where(F.col("paper_id") == paper_id)
        return mine.orderBy(F.desc("created_at"), F.desc("report_id")).limit(1).withColumn("n_elements", F.get_json_object("quality_json", "$.total_elements").cast("int"))

    def spans(self, paper_id: str) -> DataFrame:
        return self.read("source_spans").where(F.col("paper_id") == paper_id).orderBy("char_start", "span_id")

    def groups_with_members(self, paper_id: str) -> DataFrame:
        """Groups in order, each with its sections in order."""
        m = self.read("group_members").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("member_order", "section_id"))), lambda x: x["section_id"]).alias("members"))
        return self.read("structure_groups").where(F.col("paper_id") == paper_id).join(m, "group_id", "left").withColumn("members", F.coalesce("members", F.expr("CAST(array() AS array<string>)"))).orderBy("order_index", "group_id")

    def groups_of_graph(self, graph_id: str) -> DataFrame:
        return self.read("series_groups").where(F.array_contains("graph_ids", graph_id))

    def add_to_group(self, group_id: str, graph_id: str) -> int:
        """A graph joins a series group once."""
        return self.update("series_groups", F.col("group_id") == group_id, {"graph_ids": F.array_union("graph_ids", F.array(F.lit(graph_id)))})

    def ensure_graph(self, graph_id: str, name: str = "", corpus_id: str = "default") -> None:
        """The graph and its container, made where they are missing."""
        one = self.spark.range(1)
        self.insert_new("corpora", one.select(F.lit(corpus_id).alias("corpus_id"), F.lit(corpus_id).alias("name")))
        self.insert_new("series_graphs", one.select(F.lit(graph_id).alias("graph_id"), F.lit(corpus_id).alias("corpus_id"), F.lit(name or graph_id).alias("name")))

    def extraction_status(self, paper_id: str) -> tuple[DataFrame, DataFrame]:
        """(runs, the newest first; one row of counts)."""
        runs = self.read("extraction_runs").where(F.col("paper_id") == paper_id).select("target", "status", "items_produced", "items_accepted", "started_at", "completed_at", "created_at", "run_id").orderBy(F.desc("created_at"), "run_id")
        out = self.spark.range(1).select()
        for label, name in (("total_claims", "claim_blocks"), ("total_evidence", "evidence_blocks"), ("total_limitations", "limitation_blocks")):
            out = out.join(self.read(name).where(F.col("paper_id") == paper_id).agg(F.count("*").alias(label)))  # one row each
        graph = self.read("paper_cards").where(F.col("paper_id") == paper_id).select("graph_id")
        return runs, out.join(self.read("concept_keys").join(graph, "graph_id", "left_semi").agg(F.count("*").alias("total_concepts")))

    def export(self, graph_id: str, paper_id: str | None = None) -> dict[str, DataFrame]:
        """A graph for a browser: six lists."""
        mine = lambda name: self.read(name).where(F.col("graph_id") == graph_id)
        own = lambda name: mine(name) if paper_id is None else mine(name).where(F.col("paper_id") == paper_id)
        return {
            "claims": own("claim_blocks"), "evidence": own("evidence_blocks"), "limitations": own("limitation_blocks"), "concepts": mine("concept_keys").where("status = 'active'"),
            "relations": mine("graph_relations").orderBy(F.desc("importance"), "relation_id"), "sections": mine("section_blocks").orderBy("global_order_index", "page_start", "section_id"),
        }

    def list_top(self, name: str, order: str, limit: int, where: Column | None = None) -> DataFrame:
        """A listing: the first rows by a column, the key settling ties."""
        rows = self.read(name) if where is None else self.read(name).where(where)
        return rows.orderBy(F.desc_nulls_last(order), *TABLES[name].key).limit(limit)

    def start_run(self, run: DataFrame) -> None:
        self.insert("extraction_runs", run.withColumn("started_at", F.current_timestamp()))

    def finish_run(self, run_id: str, produced: int, accepted: int) -> int:
        return self.update("extraction_runs", F.col("run_id") == run_id, {"status": F.lit("completed"), "items_produced": F.lit(produced), "items_accepted": F.lit(accepted), "completed_at": F.current_timestamp()})

    def fail_run(self, run_id: str, message: str) -> int:
        return self.update("extraction_runs", F.col("run_id") == run_id, {"status": F.lit("failed"), "error_message": F.lit(message), "completed_at": F.current_timestamp()})

    def set_concept(self, concept_key: str, status: str, graph_id: str | None = None, into: str | None = None) -> int:
        """Activate, reject or merge a concept; a merged one remembers what it went into."""
        where = F.col("concept_key") == concept_key
        values = {"status": F.lit(status)}
        if status in ("active", "rejected"):
            values["review_status"] = F.lit({"active": "approved", "rejected": "rejected"}[status])
        if into is not None:
            values["do_not_merge_with"] = F.array_union("do_not_merge_with", F.array(F.lit(into)))
        return self.update("concept_keys", where if graph_id is None else where & (F.col("graph_id") == graph_id), values)

    def blocks_of_concept(self, concept_key: str) -> DataFrame:
        """Claims, evidence and limitations that name a concept: (node_type, block_id, text)."""
        out = None
        for kind, name in (("claim", "claim_blocks"), ("evidence", "evidence_blocks"), ("limitation", "limitation_blocks")):
            one = self.read(name).where(F.array_contains("concept_keys", concept_key)).select(F.lit(kind).alias("node_type"), F.col(f"{kind}_id").alias("block_id"), F.col(f"{kind}_text").alias("text"))
            out = one if out is None else out.unionByName(one)
        return out

    def search(self, name: str, text: str, limit: int = 20) -> DataFrame:
        """Rows of sections, claims or cards in whose texts a word stands, by key."""
        columns = {"section_blocks": ["heading", "raw_text", "summary"], "claim_blocks": ["claim_text", "normalized_claim"], "paper_cards": ["title", "abstract"]}
        return text_search(self.read(name), text, columns[name], limit, list(TABLES[name].key))

    def outline(self, paper_id: str) -> DataFrame:
        """The stored outline, or without one the headings above each section's own, first seen first: (level, title, page)."""
        own = self.read("outline_nodes").where(F.col("paper_id") == paper_id).select("level", "title", F.coalesce("body_page", "toc_page").alias("page"), "order_index")
        if own.limit(1).count():
            return own.orderBy("order_index").drop("order_index")
        s = self.read("section_blocks").where(F.col("paper_id") == paper_id)
        above = s.select("global_order_index", "page_start", F.posexplode(F.slice("heading_path", 1, F.greatest(F.size("heading_path") - 1, F.lit(0)))).alias("i", "title")).where("title <> ''")
        first = above.groupBy((F.col("i") + 1).alias("level"), "title").agg(F.min(F.struct("global_order_index", F.col("i").alias("i"), F.col("page_start").alias("page"))).alias("m"))
        return first.orderBy("m.global_order_index", "m.i").select("level", "title", "m.page")

    def connectivity(self, graph_id: str) -> DataFrame:
        """One row of a graph's health: how much there is, mentions of concepts that don't exist, blocks in no section."""
        mine = lambda name: self.read(name).where(F.col("graph_id") == graph_id)
        edges = mine("graph_relations")
        mentions = edges.where("relation_type = 'mentions'").select(F.col("target_id").alias("concept_key"))
        lost = mentions.join(self.read("concept_keys").select("concept_key"), "concept_key", "left_anti").agg(F.count("*").alias("missing_concept_nodes"))
        blocks = None
        for name, column in BLOCKS[1:]:
            one = mine(name).where("paper_id <> ''").select(F.col(column).alias("source_id"))
            blocks = one if blocks is None else blocks.unionByName(one)
        placed = self.read("graph_relations").where("relation_type = 'belongs_to'").select("source_id")
        out = blocks.join(placed, "source_id", "left_anti").agg(F.count("*").alias("blocks_without_belongs_to")).join(lost)  # one row each
        for label, name in (("paragraphs", "section_blocks"), ("claims", "claim_blocks"), ("evidence", "evidence_blocks"), ("limitations", "limitation_blocks"), ("concepts", "concept_keys")):
            out = out.join(mine(name).agg(F.count("*").alias(label)))
        return out

    def complete_edges(self, graph_id: str) -> dict[str, int]:
        """Adds the edges and concepts that the blocks ask for and that aren't there; a second run adds nothing.

        Sections follow each other inside a document; blocks belong to their sections; claims mention their
        concepts, which are made where missing; evidence supports and limitations constrain their claims.
        """
        mine = lambda name: self.read(name).where(F.col("graph_id") == graph_id)
        ends = lambda d, a, b, kinds, relation, confidence, importance: d.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kinds[0]).alias("source_type"), F.lit(kinds[1]).alias("target_type"), F.lit(relation).alias("relation_type"), F.lit(confidence).alias("confidence"), F.lit(importance).alias("importance"))
        follow = Window.partitionBy("paper_id").orderBy("global_order_index", "page_start", "section_id")
        named = mine("claim_blocks").select("claim_id", F.explode("concept_keys").alias("key"))
        parts = {
            "section_next": ends(mine("section_blocks").withColumn("next", F.lead("section_id").over(follow)).where("next IS NOT NULL"), "section_id", "next", ("section", "section"), "section_next", 1.0, 0.3),
            "mentions": ends(named, "claim_id", "key", ("claim", "concept"), "mentions", 0.7, 0.4),
            "evidence_supports": ends(mine("evidence_blocks").select("evidence_id", F.explode("supports_claim_ids").alias("claim")), "evidence_id", "claim", ("evidence", "claim"), "supports", 0.7, 0.5),
            "limitation_constrains": ends(mine("limitation_blocks").select("limitation_id", F.explode("affected_claim_ids").alias("claim")), "limitation_id", "claim", ("limitation", "claim"), "constrains", 0.7, 0.5),
        }
        for name, column in BLOCKS[1:]:
            parts[f"belongs_to {name}"] = ends(mine(name).where("section_id <> ''"), column, "section_id", (column[:-3], "section"), "belongs_to", 1.0, 0.5)
        wanted = None
        for part, edges in parts.items():
            one = edges.withColumn("part", F.lit(part.split(" ")[0]))
            wanted = one if wanted is None else wanted.unionByName(one)
        keys = ["source_id", "target_id", "relation_type"]
        fresh = materialize(wanted.dropDuplicates(keys).join(self.read("graph_relations").select(*keys), keys, "left_anti"), "edges")
        concepts = named.select(F.col("key").alias("concept_key"), F.lit(graph_id).alias("graph_id"), F.regexp_replace(F.regexp_replace("key", "concept:", ""), "_", " ").alias("label_zh")).distinct()
        before = self.read("concept_keys").count()
        self.insert_new("concept_keys", concepts)
        done = {r["part"]: r["n"] for r in fresh.groupBy("part").agg(F.count("*").alias("n")).collect()}
        identity = F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", F.lit(graph_id), *keys), 256), 1, 16))
        self.insert_new("graph_relations", fresh.drop("part").select(identity.alias("relation_id"), F.lit(graph_id).alias("graph_id"), "*", F.lit(0.5).alias("traversal_cost")))
        return {p: done.get(p, 0) for p in ("section_next", "belongs_to", "mentions", "evidence_supports", "limitation_constrains")} | {"concepts_created": self.read("concept_keys").count() - before}
