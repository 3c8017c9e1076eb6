"""Readers, parsers and sinks: markdown, JSON-lines logs, document parsers with fallback, vector index, text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from grapnel.operators import layout
from grapnel.operators.retrieval import nearest
from grapnel.operators.structure import html_elements
from grapnel.plans.views import table
from grapnel.registry import query

AUDIT_SCHEMA = "event string, paper_id string, timestamp double, window_index int, pages array<int>, raw_count int, duration_ms double, reason string, page_start int, heading_path array<string>"
ELEMENT_SCHEMA = "doc_id string, order_index int, type string, level int, text string"
PRIORITY = ("mineru_api", "external_markdown", "pdfplumber")


# ---- readers ---------------------------------------------------------------------------------------

def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_audit(spark: SparkSession, path: str, event: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines with a fixed schema; bad lines are dropped, not fatal."""
    rows = spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    rows = rows if event is None else rows.where(F.col("event") == event)
    return rows if limit is None else rows.orderBy("timestamp").limit(limit)


def write_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_vector_index(rows: DataFrame, path: str, partition: str = "graph_id") -> None:
    """Drop and rebuild the vector table, partitioned so that a scoped search prunes folders."""
    rows.write.mode("overwrite").partitionBy(partition).parquet(path)


class PagesSource(DataSource):
    """A Python data source that yields pages of binary documents: (path, page_num, text).

    The extractor is pluggable (``option("extractor", "module:function")`` of ``bytes -> list[str]``);
    the default splits plain text on form feeds, so the source works without a PDF library.
    """

    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return "path string, page_num int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options)


class _PagesReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split(",")
        self.extractor = options.get("extractor")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        if self.extractor:
            import importlib

            module, _, name = self.extractor.partition(":")
            extract = getattr(importlib.import_module(module), name)
        else:
            extract = lambda data: data.decode("utf-8", "replace").split("\f")
        with open(partition.value, "rb") as f:
            for i, text in enumerate(extract(f.read())):
                yield partition.value, i + 1, text


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Binary documents below a path (any file system) to pages (path, page, text), a file at a time in the executors.

    ``extract`` makes pages of a file's bytes; without it text is split at form feeds.  Several extractors can
    be tried with :func:`first_that_works`.
    """
    pages = extract or (lambda data: data.decode("utf-8", "replace").split("\f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                texts = pages(bytes(data))
                yield pd.DataFrame({"path": [file] * len(texts), "page": range(1, len(texts) + 1), "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def first_that_works(*extractors: Callable[[bytes], list[str]], recognize: Callable[[bytes], list[str]] | None = None, is_poor: Callable[[list[str]], bool] | None = None) -> Callable[[bytes], list[str]]:
    """The first extractor that gives text, in order; where its pages are poor, recognition if there is one."""

    def extract(data: bytes) -> list[str]:
        for one in extractors:
            try:
                pages = one(data)
            except (ImportError, ValueError, OSError):
                continue
            if any(p.strip() for p in pages):
                if recognize is not None and (is_poor or poor_pages)(pages):
                    return recognize(data)
                return pages
        return recognize(data) if recognize is not None else []

    return extract


def poor_pages(pages: list[str]) -> bool:
    """Most pages are lines of one character: the text layer is of no use."""
    def poor(page: str) -> bool:
        lines = [x.strip() for x in page.split("\n") if x.strip()]
        return len(lines) >= 3 and sum(len(x) == 1 and "一" <= x <= "鿿" for x in lines) > 0.6 * len(lines)

    return sum(map(poor, pages)) * 2 > len(pages)


SIDECARS = (".md", ".markdown")


def sidecars(sources: DataFrame, files: DataFrame, folder: str = "data/parsed_markdown") -> DataFrame:
    """For each source (``path``) the markdown that stands for it: itself, beside it, or in a folder of parses.

    ``files`` lists what exists (``path``).  The first of the candidates that exists counts.
    """
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    name = F.regexp_replace(stem, "^.*/", "")
    own = F.when(F.lower("path").rlike(r"\.(md|markdown)$"), F.col("path"))
    tries = F.array(own, *(F.concat(stem, F.lit(x)) for x in SIDECARS), *(F.concat(F.lit(f"{folder}/"), name, F.lit(x)) for x in SIDECARS))
    each = sources.select(F.col("path").alias("source"), F.posexplode(tries).alias("rank", "path")).where("path IS NOT NULL")
    return each.join(files.select("path").distinct(), "path").groupBy("source").agg(F.min_by("path", "rank").alias("markdown"))


def largest_markdown(outputs: DataFrame) -> DataFrame:
    """Of what a converter wrote (source, path, size) the largest markdown file of each source."""
    return outputs.where(F.lower("path").rlike(r"\.(md|markdown)$")).groupBy("source").agg(F.max_by("path", F.struct("size", "path")).alias("markdown"))


def convert(docs: DataFrame, run: Callable[[str, bytes], list[tuple[str, str]]]) -> DataFrame:
    """Documents (path, content) through a converter that gives (file name, text); the largest markdown counts.

    The converter (a command, a local model) runs in the executor that holds the file; an empty result
    leaves the text null, so that the next parser can be tried.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                made = [x for x in run(path, bytes(content)) if x[0].lower().endswith(SIDECARS)]
                rows.append((path, max((t for _, t in made), key=len, default=None)))
            yield pd.DataFrame(rows, columns=["path", "text"])

    return docs.select("path", "content").mapInPandas(each, "path string, text string")


def markdown_of_response(content_type: Column, body: Column) -> Column:
    """The markdown in a conversion service's answer: plain text as it is; in JSON a result's, else a top-level field; null if none."""
    result = F.map_values(F.from_json(F.get_json_object(body, "$.results"), "map<string,struct<md_content:string,markdown:string,md:string,content:string,text:string>>"))
    of = lambda x: F.coalesce(*(F.when(F.trim(x[f]) != "", x[f]) for f in ("md_content", "markdown", "md", "content", "text")))
    nested = F.get(F.filter(F.transform(result, of), lambda x: x.isNotNull()), F.lit(0))
    top = F.coalesce(*(F.when(F.trim(F.get_json_object(body, f"$.{f}")) != "", F.get_json_object(body, f"$.{f}")) for f in ("markdown", "md", "content", "text")))
    return F.when(F.contains(F.lower(content_type), F.lit("application/json")), F.coalesce(nested, top)).otherwise(body)


def ask_service(docs: DataFrame, post: Callable[[str, bytes], tuple[str, str]], attempts: int = 3) -> DataFrame:
    """Documents (path, content) through a remote converter ``post(path, bytes) -> (content type, body)``: (path, text)."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                told = ("", None)
                for _ in range(attempts):
                    try:
                        told = post(path, bytes(content))
                        break
                    except (ConnectionError, TimeoutError):
                        continue
                rows.append((path, *told))
            yield pd.DataFrame(rows, columns=["path", "content_type", "body"])

    said = docs.select("path", "content").mapInPandas(each, "path string, content_type string, body string")
    return said.select("path", markdown_of_response(F.col("content_type"), F.col("body")).alias("text"))


def embed(texts: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, embedding) from a pluggable model, in Arrow batches: an HTTP client, a local model, a stand-in."""
    kind = texts.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "embedding": [list(map(float, v)) for v in model(batch[text].tolist())]})

    return texts.select(key, text).mapInPandas(each, f"{key} {kind}, embedding array<double>")


class VectorIndex:
    """Vectors in Parquet, one folder a graph: a scoped delete drops folders, a search is one pass with a top-k."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame) -> None:
        """Replace all.  ``rows``: id, graph_id, text, embedding."""
        write_vector_index(rows, self.path)

    def search(self, target: list[float], k: int, graphs: tuple[str, ...] = ()) -> DataFrame:
        """The k nearest; graphs are asked for afterwards, so fewer can be left."""
        near = nearest(self.spark.read.parquet(self.path), target, k, "embedding", "id")
        return near.where(F.col("graph_id").isin(*graphs)) if graphs else near

    def delete_graph(self, graph: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/graph_id={graph}")
        folder.getFileSystem(conf).delete(folder, True)


# ---- parsers ---------------------------------------------------------------------------------------

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(name: str):
    """Register ``f(documents) -> elements`` under a name."""

    def sign(f):
        PARSERS[name] = f
        return f

    return sign


def create_parser(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in PARSERS:
        raise ValueError(f"unknown parser {name!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[name]


@parser("markdown")
@parser("external_markdown")
@parser("mineru_api")
@parser("mineru_markdown")
@parser("marker_markdown")
@parser("docling")
def _markdown(docs: DataFrame) -> DataFrame:
    return layout.markdown_document(docs.select("doc_id", "text")).select("doc_id", "order_index", "type", "level", "text")


@parser("html")
def _html(docs: DataFrame) -> DataFrame:
    return html_elements(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))).select(F.col("page_id").alias("doc_id"), "order_index", "type", F.when(F.col("type") == "heading", 1).alias("level"), "text")


@parser("pdfplumber")
def _pages(docs: DataFrame) -> DataFrame:
    """Texts whose pages are parted by form feeds: body pages, blank-line paragraphs."""
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return layout.rule_paragraphs(pages).select("doc_id", "order_index", "type", F.lit(None).cast("int").alias("level"), "text")


@parser("pymupdf")
def _blocks(docs: DataFrame) -> DataFrame:
    """Texts whose layout blocks are parted by blank lines and pages by form feeds: continuations joined, noise dropped."""
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "text"))
    blocks = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("text", "\n[ \t]*\n")).alias("no", "text"))
    ordered = blocks.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "no")))
    return layout.merged_blocks(ordered).select("doc_id", "order_index", "type", F.lit(None).cast("int").alias("level"), "text")


@parser("plain")
def _plain(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("order_index", "text"))
    return lines.where(F.btrim("text") != "").select("doc_id", "order_index", F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), "text")


def auto_parse(candidates: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Per document the first parse by priority that needs no review, else the last low-quality one.

    ``candidates``: (doc_id, parser, needs_review, ...).
    """
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("parser"))
    w = Window.partitionBy("doc_id").orderBy("needs_review", F.when(~F.col("needs_review"), rank).asc_nulls_last(), rank.desc())
    return candidates.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def needs_review(n_paragraphs: Column, n_pages: Column) -> Column:
    """Too sparse a parse: fewer than 10 paragraphs, or fewer than one for two pages."""
    return (n_paragraphs < 10) | (n_paragraphs * 2 < n_pages)


# ---- queries ---------------------------------------------------------------------------------------

@query("""SELECT doc_id, parser FROM (SELECT doc_id, unnest(['mineru_api', 'external_markdown', 'pdfplumber']) AS parser, unnest([0, 1, 2]) AS i, unnest([doc_id % 3 <> 0, doc_id % 4 <> 0, doc_id % 5 <> 0]) AS bad FROM documents)
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bad, CASE WHEN NOT bad THEN i END, i DESC) = 1""")
def parser_fallback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    tries = None
    for i, p in enumerate(PRIORITY):
        one = d.select("doc_id", F.lit(p).alias("parser"), (F.col("doc_id") % (i + 3) != 0).alias("needs_review"))
        tries = one if tries is None else tries.unionByName(one)
    return auto_parse(tries).select("doc_id", "parser")


@query("SELECT page_id AS doc_id, count(*) AS n, count(*) FILTER (starts_with(m, '<h1')) AS n_headings FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:h1|p|li)[^>]*>.*?</(?:h1|p|li)>')) AS m FROM pages) GROUP BY 1")
def parser_html(spark, sf):
    docs = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return create_parser("html")(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "heading").alias("n_headings"))


@query("SELECT doc_id, count(*) AS n, count(*) < 10 AS needs_review FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY 1")
def parser_plain(spark, sf):
    e = create_parser("plain")(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return e.withColumn("needs_review", needs_review(F.col("n"), F.lit(1)))


_BLOCKS = """SELECT doc_id, i, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS s FROM documents))"""


@query(f"""SELECT doc_id, count(*) AS n, sum(length(t))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(f).t AS t FROM (SELECT doc_id, list_reduce(list([{{'t': t}}] ORDER BY i), lambda acc, x: CASE WHEN NOT regexp_matches(acc[-1].t, '[。！？!?」】)）]$')
  AND (length(acc[-1].t) < 40 OR (length(acc[-1].t) < 200 AND length(x[1].t) < 200 AND NOT regexp_matches(acc[-1].t, '[.!?;]$'))) THEN list_concat(acc[:-2], [{{'t': acc[-1].t || ' ' || x[1].t}}]) ELSE list_concat(acc, x) END) AS f
  FROM ({_BLOCKS}) WHERE length(t) >= 15 GROUP BY doc_id)) WHERE length(t) >= 10 AND NOT regexp_matches(t, '^[0-9\\s.]*$') AND NOT regexp_matches(t, '^[・·.]{{5,}}$') GROUP BY doc_id""")
def parser_blocks(spark, sf):
    """Blocks of whole documents with their continuations."""
    e = create_parser("pymupdf")(table(spark, sf, "documents"))
    return e.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))
