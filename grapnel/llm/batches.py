"""Arrow batches through Python: the shared frame of the operators that aren't built from expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_texts(docs: DataFrame, doc_id: str, text: str, make: Callable[[], Callable], schema: list[tuple[str, T.DataType]]) -> DataFrame:
    """``doc_id`` and the columns of ``schema`` for each document, or for each row it gives.

    ``make()`` runs once a task and returns a function of one UTF-8 text (bytes; null is empty) that
    returns a list of rows.  Texts are read from Arrow's buffers one at a time; rows are sent on as
    soon as a batch is done, so a task holds one batch.
    """
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *(T.StructField(n, t) for n, t in schema)])
    fields = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            took, rows = [], []
            for i, value in enumerate(batch.column(1)):
                got = f(value.as_buffer().to_pybytes() if value.is_valid else b"")
                rows += got
                took += [i] * len(got)
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            arrays = [batch.column(0).take(pa.array(took, pa.int64())).cast(fields.field(0).type), *(pa.array(c, fields.field(k + 1).type) for k, c in enumerate(columns))]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, out)


def segments(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut before a blank that follows a word's end."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] in b" \t\n\r\x0b\x0c" and text[cut - 1] not in b" \t\n\r\x0b\x0c"):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]
