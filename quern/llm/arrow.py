"""Helpers for Arrow-batched Python operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of text handled at once by a Python worker; with usual texts some 2 MB, so memory stays flat.
SLICE_ROWS = 512
#: Bytes of text handled at once; a slice of rows is cut earlier when its texts are long.
SLICE_BYTES = 4 << 20


def as_bytes(column: pa.Array) -> list:
    """The strings of a column as UTF-8 bytes (None stays None)."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of bounded rows and bytes (a single text may be larger)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (held + n > SLICE_BYTES or i - begin >= SLICE_ROWS):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def map_slices(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType, text: str = "text") -> DataFrame:
    """Run ``work`` in Python workers over slices of ``df``; it yields dicts of columns (lists or arrays) for ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(s for b in batches for s in slices(b, text)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in ((f, columns[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_slices(df: DataFrame, verdict: Callable[[pa.RecordBatch], list], text: str = "text") -> DataFrame:
    """Keep the rows for which ``verdict`` (over a slice) gives True; all columns pass through unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, text):
                yield s.filter(pa.array(verdict(s), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(c) for c in extra))
