"""Running NumPy functions over the rows of a table: one Arrow batch in, one out, nothing gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

PIECE_BYTES = 8 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about PIECE_BYTES, so that what a function makes of it stays small too."""
    rows = max(1, batch.num_rows * PIECE_BYTES // max(PIECE_BYTES, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def mapped(table: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """table's batches through work, which returns a column for each name of schema."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = work(part)
                yield pa.RecordBatch.from_arrays([_column(found[x.name], x.type) for x in arrow], schema=arrow)

    return table.mapInArrow(run, kind)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)
