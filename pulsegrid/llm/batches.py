"""Helpers for functions that see Arrow batches of rows inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
          "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], dict[str, list] | None], schema: str, rows: int | None = None) -> DataFrame:
    """Apply ``each`` to every Arrow batch, or to slices of ``rows`` rows; it returns columns in the order of
    ``schema``, or None for no rows."""

    fields = arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                columns = each(batch.slice(at, rows))
                if columns is not None:
                    yield pa.RecordBatch.from_pydict(columns, schema=fields)

    return df.mapInArrow(over, schema)


def text_groups(texts: list[str | None], most_bytes: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive rows with about ``most_bytes`` of text, one row at least."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most_bytes:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
