"""Per-text work on Arrow batches: rows in, the same rows with computed columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def per_row(df: DataFrame, read: Sequence[str], fields: T.StructType, work: Callable, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of every row and the ``fields`` that ``work`` computes from columns ``read``.

    ``work`` gets the values of one row and returns a tuple.  A kept column whose name is among
    the fields gives way to the computed one.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    source = df.select(*dict.fromkeys([*keep, *read]))
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))
    arrow = to_arrow_schema(T.StructType(list(fields)))
    read = list(read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in read]
            rows = [work(*(c[i].as_py() for c in columns)) for i in range(batch.num_rows)]
            made = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *arrow.names])

    return source.mapInArrow(run, schema)


def rows_of(df: DataFrame, read: Sequence[str], fields: T.StructType, work: Callable) -> DataFrame:
    """The rows, none or many, that ``work`` makes of each row's columns ``read``."""
    arrow = to_arrow_schema(fields)
    read = list(read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in read]
            out: list[tuple] = []
            for i in range(batch.num_rows):
                out.extend(work(*(c[i].as_py() for c in columns)))
                if len(out) >= 20_000 or i == batch.num_rows - 1:
                    made = [pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays(made, names=arrow.names)
                    out = []

    return df.select(*read).mapInArrow(run, fields)
