"""Passes of Python over Arrow batches, which hold a slice of the rows at a time and leave no memory behind."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A batch is cut into slices of about this many bytes before Python holds intermediate values for it.
SLICE_BYTES = 8 << 20


def name(c: str, of: str = "") -> Column:
    """The column of exactly this name, whatever characters it has; with `of`, a field of that struct."""
    quoted = "`" + c.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes; one row can be larger."""
    for b in batches:
        n = max(1, b.nbytes // most)
        step = max(1, -(-b.num_rows // n))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


@cache
def _trim() -> Callable[[int], int]:
    """The C library's call that returns free memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker returns what it has freed to the system at the end of each task.

    Workers live on for later tasks, and an executor has more of them than cores once a task has had two passes: they take
    turns, so none is idle for long enough to be ended, and each would keep the memory of its largest task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:  # run's own values are gone here
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


def append(df: DataFrame, inputs: list[str | tuple[str, str]], fields: list[T.StructField], make: Callable[[], Callable[..., list]], keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """df's columns (or `keep` of them) followed by `fields`, computed a slice of Arrow rows at a time without a shuffle.

    make() runs once in each task and returns fn(*input arrays) -> a list of value lists or Arrow arrays, one for each
    field. An input is a column, or a (struct column, field). An input column named as a field is replaced by it.
    """
    names = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    carried = list(dict.fromkeys([*keep, *[i if isinstance(i, str) else i[0] for i in inputs]]))
    # mapInArrow reads column names as expressions, so columns go there under plain names.
    source = df.select(*[name(c).alias(f"c{i}") for i, c in enumerate(carried)])
    out = T.StructType([*[T.StructField(c, f.dataType, f.nullable, f.metadata) for c, f in zip(keep, source.schema, strict=False)], *fields])
    made_schema = to_arrow_schema(T.StructType(fields))
    nk = len(keep)

    def column(b: pa.RecordBatch, i: str | tuple[str, str]) -> pa.Array:
        return b.column(carried.index(i)) if isinstance(i, str) else pc.struct_field(b.column(carried.index(i[0])), i[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in slices(batches, most):
            made = fn(*[column(b, i) for i in inputs])
            made = [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(made, made_schema, strict=True)]
            schema = pa.schema([*[b.schema.field(i).with_name(c) for i, c in enumerate(keep)], *made_schema])
            yield pa.RecordBatch.from_arrays([*b.columns[:nk], *made], schema=schema)

    return source.mapInArrow(lean(run), out)
