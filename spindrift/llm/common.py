"""What the training-data operators share: tables, Arrow passes, joins on hot keys and lookups that move no texts.

An operator that adds columns of its own to a table of any columns packs that table's row into one struct column first
(packed, numbered), so that its own names cannot meet the table's, and unpacks it at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.passes import SLICE_BYTES, append, lean, name, slices
from ..sources.scratch import cut, scratch, shared_dir

__all__ = ["SLICE_BYTES", "Files", "append", "attach", "cut", "hot_join", "lean", "name", "numbered", "packed", "scratch", "shared_dir", "slices", "table"]

#: monotonically_increasing_id() has the writing task above this many bits.
TASK_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """df's rows as one struct column, `row`."""
    return df.select(F.struct("*").alias("row"))


def numbered(df: DataFrame) -> DataFrame:
    """at, row: df's rows as structs with a number each, which holds only where the result is written once (cut)."""
    return df.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("row"))


class Files:
    """A folder that driver and executors share, by any of Arrow's file systems."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

    def write(self, name: str, data: Iterable[bytes]) -> None:
        """Write under a temporary name, then move: a reader never sees half a file."""
        self.fs.create_dir(self.path, recursive=True)
        part = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            for x in data:
                f.write(x)
        self.fs.move(part, f"{self.path}/{name}")

    def open(self, name: str) -> pa.NativeFile:
        return self.fs.open_input_file(f"{self.path}/{name}")

    def rows(self, folder: str) -> pa.Table | None:
        """The rows of all Parquet files in a folder; None if there is none."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        parts = []
        for x in sorted(found, key=lambda i: i.path):
            if x.path.endswith(".parquet"):
                with self.fs.open_input_file(x.path) as f:
                    parts.append(pq.ParquetFile(f).read())
        return pa.concat_tables(parts) if parts else None


def attach(rows: DataFrame, side: DataFrame, only: bool = False) -> DataFrame:
    """rows (at, ... of a written numbered table) with the other columns of side, which has at most one row an `at`; with
    `only`, without the rows that side lacks.

    Rows stay where they are. side, which is narrow, is written as a folder for each task that wrote the numbered table; a
    task that reads some of that one's rows loads its folder, which holds no more rows than that task wrote.
    """
    folder = scratch(rows.sparkSession, "side")
    dealt = side.withColumn("task", F.shiftright("at", TASK_BITS).cast("int"))
    dealt.repartition("task").sortWithinPartitions("task", "at").write.partitionBy("task").option("compression", "zstd").parquet(folder)
    added = [f for f in side.schema.fields if f.name != "at"]
    out = T.StructType([*rows.schema.fields, *added])
    place = rows.columns.index("at")
    schema = to_arrow_schema(T.StructType(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, task, known, values = Files(folder), None, np.empty(0, np.int64), []
        for b in batches:
            at = b.column(place).to_numpy()
            tasks = at >> TASK_BITS
            edges = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(at)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if tasks[i] != task:
                    task = tasks[i]
                    found = files.rows(f"task={task}")
                    found = found.sort_by("at") if found is not None else None
                    known = found.column("at").to_numpy() if found is not None else np.empty(0, np.int64)
                    values = [found.column(f.name).combine_chunks().cast(f.type) if found is not None else pa.nulls(0, f.type) for f in schema]
                part, mine = b.slice(i, j - i), at[i:j]
                spot = np.searchsorted(known, mine)
                hit = np.zeros(len(mine), bool)
                inside = spot < len(known)
                hit[inside] = known[spot[inside]] == mine[inside]
                if only:
                    part, spot, hit = part.filter(pa.array(hit)), spot[hit], hit[hit]
                if part.num_rows:
                    cols = [v.take(pa.array(spot, mask=~hit)) for v in values]
                    yield pa.RecordBatch.from_arrays([*part.columns, *cols], schema=pa.schema([*part.schema, *schema]))

    return rows.mapInArrow(lean(run), out)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, share: int = 1000) -> DataFrame:
    """left with the other columns of right, which has one row a key and the number of left's rows with it in column `rows`.

    Keys with more than 1/share of all rows number less than `share`, so that part of right is broadcast with a proven
    bound and left's hot rows stay where they are; all other keys meet in a shuffle, where none has over 1/share of the
    rows. Null keys match null keys; a key that right lacks gets nulls. Both sides are read more than once: they should be
    tables. Any names may meet but those that both sides give.
    """
    total, least, most = right.agg(F.sum(name(rows)), F.min(name(rows)), F.max(name(rows))).first()
    limit = max((total or 0) // share, 1)
    hot = F.col("n") > limit
    n = len(keys)
    lefts = left.select(F.struct("*").alias("row"), *[name(k).alias(f"k{i}") for i, k in enumerate(keys)])
    values = F.struct(*[name(c) for c in right.columns if c not in keys])
    rights = right.select(*[name(k).alias(f"r{i}") for i, k in enumerate(keys)], values.alias("v"), name(rows).alias("n"))
    on = _all([F.col(f"k{i}").eqNullSafe(F.col(f"r{i}")) for i in range(n)])
    if most is None or most <= limit:  # no hot keys
        return lefts.join(rights.drop("n"), on, "left").select("row.*", "v.*")
    first = lefts.join(F.broadcast(rights.filter(hot)).drop("n"), on, "left").select("row", *[f"k{i}" for i in range(n)], "v")
    if least > limit:  # no others: one pass over left is enough
        return first.select("row.*", "v.*")
    done = first.filter("v is not null").select("row.*", "v.*")
    rest = first.filter("v is null").drop("v").join(rights.filter(~hot).drop("n"), on, "left").select("row.*", "v.*")
    return done.unionByName(rest)


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out
