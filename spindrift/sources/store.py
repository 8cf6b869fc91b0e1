"""Tables as Parquet in buckets under one manifest, and payloads as compressed blobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut

#: Buckets of a table that is changed by key; a change rewrites those that hold its keys.
BUCKETS = 64


class SnapshotStore:
    """A folder of tables with one writer.

    A manifest names the folders that each table consists of. commit() writes the changed rows' buckets of any number of
    tables to new folders, and then one new manifest: readers see all of its changes or none, and so does who starts again
    after a crash. What a commit writes grows with the buckets that its changes touch, not with the tables.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[int, dict] = {}

    def versions(self) -> list[int]:
        p = self._path(f"{self.root}/_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        found = self.versions()
        if not found:
            return {}
        version = version or found[-1]
        if version not in self._known:
            stream = self._fs.open(self._path(f"{self.root}/_manifest/{version}"))
            self._known = {version: json.loads(bytes(stream.readAllBytes()))}
            stream.close()
        return dict(self._known[version])

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        folders = sorted(set(self._manifest().get(table, {}).values()))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def commit(self, puts: dict[str, tuple[DataFrame, list[str] | None]]) -> int:
        """Change tables at once: rows by key (an upsert), or a whole table where there are no keys. The new version."""
        manifest = self._manifest()
        manifest.setdefault("#buckets", {"n": str(self.buckets)})  # a store keeps the number that it began with
        self.buckets = int(manifest["#buckets"]["n"])
        with ThreadPoolExecutor(max(1, len(puts))) as pool:  # the tables' jobs do not wait for each other
            made = {table: pool.submit(self._changed, table, manifest.get(table, {}), *put) for table, put in puts.items()}
            manifest |= {table: f.result() for table, f in made.items()}
        return self._publish(manifest)

    def _changed(self, table: str, old: dict[str, str], rows: DataFrame, keys: list[str] | None) -> dict[str, str]:
        """The folders of a table after a change, whose own are written."""
        folder = f"{table}/{uuid.uuid4().hex}"
        if keys is None:
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            return {"": folder}
        rows = cut(rows.withColumn("_bucket", self._bucket(keys)), "changes")
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        if not touched:
            return old
        # A table that was written whole before is dealt to buckets as a whole.
        past, old = ([old[""]], {}) if "" in old else ([old[str(b)] for b in touched if str(b) in old], old)
        if past:
            kept = self.spark.read.schema(rows.drop("_bucket").schema).parquet(*[f"{self.root}/{f}" for f in past])
            rows = kept.withColumn("_bucket", self._bucket(keys)).join(rows.select(*keys), keys, "left_anti").unionByName(rows)
        out = rows.repartition("_bucket").withColumn("bucket", F.col("_bucket")).drop("_bucket").sortWithinPartitions("bucket")
        out.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        made = {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.isDirectory()}
        return old | {b: f"{folder}/bucket={b}" for b in made}

    def _publish(self, manifest: dict) -> int:
        version = (self.versions() or [0])[-1] + 1
        part, whole = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_manifest/{version}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(whole) or not self._fs.rename(part, whole):
            raise RuntimeError("the store has another writer")
        return version

    def write(self, table: str, rows: DataFrame, keys: list[str] | None = None) -> int:
        return self.commit({table: (rows, keys)})

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the last `keep`, and folders that none of those names."""
        versions = self.versions()
        needed = {f for v in versions[-keep:] for t in self._manifest(v).values() for f in t.values()}
        for v in versions[:-keep]:
            for f in {f for t in self._manifest(v).values() for f in t.values()} - needed:
                self._fs.delete(self._path(f"{self.root}/{f}"), True)
            self._fs.delete(self._path(f"{self.root}/_manifest/{v}"), True)


BLOB = T.StructType([T.StructField("key", T.StringType()), T.StructField("data", T.BinaryType())])


def compress(blobs: DataFrame, level: int = 6) -> DataFrame:
    """key, data (zstd) of key, payload (string)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "data": [None if p is None else c.compress(p.encode()) for p in b["payload"]]})

    return blobs.select("key", "payload").mapInPandas(run, BLOB)


def decompress(blobs: DataFrame) -> DataFrame:
    """key, payload (string) of key, data (zstd)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "payload": [None if x is None else d.decompress(x).decode() for x in b["data"]]})

    return blobs.select("key", "data").mapInPandas(run, "key string, payload string")
