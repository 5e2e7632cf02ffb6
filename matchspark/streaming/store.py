"""Tables by bucket: a write replaces only the buckets that it touches.

A table is a folder of data files, ``data/v=<version>/bucket=<bucket>``, and of
manifests, ``manifest/v=<version>``, which name the version that holds each
bucket. A write puts whole buckets under a new version and then its manifest; a
reader takes the newest complete manifest, so that it sees all of a write or
nothing. A write carries the number of its batch: one that is tried again after
its manifest stands does nothing. Manifests hold a line a bucket, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, *parts: str):
    """A Hadoop path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions in a folder, on whatever file system it is."""
    root, fs = _path(spark, folder)
    if not fs.exists(root):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(x[2:]) for x in found if x.startswith("v=") and fs.exists(_path(spark, folder, x, "_SUCCESS")[0]))


class Store:
    """One such table. ``bucket`` makes the bucket of a row from its key; the caller keeps to one for a table's life, or calls ``rebucket``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def manifest(self) -> dict:
        """version, batch (the last that was written), buckets (bucket: version), meta (what the writer keeps)."""
        found = versions(self.spark, f"{self.path}/manifest")
        if not found:
            return {"version": -1, "batch": -1, "buckets": {}, "meta": {}}
        text = self.spark.read.text(f"{self.path}/manifest/v={found[-1]}", wholetext=True).first()[0]
        return {"version": found[-1]} | json.loads(text)

    def done(self, batch: int) -> bool:
        return batch <= self.manifest()["batch"]

    def read(self, only: list | None = None) -> DataFrame | None:
        """The rows of all buckets, or of those named; None if there are none."""
        held = self.manifest()["buckets"]
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in held.items() if only is None or b in set(map(str, only))]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, touched: list, rows: DataFrame, batch: int, meta: dict | None = None, alone: bool = False) -> None:
        """rows (with a column bucket) become all that the touched buckets hold; ``alone``: that the table holds."""
        old = self.manifest()
        version = old["version"] + 1
        data = f"{self.path}/data/v={version}"
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(data)
        full = [b for b in map(str, touched) if (lambda p: p[1].exists(p[0]))(_path(self.spark, data, f"bucket={b}"))]
        held = {b: v for b, v in old["buckets"].items() if b not in set(map(str, touched)) and not alone} | dict.fromkeys(full, version)
        text = json.dumps({"batch": max(batch, old["batch"]), "buckets": held, "meta": old["meta"] | (meta or {})})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v={version}")

    def vacuum(self, retain: int = 2) -> int:
        """Delete what the newest ``retain`` manifests do not name; the number of folders deleted."""
        found = versions(self.spark, f"{self.path}/manifest")
        named = set()
        for v in found[-retain:]:
            held = json.loads(self.spark.read.text(f"{self.path}/manifest/v={v}", wholetext=True).first()[0])["buckets"]
            named |= {(w, b) for b, w in held.items()}
        gone = [f"{self.path}/manifest/v={v}" for v in found[:-retain]]
        root, fs = _path(self.spark, self.path, "data")
        for v in fs.listStatus(root) if fs.exists(root) else []:
            number = int(v.getPath().getName()[2:])
            if number > (found[-1] if found else -1):
                continue  # a write that goes on
            buckets = [s.getPath().getName()[7:] for s in fs.listStatus(v.getPath()) if s.getPath().getName().startswith("bucket=")]
            live = [b for b in buckets if (number, b) in named]
            gone += [f"{self.path}/data/v={number}/bucket={b}" for b in buckets if b not in live] if live else [f"{self.path}/data/v={number}"]
        for folder in gone:
            fs.delete(_path(self.spark, folder)[0], True)
        return len(gone)


def by_hash(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(store: Store, incoming: DataFrame, bucket: Column, combine: Callable[[DataFrame | None, DataFrame], DataFrame], batch: int, meta: dict | None = None, touching: DataFrame | None = None) -> DataFrame | None:
    """Buckets of incoming rows (or of the rows ``touching``, where these are more) become combine(what they hold, incoming).

    The work follows the touched buckets, not the table. Returns the rows of the touched buckets.
    """
    touched = [r["bucket"] for r in (incoming if touching is None else touching).select(bucket.alias("bucket")).distinct().collect()]
    if not store.done(batch):
        rows = combine(store.read(touched), incoming)
        store.write(touched, rows.withColumn("bucket", bucket), batch, meta)
    return store.read(touched)


def replace(store: Store, rows: DataFrame, keys: DataFrame, key: str, buckets: int, batch: int) -> None:
    """The rows of the keys (a table with column ``key``) become ``rows``; keys without any lose what they had."""

    def combine(current: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if current is None else current.join(keys.select(key).hint("merge"), key, "left_anti").unionByName(new, allowMissingColumns=True)

    merge(store, rows, by_hash([key], buckets), combine, batch, touching=keys)


def rebucket(store: Store, bucket: Column) -> None:
    """Deal the whole table into other buckets, as its growth asks for; earlier versions stay until vacuumed."""
    rows = store.read()
    if rows is not None:
        dealt = rows.withColumn("bucket", bucket)
        store.write([r["bucket"] for r in dealt.select("bucket").distinct().collect()], dealt, store.manifest()["batch"], alone=True)
