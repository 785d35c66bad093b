"""A table of the newest rows per owner, kept up by a stream.

``<path>/data/version=<batch>/bucket=<n>`` holds the rows of the owners of one bucket as a
batch left them, ``<path>/manifest/version=<batch>`` says which version of each bucket counts.
A batch reads and writes only the buckets its rows fall into. Its manifest is written last, so a batch
that ends before is as if it had not begun, and one that runs again starts from the
same manifest and writes the same rows. Files that neither the new nor the last manifest
names are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelane.operators.sessions import _list, upsert_sessions

c = F.col
BUCKETS = 64
_MANIFEST = "bucket int, version bigint"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest was written to its end, in order."""
    files, where = _file_system(spark, f"{path}/manifest")
    if not files.exists(where):
        return []
    found = []
    for entry in files.listStatus(where):
        name = entry.getPath().getName()
        done, mark = _file_system(spark, f"{path}/manifest/{name}/_SUCCESS")
        if name.startswith("version=") and done.exists(mark):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict[int, int]:
    """Version of each bucket; at most BUCKETS rows."""
    if version is None:
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _rows(spark: SparkSession, path: str, schema, parts: dict[int, int]) -> DataFrame:
    places = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read_retained(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the newest whole version; none before the first."""
    versions = _versions(spark, path)
    return _rows(spark, path, schema, _manifest(spark, path, versions[-1] if versions else None))


def retention_writer(
    path: str, key, owner, created: str, ord: str, keep: int, buckets: int = BUCKETS
):
    """``foreachBatch`` function: put the batch by ``key``, keep the newest of each owner.

    A ``key`` belongs to one owner, so its bucket holds what it replaces.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        current = _manifest(spark, path, before[-1] if before else None)
        placed = F.pmod(F.xxhash64(*_list(owner)), F.lit(buckets)).cast("int").alias("bucket")
        batch = batch.persist()
        try:
            touched = {r["bucket"] for r in batch.select(placed).distinct().collect()}  # at most ``buckets``
            old = _rows(spark, path, batch.schema, {b: v for b, v in current.items() if b in touched})
            kept = upsert_sessions(old, batch, key, owner, created, ord, keep)
            kept.select("*", placed).repartition("bucket").write.mode("overwrite").partitionBy(
                "bucket").parquet(f"{path}/data/version={batch_id}")
        finally:
            batch.unpersist()
        written = _written(spark, f"{path}/data/version={batch_id}")
        now = {b: v for b, v in current.items() if b not in touched} | dict.fromkeys(written, batch_id)
        spark.createDataFrame(sorted(now.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/manifest/version={batch_id}")
        _forget(spark, path, before[:-1], [now, current])

    return write


def _written(spark: SparkSession, path: str) -> list[int]:
    files, where = _file_system(spark, path)
    names = [e.getPath().getName() for e in files.listStatus(where)] if files.exists(where) else []
    return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def _forget(spark: SparkSession, path: str, old: list[int], named: list[dict[int, int]]) -> None:
    """Delete older manifests, and buckets that only they named."""
    used = {(b, v) for parts in named for b, v in parts.items()}
    for version in old:
        for bucket, at in _manifest(spark, path, version).items():
            if (bucket, at) not in used:
                _delete(spark, f"{path}/data/version={at}/bucket={bucket}")
        _delete(spark, f"{path}/manifest/version={version}")


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)
