"""Session settings and table access."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = "spark.timelane.hotRows"
HOT_ROWS_DEFAULT = 4_000_000
WINDOW_ROWS_DEFAULT = 500_000
HEAVY_ROWS = 50_000

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "timelane", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library relies on; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        STATE_STORE: ROCKSDB,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession, default: int = HOT_ROWS_DEFAULT) -> int:
    """Rows of one key that a single task may order; larger keys are split."""
    return int(spark.conf.get(HOT_ROWS, str(default)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; without it, a folder in the warehouse.

    The warehouse is where executors read and write tables, so it is shared wherever Spark
    runs on more than one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", "")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(configured or f"{warehouse}/timelane-steps")


def scratch_path(spark: SparkSession) -> str:
    """A new place in the folder of :func:`ensure_checkpoint_dir`, removed when Spark ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/step-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan before work that is heavy per row: a task gets about ``HEAVY_ROWS`` rows.

    Splits of a file that hold no row group are empty, so the rows of each split are counted (from the
    files' footers). A scan whose rows are spread already is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    used, most, total = splits.agg(F.count(F.lit(1)), F.max("rows"), F.sum("rows")).first()
    if used >= cores and most <= 2 * HEAVY_ROWS:
        return df
    return df.repartition(max(cores, -(-(total or 0) // HEAVY_ROWS)))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts)


class Tables:
    """The parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            path = os.path.join(self.folder, f"{name}.parquet")
            self._read[name] = self.spark.read.parquet(path)
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)
