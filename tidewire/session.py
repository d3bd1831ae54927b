"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows may carry long arrays, so batches to Python are bounded by size too.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    # Many small folders are listed by few tasks, not by one each.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}

# A run of many small joins would send a table of up to 10 MB to the driver for each of them.
BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "256k"

# What is wide and read few times is written small: terms repeat across rows, beyond the usual dictionary of 1 MB.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}

_LOCAL_SCRATCH: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan in this package expects."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def small_broadcasts(*sessions: SparkSession) -> Iterator[None]:
    """Within, joins that name no broadcast themselves use one only for the smallest tables."""
    key, most = BROADCAST
    before = [spark.conf.get(key) for spark in sessions]
    for spark in sessions:
        spark.conf.set(key, most)
    try:
        yield
    finally:
        for spark, value in zip(sessions, before, strict=True):
            spark.conf.set(key, value)


def local_session(
    cores: int | str = 8, app: str = "tidewire", memory: str = "12g", scratch: str | None = None
) -> SparkSession:
    """A session for tests and the bench; clusters bring their own.

    ``scratch`` is the folder for written intermediates (``spark.checkpoint.dir``).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may go
    without: there a temporary folder is visible to every task.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tidewire-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tidewire/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Survives lost executors, ends the lineage, keeps column pruning, and gives
    the planner real sizes so that joins against it broadcast only when small.
    A ``packed`` table takes less disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**(PACKED if packed else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, name: str, packed: bool = False, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut`` that also tells the number of rows, and ``metrics``, without another job.

    A retried task may be counted twice, so the numbers size things and tell
    empty from not empty; no result is computed from them.
    """
    seen = Observation()
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]
    )
    written = cut(watched, name, packed)
    return written, seen.get


def widen(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """Give a scan of few splits one partition per core before heavy row work.

    A scan that already has as many splits as cores passes through untouched, so
    large inputs are not shuffled.  Where narrow rows are made into wide ones, ``rows``
    is the most of a partition: a split of a small file may hold millions.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    wanted = cores
    if rows is not None:
        wanted = max(cores, -(-scan.count() // rows))
    if splits >= wanted:
        return scan
    return scan.repartition(wanted)
