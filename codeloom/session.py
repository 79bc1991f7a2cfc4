"""Session helpers: table access and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}  # folders of sessions that name none
_WRITTEN: dict[str, list[str]] = {}  # intermediate tables of each application


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only referenced columns are read, as the scan prunes the rest."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="codeloom-shared-")
        conf = _OWN[app]
    return conf


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage by writing a table into the shared folder and reading it back.

    The copy outlives any executor, is columnar and compressed, and carries the row
    counts and sizes that later joins are planned with. An empty input stays empty.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"codeloom-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a small input lies in so few files that most cores would idle; larger ones stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far, in a long session; results built on them must have been stored before. Returns how many."""
    paths, jvm = _WRITTEN.pop(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)
