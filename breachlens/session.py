"""Session settings and the shared scratch folder."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# The JVM never compiles a method of more than 8000 bytes. Spark's own limit is far higher, so the code it makes for a wide
# row with a test per column would be interpreted, several times slower. With this limit it cuts such code up.
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}

# What a cluster job should set. Sizes follow the data: AQE starts from many small shuffle partitions and
# merges them to ``advisoryPartitionSizeInBytes``, so one setting serves a laptop and 100 TB.
CLUSTER_CONF = {
    **METHOD_LIMIT,
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def local_session(cores="*", shuffle_partitions=8, **conf) -> SparkSession:
    """A session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("breachlens")
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "12g",
        **METHOD_LIMIT,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    created = tempfile.mkdtemp(prefix="breachlens-")
    spark.sparkContext.setCheckpointDir(created)
    return created


_collecting: ContextVar[list | None] = ContextVar("collecting", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nothing else uses."""
    path = f"{scratch_root(spark).rstrip('/')}/breachlens/{name}-{uuid.uuid4().hex}"
    if _collecting.get() is not None:
        _collecting.get().append(path)
    return path


@contextmanager
def collected_scratch(paths: list):
    """Adds to ``paths`` what is staged inside, so that it can be removed when its results are no longer needed."""
    token = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(token)


def remove_scratch(spark: SparkSession, paths: list) -> None:
    """Remove staged tables. Frames that still read them fail afterwards."""
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from there.

    Used where several results come from one costly input, or where a position must not change when a
    lost executor's work is redone. Parquet rather than ``checkpoint()``: later readers prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, METHOD_LIMIT):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """``staged``, and the aggregates ``counts`` of the rows as they were written: no job of their own.

    They are taken right below the write, whose tasks count once however often they run.
    """
    watched = Observation()
    written = staged(df.observe(watched, *[value.alias(key) for key, value in counts.items()]), name)
    return written, watched.get


@contextmanager
def settings(spark: SparkSession, conf: dict):
    """Session settings for one write; what was set before is set again afterwards."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
