"""Session helpers: settings the library relies on, table loading, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "loamgraph") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where a session has none, local mode takes a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loamgraph-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)  # only what exists can be marked
    files.deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files deleted as soon as it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; its files outlive lost executors."""
    shared_dir(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: no other action reads its shuffles


def keep(df: DataFrame, codec: str = "snappy") -> tuple[DataFrame, str]:
    """(the rows computed once, their folder). Columns compress to a fraction of a checkpoint; whoever asks discards the folder, else it goes when the driver ends."""
    path = scratch(df.sparkSession, "kept") + "/rows"
    with swept(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Rows that may be brought to the driver and sent out again with a plan.
SMALL = 10_000


def settle(df: DataFrame, large: bool = False) -> tuple[DataFrame, int]:
    """(the rows computed once, their number). Up to ``SMALL`` rows are kept in the plan itself; more, or rows known to be many, are checkpointed."""
    if not large:
        rows = df.limit(SMALL + 1).toArrow()
        if rows.num_rows <= SMALL:
            return df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows
    held = pin(df)
    return held, held.count()
