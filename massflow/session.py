"""The session that this library expects."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches hold windows of many doubles, so they are bounded by bytes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(name: str = "massflow", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with the library's settings; on a cluster leave ``master`` and
    ``shuffle_partitions`` to the submit command."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session.  Where it is unset a local master (tests) gets a new local folder, and a
    cluster an error: executors would not see each other's files."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="massflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


_made: dict[str, SparkSession] = {}


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder.  Results are read from such tables whenever
    they are computed, so what is there at the end goes with the driver."""
    path = f"{shared_dir(spark)}/massflow-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(sweep)
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made.pop(path, None)


def sweep() -> None:
    """Delete all temporary tables that this driver made."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the gateway may be gone
            remove(spark, path)
        _made.pop(path, None)


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Delete what is made inside the block when it ends; its results must have been
    written elsewhere by then."""
    before = set(_made)
    try:
        yield
    finally:
        for path in set(_made) - before:
            remove(_made[path], path)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, and its path: cuts
    the lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """``df`` computed once into the shared folder: later plans start from there."""
    return written(df, tag)[0]
