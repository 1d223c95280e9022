"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Spark deletes the shuffle files of a query when the query is over; nothing reads them again once its result is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Only where the session has none (tests on
    one machine) a temporary folder takes its place.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        _OWN[app] = f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
        atexit.register(drop, spark, _OWN[app])
    return _OWN[app]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; a stopped session has nothing left to delete with."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside; what it was before comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``done`` are scratch tables that nothing needs any more then; they are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with setting(spark, _CLEAN, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    forget(*done)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables. A table that `written` did not make stays."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            drop(table.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
