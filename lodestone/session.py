"""Sessions with the settings that the engine is tuned for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it from wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="lodestone-ship-")) / "lodestone_package.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(packed))
    _SHIPPED.add(sc.applicationId)


def session(master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("lodestone").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in settings.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> None:
    """Parquet tables of a folder as views for SQL."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
