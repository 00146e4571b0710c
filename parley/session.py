"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local session; a cluster's own settings are never overwritten.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("parley")
    for k, v in LOCAL.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's ``spark.checkpoint.dir``; a local one is set only where the session names none (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("a cluster must name spark.checkpoint.dir")
            where = tempfile.mkdtemp(prefix="parley-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared one, for what a query writes and reads back."""
    where = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    return "/" + where.removeprefix("file:").lstrip("/") if where.startswith("file:") else where


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table in the shared checkpoint folder and read back, column by column.

    A lost executor loses nothing, since the files are shared. They are deleted when the driver ends.
    """
    spark = df.sparkSession
    where = f"{shared(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(where)
    _written(spark).append(where)
    return spark.read.schema(df.schema).parquet(where)


def _written(spark: SparkSession) -> list[str]:
    """The tables that cut() has written with this session's context, which are deleted before it ends."""
    sc = spark.sparkContext
    if not hasattr(sc, "_parley_written"):
        sc._parley_written = []
        atexit.register(_clear, spark, sc._parley_written)
    return sc._parley_written


def _clear(spark: SparkSession, paths: list[str]) -> None:
    with contextlib.suppress(Exception):  # a context that has ended can't delete any more
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        for p in paths:
            where = hadoop.Path(p)
            where.getFileSystem(conf).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of ``spark``, once per context, through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_parley_shipped", False):
        return
    root = Path(__file__).resolve().parent
    where = tempfile.mkdtemp(prefix="parley-ship-")  # the driver's own; executors fetch from the driver
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    name = Path(where) / "parley_package.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(name))
    sc._parley_shipped = True
