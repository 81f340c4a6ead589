"""Session helpers: table reading, lineage cuts in the shared folder, plan-size estimates."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named test table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run; once per application.

    The zip file is served by the driver's file server, so the executors need neither the repository nor its path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="folioforge-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"{home.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one of this process, if all executors run inside of it
    (tests, laptops); on a cluster, whose executors would not see such a folder, RuntimeError."""
    global _own_dir
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not _inside_one_process(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        folder = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, folder, True)
        _own_dir = f"file://{folder}"
    return _own_dir


def _inside_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


_written: list[str] = []


def _drop_written() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


atexit.register(_drop_written)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that survive the loss of any executor, and gives the reader real sizes.
    The files are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads (loops drop the table of the round before last)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = f.rsplit("/", 1)[0]
            stem = path.rsplit("/", 1)[-1]
            for known in [w for w in _written if w.endswith("/" + stem)]:
                p = jvm.org.apache.hadoop.fs.Path(known)
                p.getFileSystem(conf).delete(p, True)
                _written.remove(known)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the frame: for a plain scan, the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_enough(df: DataFrame, limit: int = 64 << 20) -> bool:
    """Whether a staged table is within the broadcast bound."""
    return plan_bytes(df) <= limit


def bounded_broadcast(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``broadcast(df)`` when the table's measured size is within ``limit``; else ``df``, joined by shuffle."""
    return F.broadcast(df) if small_enough(df, limit) else df
