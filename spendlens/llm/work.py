"""Shared-folder tables and exact global positions, used by the operators of this subpackage.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``, which every executor and
the driver can reach, so a lost executor costs a re-read and never the lineage behind the table.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a scratch folder of its own only on a local master with none set."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-llm-"))
    return sc.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source, once per application; needed where it is not installed on them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="spendlens-src-")) / "spendlens_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.glob("spendlens/**/*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/spendlens-{label}-{uuid.uuid4().hex}"
    hadoop_path, fs = hadoop(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    hadoop_path, fs = hadoop(spark, path)
    fs.delete(hadoop_path, True)


def hadoop(spark: SparkSession, path: str):
    """A path and its file system, whichever that is."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: (table, path)."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    return store(df, label)[0]


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has ``rows`` or fewer; else joins shuffle, as Spark sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(n_rows: int, rows: int = ROWS_PER_BUCKET) -> int:
    """Buckets that hold about ``rows`` rows each."""
    return max(1, -(-n_rows // rows))


def offsets(counts: DataFrame, group: list[str], order: list[Column], count: str, out: str) -> DataFrame:
    """``counts`` with ``out``: the sum of ``count`` over the rows before each one in its group.

    One row per bucket comes in (about one per ``ROWS_PER_BUCKET`` rows of data), so the window is small.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))
