"""Session helpers.

Production code receives a session from the caller; ``get_session`` exists for tests,
the bench and command-line use. The checkpoint folder always comes from the session
(``spark.checkpoint.dir``); a local scratch folder is only chosen when none is set.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Values every session used by this library should carry.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files (materialized feeds, passes of bins) are removed once no plan references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "spendlens",
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "8g")
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the session's ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment to a shared file system. Only when
    it is unset (local tests) is a fresh scratch folder chosen and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                               "(a machine-local scratch folder would not survive a lost executor)")
        conf = tempfile.mkdtemp(prefix="spendlens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, without the plan behind it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whichever that is."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())
