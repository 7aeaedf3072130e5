"""Keep-first over files that arrive one after the other: a load costs its own rows.

The rows to keep are the least per key by arrival order, and a least value merges: the first rows of a load, written on
their own, and the least of all of them are those of all files at once, in whatever order loads are added and however
often one is repeated. So a load reads its files, keeps one row per key, and writes these; nothing of earlier loads is
read. Reading the table takes the least per key over the loads, and ``compact`` writes that as one.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

from spendlens.operators.shape import keep_first
from spendlens.session import hadoop_path
from spendlens.sources.feeds import INGEST_ORD

LOAD = "load"


def add_load(feed: DataFrame, root: str, load_id: str, keys: Sequence[str] = ("date",), order: str = INGEST_ORD) -> None:
    """Write the first row per key of ``feed``, with its arrival order, as load ``load_id`` of the table at ``root``.

    A load of the same name is replaced, so a load that failed half-way is simply repeated. Arrival order must compare
    across loads, as that of ``read_feed`` does by file name. NULL keys are keys like any other; an empty feed adds an
    empty load.
    """
    if not load_id or any(c in load_id for c in "/=\\") or load_id.startswith((".", "_")):
        raise ValueError(f"not a load name: {load_id!r}")
    keep_first(feed, list(keys), order).write.mode("overwrite").parquet(os.path.join(root, f"{LOAD}={load_id}"))


def loads(spark: SparkSession, root: str) -> list[str]:
    """Names of the loads that were written to their end."""
    path, fs = hadoop_path(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith(f"{LOAD}=") and fs.exists(hadoop_path(spark, f"{root}/{n}/_SUCCESS")[0])]
    return sorted(n.split("=", 1)[1] for n in done)


def first_arrivals(spark: SparkSession, root: str, keys: Sequence[str] = ("date",), order: str = INGEST_ORD) -> DataFrame:
    """The first row per key of all loads, with its arrival order."""
    names = loads(spark, root)
    if not names:
        raise FileNotFoundError(f"no loads in {root}")
    rows = spark.read.parquet(*[os.path.join(root, f"{LOAD}={n}") for n in names])
    return keep_first(rows, list(keys), order)


def compact(spark: SparkSession, root: str, load_id: str, keys: Sequence[str] = ("date",), order: str = INGEST_ORD) -> None:
    """Write all loads as the one load ``load_id`` (a new name), then delete the others.

    If it is interrupted, some loads are there twice, which changes no result.
    """
    names = loads(spark, root)
    if load_id in names:
        raise ValueError(f"load {load_id!r} exists")
    add_load(first_arrivals(spark, root, keys, order), root, load_id, keys, order)
    for n in names:
        path, fs = hadoop_path(spark, os.path.join(root, f"{LOAD}={n}"))
        fs.delete(path, True)
