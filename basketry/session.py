"""Spark session and shared-storage helpers.

Marts and lineage cuts are written below the folder the cluster names in
``spark.checkpoint.dir``.  A private folder is only created when that setting
is missing (tests, ad-hoc local runs).
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(cpus: str | int | None = None, app: str = "basketry", shuffle_partitions: int | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BASKETRY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder for materialised tables: ``spark.checkpoint.dir``.

    Reads the setting from the session; sets one only when it is unset.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="basketry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _INSIDE, _BEFORE = threading.Lock(), Counter(), {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside remove their shuffle files when they end, not when the driver collects its garbage.

    For writes that are read back from storage.  A plan that is run again writes the files again, so a
    job of another thread meanwhile loses nothing; the setting is put back by the last one to leave.
    """
    key = id(spark)
    with _LOCK:
        if not _INSIDE[key]:
            _BEFORE[key] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _INSIDE[key] += 1
    try:
        yield
    finally:
        with _LOCK:
            _INSIDE[key] -= 1
            if not _INSIDE[key]:
                spark.conf.set(_CLEANUP, _BEFORE.pop(key))
