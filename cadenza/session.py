"""Spark session helpers.

Cluster settings (``spark.checkpoint.dir`` in particular) are read from the
session; defaults are only filled in where they are unset, as in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "cadenza", **conf) -> SparkSession:
    """Return the active session or build a local one suited to tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None and not conf:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.cadenza.scanPartitions", cpus)  # local fixtures have one row group
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # broadcast joins only below an explicit, checked size
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="cadenza-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cadenza`` importable in Python workers (functions used by
    ``mapInPandas`` / ``applyInPandas`` are pickled by module reference):
    zip the package once per application and add it with ``addPyFile``,
    which distributes it to every executor."""
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tempfile.mkdtemp(prefix="cadenza-pkg-")
    path = shutil.make_archive(os.path.join(out, "cadenza"), "zip", root_dir=root, base_dir="cadenza")
    sc.addPyFile(path)
    _SHIPPED.add(app)
