"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


_guard, _inside = threading.Lock(), {}


def on_one_machine(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def local_scratch() -> str:
    """A folder of this machine, removed when the program ends."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def build_session(master: str = "local[8]", app: str = "hemolens", **conf: str) -> SparkSession:
    """A session with the library's defaults; beyond one machine it needs `spark.checkpoint.dir`, a shared folder."""
    if "spark.checkpoint.dir" not in conf:
        if not on_one_machine(master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        conf = {**conf, "spark.checkpoint.dir": local_scratch()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only on one machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not on_one_machine(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = local_scratch()
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call has used."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session with `key` set to `value`; as it was afterwards. Threads may be inside together: the last one out resets."""
    with _guard:
        depth, before = _inside.get(key, (0, spark.conf.get(key)))
        _inside[key] = depth + 1, before
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _guard:
            depth, before = _inside.pop(key)
            if depth > 1:
                _inside[key] = depth - 1, before
            else:
                spark.conf.set(key, before)


def cut_lineage(df):
    """Write the rows to the shared folder and go on from there.

    For loops whose plan would otherwise keep growing: computed once, safe against lost
    executors, and read back with real sizes for the next join choice. The shuffle files of the
    query that wrote them go with it, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
