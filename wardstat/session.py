"""Session defaults and the helpers that materialise intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

# Marks a session whose options have been set.
_TUNED = "wardstat.tuned"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the Arrow functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wardstat-code-")) / "wardstat.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Ship the package and set, once per session, those runtime options that the user left unset."""
    ship_code(spark)
    if spark.conf.get(_TUNED, None) is None:
        # Split a hot join key even where that costs another exchange.
        wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
        for key, value in wanted.items():
            if not spark.sparkContext.getConf().contains(key) and not _changed(spark, key):
                spark.conf.set(key, value)
        spark.conf.set(_TUNED, "true")
    return spark


def _changed(spark: SparkSession, key: str) -> bool:
    """Whether the session differs from the default that a new session would have."""
    return spark.conf.get(key) != spark.newSession().conf.get(key)


def local_session(cores: int | str = 8, app: str = "wardstat", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Without call sites in error messages, wide plans are put together much faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster that folder
    would live on one machine and be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="wardstat-")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the reliable checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame) -> DataFrame:
    """Write a lookup table once below the shared folder and read it back.

    The planner then knows its size in bytes and broadcasts it where
    ``spark.sql.autoBroadcastJoinThreshold`` allows that.
    """
    path = scratch_path(df.sparkSession, "lookup")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
