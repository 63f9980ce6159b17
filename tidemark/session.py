"""Session helpers: settings, table reads, and a place for intermediate tables that every executor sees."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: Largest frame that is broadcast, in rows.
BROADCAST_ROWS = 100_000
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "tidemark", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be any that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started: by its path on this machine, as a zip file on a cluster."""
    if not spark.sparkContext.master.startswith("local"):
        _ship(spark)
        return
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def _ship(spark: SparkSession) -> None:
    """Send the package to all executors as a zip file, once an application."""
    if _SHIPPED.get("application") != spark.sparkContext.applicationId:
        folder = tempfile.mkdtemp(prefix="spark-")
        path = os.path.join(folder, "tidemark_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
            for base, _, files in os.walk(os.path.dirname(os.path.abspath(__file__))):
                for name in sorted(f for f in files if f.endswith(".py")):
                    whole = os.path.join(base, name)
                    packed.write(whole, os.path.relpath(whole, ROOT))
        spark.sparkContext.addPyFile(path)
        _SHIPPED["application"] = spark.sparkContext.applicationId


def is_small(frame: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most so many rows; no more than these are counted."""
    return frame.limit(most + 1).count() <= most


def if_small(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked to be broadcast if it is small; else Spark chooses, and may shuffle."""
    return F.broadcast(frame) if is_small(frame, most) else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and Spark runs on this machine alone (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return path.rstrip("/")


_LOCAL: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages restart from the files, not from df's plan."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(fields: list[StructField], ddl: str) -> StructType:
    """The fields with those of a DDL string after them."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])
