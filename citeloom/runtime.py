"""Session, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for one machine, as tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark context, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_citeloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.parent.suffix != ".zip":
        target = os.path.join(tempfile.mkdtemp(prefix="citeloom-"), "citeloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        sc.addPyFile(target)
    sc._citeloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; only where it is unset and everything runs in one process, one of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if shared is None:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"citeloom-{uuid.uuid4().hex}"))
        return sc._jsc.sc().getCheckpointDir().get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, written to the checkpoint folder so that a lost executor loses nothing."""
    ship(df.sparkSession)
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
