"""Session helpers shared by tests, the bench and batch jobs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "barline", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-JVM session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


#: folders made for single-machine sessions, by application
_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    ``spark.checkpoint.dir`` names it, or else ``SparkContext.setCheckpointDir``. A cluster without either
    is refused, since executors would write to disks of their own; a single-machine session (tests, laptop
    runs) gets a temporary folder, which goes when Python ends. The setting itself cannot be changed in a
    running session, so that folder is kept here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="barline-ckpt-")
            atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
        root = _LOCAL_ROOTS[app]
    return root


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run under the checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: lets a finished query drop what it shuffled
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write a table that several branches read to the shared run folder and read it back.

    Without it each branch repeats the whole history of ``df``, and nested branches
    multiply. It also cuts the lineage: a lost executor re-reads files. With ``release``, what was
    shuffled for it leaves the disk as soon as the table is written.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
