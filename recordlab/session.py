"""Session helper and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "recordlab", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RECORDLAB_DRIVER_MEMORY", "12g"))
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session, where driver and executors share one disk, may fall back to a
    temporary folder; on a cluster a missing setting is an error.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        known = tempfile.mkdtemp(prefix="recordlab-")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_scopes", default=())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES.get():
        made.append(path)
    return path


@contextmanager
def scratch_scope(made: list[str]) -> Iterator[list[str]]:
    """Notes in ``made`` every scratch path that this thread takes inside, for ``drop_scratch``."""
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(token)


def drop_scratch(spark: SparkSession, made: list[str]) -> None:
    """Removes scratch tables whose readers are done. A table that has been written from them, or
    checkpointed, no longer needs them; a DataFrame that still reads them fails."""
    while made:
        path = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows live in the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows kept as a scratch table: compressed, and a reader takes only the columns it needs."""
    path = scratch_path(df.sparkSession, name)
    # files cannot hold a column without a type
    void = {c: F.lit(None) for c, kind in df.dtypes if kind == "void"}
    kept = df.drop(*void) if void else df
    kept.write.parquet(path)
    rows = df.sparkSession.read.schema(kept.schema).parquet(path)
    return rows.withColumns(void).select(*[F.col(f"`{c}`") for c in df.columns]) if void else rows


@contextmanager
def cleaned_exchanges(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's exchanges go when the query ends, not at some later collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
