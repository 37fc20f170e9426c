"""Steps that are written once, so that what follows reads them instead of running them again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder for a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lyrebird-steps-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the shared folder: survives the loss of an executor, and its plan begins anew."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go as soon as each is done, rather than when the driver next collects
    its garbage. For queries whose results are written, so that nothing reads their shuffles again."""
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.conf
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is large: columns that repeat are small there."""
    path = f"{checkpoint_dir(df.sparkSession)}/lyrebird/{name}-{uuid.uuid4().hex}"
    with cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
