"""What the operators share: above all the tables that they write between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lyrebird.functions.workers import ship  # noqa: F401  the operators take it from here
from lyrebird.operators.steps import cleared

#: ASCII white space, as a Java or RE2 character class.
SPACE = r"\x20\x09-\x0D"
#: Bytes A-Z to a-z, all others unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Tables that materialise() wrote, and their paths.
_written: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local folder will do for a local master (tests); on a cluster it is an error, as each executor
    would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="lyrebird-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove, spark, base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended, and its scratch folder with it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lyrebird/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives the loss of any executor. What was shuffled
    for it is deleted."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with cleared(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() wrote and that no later step reads."""
    for df in tables:
        held, path = _written.pop(id(df), (None, None))
        if held is not None and held() is df:
            _remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
