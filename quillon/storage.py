"""Tables in the folder that the cluster shares, to cut lineage.

A table goes to the folder that ``spark.checkpoint.dir`` names, which every executor can read, so a lost
executor loses nothing that a later stage needs. Where that is unset, a folder of this process serves, but only
with a local master: elsewhere each executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and the master is local, one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share; the master is {master}")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillon-tables-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table as read from there."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that :func:`keep` returned and nothing will read again; any other DataFrame is left alone."""
    for df in tables:
        path = df.__dict__.pop("_kept_at", None)
        if path:
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application kept; for its end, when no result is read any more."""
    delete(spark, own_dir(spark))
