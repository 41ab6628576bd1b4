"""Cutting the lineage of iterative plans through written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own only for a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(shared_folder, "own", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = shared_folder.own = tempfile.mkdtemp(prefix="summitry-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def _delete(spark: SparkSession, uri: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  (at the end there may be no session to ask)
        pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table that survives lost executors; deleted when Python ends."""
    spark = df.sparkSession
    base = getattr(cut, "base", None)
    if base is None or base[0] is not spark:
        base = cut.base = (spark, f"{shared_folder(spark)}/cuts-{uuid.uuid4().hex[:12]}")
        atexit.register(_delete, *base)
    path = f"{base[1]}/{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut = path
    return kept


def drop(kept: DataFrame | None) -> None:
    """Deletes the table of a cut that nothing reads any more."""
    if getattr(kept, "_cut", None):
        _delete(kept.sparkSession, kept._cut)
