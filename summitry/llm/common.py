"""What the operators of this package share: table access and a scratch store.

Intermediate results go to parquet tables in the folder that the cluster names
in ``spark.checkpoint.dir``; a lost executor then costs one task, not a lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see; an own one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        # a name without a scheme is in the default file system, whatever that is
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    own = getattr(shared_folder, "own", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = shared_folder.own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def local_path(uri: str) -> str | None:
    """The mounted path behind a folder name, or None if it is in a remote store."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of any file system; at the session's end there may be nothing left to ask."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


#: A gathered table has so many files for each core, or a file for so many shuffle partitions if that is more.
FILES_OF_CORE, PARTITIONS_OF_FILE = 4, 8


def files_of(spark: SparkSession) -> int:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(FILES_OF_CORE * spark.sparkContext.defaultParallelism, -(-partitions // PARTITIONS_OF_FILE))


class Scratch:
    """Named parquet tables of one operator run, dropped when used up, at the latest when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        local = local_path(self.base)
        if local:
            atexit.register(shutil.rmtree, local, True)
        else:
            atexit.register(delete, spark, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def gather(self, df: DataFrame, name: str) -> DataFrame:
        """Saves short rows (names, links) of many shuffle partitions in few files; a task writes several.

        On a mounted folder an executor's JVM starts a process for each file's
        permissions, which counts as another JVM of its size until it runs.
        """
        return self.save(df.coalesce(files_of(self.spark)), name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


def crc32_of(column: Column | str) -> Column:
    """Unsigned crc32 of a value's text; null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8"))


def held_out(column: Column | str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32(id as text) mod 4 is 2."""
    return crc32_of(column) % 4 == 2


def held_out_py(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def text_bytes(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


#: Bits of the id filter at most, so that its table has 2**20 rows (16 MB) at most, whatever the number of ids.
MOST_BITS = 1 << 26


def id_bitmap(ids: DataFrame, column: str, rows: int) -> tuple[DataFrame, int]:
    """A bit for the hash of every id, as (word, bits), and the number of bits; ``rows`` counts the ids."""
    size = min(MOST_BITS, max(1 << 12, 1 << (16 * rows).bit_length()))
    h = ids.select(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size)).alias("h"))
    return h.groupBy(F.expr("h div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits")), size


def marked(df: DataFrame, column: str, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """Adds ``_maybe``: whether the id may be among those of the bitmap; an exact join has to follow.

    The columns _bit, _word, _bits and _maybe are this function's own.
    """
    words, size = bitmap
    df = df.withColumn("_bit", F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size)))
    df = df.withColumn("_word", F.expr("_bit div 64"))
    hit = F.coalesce(F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1") == 1, F.lit(False))
    return df.join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), "_word", "left").withColumn("_maybe", hit).drop("_bit", "_word", "_bits")


def without(df: DataFrame, column: str, ids: DataFrame, rows: int) -> DataFrame:
    """Rows whose id isn't among ``ids`` (one column of that name); only rows that may be are shuffled."""
    flagged = marked(df, column, id_bitmap(ids, column, rows))
    sure = flagged.where(~F.col("_maybe")).drop("_maybe")
    doubtful = flagged.where("_maybe").drop("_maybe").join(ids, column, "left_anti")
    return sure.select(df.columns).unionByName(doubtful.select(df.columns))


#: Keys that hold more than one in so many of all rows count as hot; there are at most this many of them.
SHARE = 10_000


def join_split(left: DataFrame, right: DataFrame, key: str, copies: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``right``, one row a key with the number of its copies among ``total`` rows, to ``left``.

    Rows of hot keys stay where they are and get the few hot rows of ``right`` by
    broadcast (at most ``SHARE`` rows, by the definition of hot); the others are
    shuffled by the key.  ``how`` is inner or left.
    """
    hot = F.col(copies) * SHARE > max(total, 100 * SHARE)
    few = right.where(hot).drop(copies)
    warm = left.join(F.broadcast(few), key)
    cold = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~hot).drop(copies), key, how)
    return warm.unionByName(cold)


#: What a batch that goes to Python holds at most: rows, and about as many bytes.
BATCH_ROWS, BATCH_BYTES = 5000, 8 << 20
#: Workers outlive tasks: whose memories they hold, and how to drop them.
_tenant: dict = {"name": None, "memories": []}


def remembered(memory):
    """Registers a worker's memory (dict or list) that goes when another operator comes."""
    _tenant["memories"].append(memory)
    return memory


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def move_in(name: str) -> None:
    """One operator at a time has its memories in a worker."""
    if _tenant["name"] not in (None, name):
        for memory in _tenant["memories"]:
            memory.clear()
        give_back()
    _tenant["name"] = name


def slices(batch: pa.RecordBatch):
    """Runs of rows of a batch, of bounded number and size; a longer row is a run of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + BATCH_ROWS, max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _lower_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to the sizes above, and never raises what is lower.

    The plan takes these settings when it runs, so they stay; batches of the default
    size took an executor beyond 3000 MB.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def in_arrow(df: DataFrame, run, schema, name: str) -> DataFrame:
    """mapInArrow over batches of bounded size, in a worker without other operators' memories."""
    _lower_batches(df.sparkSession)

    def task(batches):
        move_in(name)
        yield from run(part for b in batches for part in slices(b))
        give_back()

    return df.mapInArrow(task, schema)
