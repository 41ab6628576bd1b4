"""Token counts through a digest cache.

The cache is a parquet table (digest, tokenizer, n_tokens).  Content is
normalised (null becomes the empty text; nothing else changes, since any other
change would alter the count) and digested; digests join the stored counts of
this tokenizer version; one text of each missing digest is encoded and appended.

Which row stands for a digest is decided over (id, digest) alone.  A table of bits
marks the rows that need not be encoded; rows that it does not mark are encoded
where they are, and only marked ones are shuffled, for an exact answer.  Counts
return by a join on the digest, in which digests of many copies are broadcast.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a text is encoded once,
however many rows, ids or null ids bear it; repeated rows stay; null ids are kept;
texts of any length are encoded whole; an empty table gives no rows; other columns
of the input play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; nothing where no cache has been stored yet."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path) if common.exists(spark, path) else spark.createDataFrame([], CACHE_SCHEMA)
    # a task that ran twice may have stored a digest twice
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, path: str, tokenizer: str) -> DataFrame:
    def run(batches):
        encoder = bpe.WordEncoder.at(path)
        for b in batches:
            counts = encoder.count([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([tokenizer] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return common.in_arrow(texts.select("digest", "text"), run, CACHE_SCHEMA, "bpe")


def _misses(docs: DataFrame, rows: DataFrame, chosen: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(digest, text): one text of every digest in ``chosen`` (digest, one)."""
    spare = rows.join(chosen.withColumnRenamed("one", "id"), ["digest", "id"], "left_anti").select("digest", "id")
    # ids that bear a text twice are looked at again as well
    twice = rows.where("n > 1").select("digest", "id")
    looked = scratch.save(spare.unionByName(twice).select(F.xxhash64("digest", "id").alias("k")).distinct(), "looked")
    texts = docs.select(_id().alias("id"), _digest().alias("digest"), "text")
    flagged = common.marked(texts.withColumn("k", F.xxhash64("digest", "id")), "k", common.id_bitmap(looked, "k", looked.count()))
    sure = flagged.where(~F.col("_maybe")).select("digest", "text")
    doubtful = flagged.where("_maybe").join(chosen.withColumnRenamed("one", "id"), ["digest", "id"], "left_semi")
    return sure.unionByName(doubtful.dropDuplicates(["digest"]).select("digest", "text"))


def token_counts(docs: DataFrame, cache_path: str, limit: int = 512, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; misses are added to the cache."""
    spark = docs.sparkSession
    path = path or bpe.default_path()
    tokenizer = bpe.version(path)
    scratch = common.Scratch(spark, "counts")
    keyed = scratch.save(docs.select("doc_id", common.text_bytes("text").alias("n_bytes"), _digest().alias("digest")), "keyed")
    total = keyed.count()
    rows = scratch.save(keyed.groupBy("digest", _id().alias("id")).agg(F.count("*").alias("n")), "rows")
    digests = scratch.save(rows.groupBy("digest").agg(F.min_by("id", F.struct("n", "id")).alias("one"), F.sum("n").alias("copies")), "digests")
    chosen = digests.select("digest", "one").join(read_cache(spark, cache_path, tokenizer).select("digest"), "digest", "left_anti")
    chosen = scratch.save(chosen, "chosen")
    encode_counts(_misses(docs, rows, chosen, scratch), path, tokenizer).write.mode("append").parquet(cache_path)
    known = scratch.save(digests.select("digest", "copies").join(read_cache(spark, cache_path, tokenizer), "digest"), "known")
    counted = common.join_split(keyed, known, "digest", "copies", total)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every run does the whole work."""
    return token_counts(common.table(spark, sf_dir, "documents"), common.Scratch(spark, "op6").path("cache"))
