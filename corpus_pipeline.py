"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as parquet in the shared folder and reads again as the next one's input.
All stages but the last return the columns of ``documents``.

toxicity         rows whose score reaches the threshold go
language_id      rows without a language, or with a doubtful one, go
near_duplicates  one document of each component of near copies stays, the least id
decontamination  documents that hold a benchmark item go
pieces           the n best piece segmentations of each text, as digests

Rows with null texts pass as empty texts do: they are not toxic, but have no
language, so the second stage drops them.  Rows without an id are kept or dropped by
their text like others, but are nobody's near copy; rows that repeat an id and text
stay or go together.  Ties follow the operators' rules.  Texts of any length are read
whole.  Extra columns, also such that are called like an operator's own, pass through
all stages but the last.  Stages over an empty table return none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from summitry.llm import common, decontaminate, jaccardjoin, langid, pieces, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccardjoin.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]

#: No stage can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
