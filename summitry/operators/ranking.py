"""Sorts, limits, samples and random orders.

Random orders hash the id with a seed (md5, the same everywhere), so a repeated
task draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def integer(id_col: str, seed: int, low: int, high: int) -> Column:
    """A uniform whole number in low .. high for each row."""
    return F.lit(low) + F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(high - low + 1))


def uniform(id_col: str, seed: int) -> Column:
    """A uniform number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def shuffle(df: DataFrame, id_col: str, seed: int = 1) -> DataFrame:
    return df.orderBy(draw(id_col, seed), id_col)


def sample(df: DataFrame, m: int, id_col: str, seed: int = 1) -> DataFrame:
    """m different rows."""
    return shuffle(df, id_col, seed).limit(m)


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, k: int, group: str, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def sample_per_group(df: DataFrame, k: int, group: str, id_col: str, seed: int = 1) -> DataFrame:
    """At most k random rows of each group."""
    return top_per_group(df, k, group, draw(id_col, seed), F.col(id_col))


def sort_vectors(df: DataFrame, keys: list[tuple[int, bool]], value_col: str = "vector") -> DataFrame:
    """By several dimensions, each rising (True) or falling."""
    columns = [F.get(value_col, F.lit(d)) for d, _ in keys]
    return df.orderBy(*[c.asc() if up else c.desc() for c, (_, up) in zip(columns, keys)])
