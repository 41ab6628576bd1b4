"""Joins of all rows with all rows in a grid of bounded blocks.

Rows are hashed into blocks of about ``size`` rows; a cell of the grid is one
cogroup of two blocks, so no task sees more than two blocks and every cell reduces
its pairs before anything is shuffled on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4096


def dense(rows) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in rows]) if len(rows) else np.empty((0, 0))


def grid(left: DataFrame, right: DataFrame, reduce_cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, n_left: int, n_right: int, size: int = BLOCK) -> DataFrame:
    """Applies ``reduce_cell`` to every pair of blocks; both sides have a column id."""
    bl, br = max(1, -(-n_left // size)), max(1, -(-n_right // size))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # renamed on one side, so that a table can meet itself
    a = left.select("*").withColumn("_i", block(bl)).withColumn("_j", across(br))
    b = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns]).withColumn("_l", F.pmod(F.xxhash64("id_"), F.lit(br)).cast("int")).withColumn("_k", across(bl))

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return reduce_cell(x, y.rename(columns=lambda c: c.removesuffix("_")))

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_k", "_l")).applyInPandas(cell, schema)
