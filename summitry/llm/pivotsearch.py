"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(scale * x).  Distances of a row to the origin and to
pivots fix its place in the space that these span and its distance from that space:
it is the apex of a simplex over them.  The apex ``(y, r)`` of every vector is
computed once and stored beside it; as the parts outside that space have an inner
product of ``r_q * r_x`` at most, ``y_q . y_x + r_q * r_x`` bounds the product of two
vectors from above.  There are fewer pivots than dimensions, so the bounds of all
candidates cost less than their products.  Candidates of a query are evaluated in
the order of that bound until the next bound is under the query's k-th score, which
is exact: whatever is left out scores less.

The stated queries meet all rows in blocks: queries are cut into blocks of
``QUERY_BLOCK`` rows, candidates into blocks of ``CANDIDATE_BLOCK``; every cell of
that grid is one group of bounded size and keeps k rows a query.  Within a cell each
query walks alone, until its own stop.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part; vectors of unlike length are compared over the shorter one padded
with zeros; equal scores go to the smaller id, then to the first of equal rows;
every row is a candidate of all others and a query of its own, also where ids
repeat: two rows with one id that is asked for give two lists, and each may hold
the other; rows without an id take no part; with fewer candidates than k all are
returned; products are exact at any size; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Pivots at most, and as a share of the dimensions.
N_PIVOTS, PIVOT_SHARE = 64, 0.875
#: Rows from which pivots are chosen.
PIVOT_SAMPLE = 2000
#: Rows of a block; those of candidates grow to four times that in large tables, those of wide vectors hold so many numbers at most.
QUERY_BLOCK = 32768
CANDIDATE_BLOCK = 8192
BLOCK_NUMBERS = 1 << 22
#: Candidates of a step of a walk, and queries whose bounds are held at once.
STEP = 512
QUERIES_AT_ONCE = 64


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and the whole-number vector of every usable row (JVM only)."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", doubles.alias("v")).where(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far-apart pivots: each next one is farthest from the space that those before span."""
    chosen, left = [], np.array(sample, float)
    most = float(np.abs(left).max(initial=0))
    left /= most or 1
    for _ in range(min(n, *left.shape)):
        far = (left**2).sum(1)
        if far.max(initial=0) < 1e-12:
            break
        chosen.append(int(far.argmax()))
        axis = left[chosen[-1]] / np.sqrt(far.max())
        left -= (left @ axis)[:, None] * axis
    return sample[chosen]


def frame(pivots: np.ndarray) -> np.ndarray:
    """An orthonormal basis (dimensions, pivots) of the space that the pivots and the origin span."""
    return np.linalg.qr((pivots / (np.abs(pivots).max(initial=0) or 1)).T)[0]


def apexes(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Each row's place in the pivots' space, its distance from it, and a last part that makes up for rounding.

    The product of two rows here is a bound on the inner product of their vectors.
    """
    y = x @ basis
    away = np.sqrt(((x - y @ basis.T) ** 2).sum(1))
    # products of 24 bits, summed over all columns, are off by less than this share of both lengths
    loose = np.sqrt((x**2).sum(1) * (basis.shape[1] + 8) * 2.0**-22)
    return np.c_[y, away, loose].astype(np.float32)


def upper_bounds(table_q: np.ndarray, table_x: np.ndarray) -> np.ndarray:
    """Bounds on all inner products, a little loose so that rounding can't lower them."""
    # in 24 bits numbers end at 2**128
    kind = np.float32 if float(np.abs(table_q).max(initial=0)) * float(np.abs(table_x).max(initial=0)) < 2.0**110 else np.float64
    return table_q.astype(kind, copy=False) @ table_x.astype(kind, copy=False).T


class _Products:
    """Whole-number inner products: in the narrowest floats that hold them exactly, else integers."""

    def __init__(self, q: np.ndarray, x: np.ndarray):
        most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[-1]
        self.whole = most >= 2**53
        if self.whole:
            self.q, self.x = ([[int(v) for v in row] for row in side.tolist()] for side in (q, x))
        else:
            kind = np.float32 if most < 2**24 else np.float64
            self.q, self.x = q.astype(kind), x.astype(kind)

    def of(self, i: int, take: np.ndarray) -> np.ndarray:
        """Scores of some rows with query i."""
        if not self.whole:
            return (self.x[take] @ self.q[i]).astype(np.float64)
        out = np.empty(len(take), dtype=object)
        out[:] = [sum(a * b for a, b in zip(self.q[i], self.x[j])) for j in take.tolist()]
        return out


def kth_highest(scores: np.ndarray, k: int) -> float:
    """The k-th highest score, if there are so many; rounded down to the bits of bounds, so that no equal score is lost."""
    if len(scores) < k:
        return -np.inf
    bar = float(np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, -k)[-k])
    kind = np.float32 if abs(bar) < 2.0**120 else np.float64
    return float(np.nextafter(kind(bar), kind(-np.inf)))


def walk(i: int, bounds: np.ndarray, products: _Products, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best rows for query i, best first, and how many were evaluated; a row of bound -inf takes no part."""
    step = np.argpartition(bounds, len(bounds) - STEP)[len(bounds) - STEP :] if len(bounds) > STEP else np.arange(len(bounds))
    step = step[bounds[step] > -np.inf]
    places, scores, seen = step, products.of(i, step), len(step)
    bar = kth_highest(scores, k)
    left = (bounds >= bar) & (bounds > -np.inf)
    left[step] = False
    left = np.flatnonzero(left)
    left = left[np.argsort(-bounds[left])]
    for at in range(0, len(left), STEP):
        step = left[at : at + STEP]
        step = step[bounds[step] >= bar]
        if not len(step):
            break
        found = products.of(i, step)
        seen += len(step)
        good, kept = found >= bar, scores >= bar
        places, scores = np.r_[places[kept], step[good]], np.r_[scores[kept], found[good]]
        bar = kth_highest(scores, k)
    # equal scores go by place; integers beyond floats are sorted as they are
    order = places.argsort(kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")][:k]
    return places[order], scores[order], seen


def search_block(q: pd.DataFrame, x: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """The k best of one block for each query."""
    q, x = q.reset_index(drop=True), x.sort_values(["vec_id", "row"]).reset_index(drop=True)
    products = _Products(matrix(q.v.to_list(), width), matrix(x.v.to_list(), width))
    table_q, table_x = np.array(q.far.to_list(), np.float32), np.array(x.far.to_list(), np.float32)
    own, rows = q.row.to_numpy(), x.row.to_numpy()
    found = []
    for at in range(0, len(q), QUERIES_AT_ONCE):
        bounds = upper_bounds(table_q[at : at + QUERIES_AT_ONCE], table_x)
        bounds[rows[None] == own[at : at + QUERIES_AT_ONCE, None]] = -np.inf
        found += [walk(at + i, b, products, k) for i, b in enumerate(bounds)]
    sizes = [len(places) for places, _, _ in found]
    best = x.iloc[np.concatenate([places for places, _, _ in found])]
    return pd.DataFrame(
        {
            "query_row": np.repeat(own, sizes),
            "query_id": np.repeat(q.vec_id.to_numpy(), sizes),
            "row": best.row.to_numpy(),
            "vec_id": best.vec_id.to_numpy(),
            "score": [int(s) for _, scores, _ in found for s in scores.tolist()],
            "evaluated": np.repeat([seen for _, _, seen in found], sizes),
        }
    )


def blocks(n_rows: int, n_queries: int, width: int) -> tuple[int, int]:
    """Numbers of blocks of candidates and of queries: every row is copied to all blocks of the other side."""
    most = max(1, BLOCK_NUMBERS // width)
    rows = min(max(CANDIDATE_BLOCK, n_rows // 32), 4 * CANDIDATE_BLOCK, most)
    return max(1, -(-n_rows // rows)), max(1, -(-n_queries // min(QUERY_BLOCK, most)))


FOUND = "query_row long, query_id long, row long, vec_id long, score long, evaluated long"


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, n_pivots: int = N_PIVOTS) -> DataFrame:
    """The k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "topk")
    plain = scratch.save(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "plain")
    shape = plain.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    width = shape["width"] or 1
    sample = plain.orderBy(F.xxhash64("row")).limit(PIVOT_SAMPLE).collect()
    basis = frame(choose_pivots(matrix([r.v for r in sample], width), min(n_pivots, max(1, int(PIVOT_SHARE * width)))))

    def far(batches):
        for b in batches:
            b["far"] = list(apexes(matrix(b.v.to_list(), width), basis))
            yield b

    rows = scratch.save(plain.mapInPandas(far, "vec_id long, v array<double>, row long, far array<float>"), "rows")
    scratch.drop("plain")
    n_cand, n_query = blocks(shape["n"], shape["q"], width)
    cell = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(F.col("vec_id") % every == 0).select(cell(n_query, 1).alias("qb"), across(n_cand).alias("cb"), "row", "vec_id", "v", "far")
    candidates = rows.select(across(n_query).alias("to_qb"), cell(n_cand, 2).alias("to_cb"), F.col("row").alias("r"), F.col("vec_id").alias("i"), F.col("v").alias("w"), F.col("far").alias("f"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.rename(columns={"r": "row", "i": "vec_id", "w": "v", "f": "far"})
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])
        return search_block(left, right, width, k)

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("to_qb", "to_cb")).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "evaluated")


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings")).drop("evaluated")
