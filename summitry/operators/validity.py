"""External validity indices of two labelings, from their contingency table.

All pair-counting, entropy and matching indices are sums over the non-empty cells
and their margins; one pass over that small table gives them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR, ENTROPY, MATCHING = ("ri", "ari", "jaccard", "fm"), ("nmi", "nvi", "mi", "vi"), ("nvd", "purity", "ci_part")
ALL = PAIR + ENTROPY + MATCHING
#: What the evaluation tool's selectors stand for.
SELECTORS = {"P": ("ri", "ari", "jaccard", "fm"), "N": ("nmi", "nvi", "mi", "vi"), "M": ("nvd", "ch", "ci", "ci_star", "ci_part")}


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """(l1, l2, n) of the cells that hold rows; rows without a label in either play no part."""
    both = df.select(F.col(first).alias("l1"), F.col(second).alias("l2")).where("l1 is not null and l2 is not null")
    return both.groupBy("l1", "l2").agg(F.count("*").alias("n"))


def contingency_of(p1: DataFrame, p2: DataFrame) -> DataFrame:
    """Of two partitions (id, label)."""
    return contingency(p1.select("id", F.col("label").alias("l1")).join(p2.select("id", F.col("label").alias("l2")), "id"), "l1", "l2")


def margins(df: DataFrame, first: str, second: str) -> DataFrame:
    """The table with its row, column and grand totals (null labels)."""
    return contingency(df, first, second).cube("l1", "l2").agg(F.sum("n").alias("n"))


def indices(cells: DataFrame) -> DataFrame:
    """One row with all indices of a contingency table."""
    rows, columns = Window.partitionBy("l1"), Window.partitionBy("l2")
    n, a, b, t = (F.col(c) for c in ("n", "a", "b", "t"))
    full = cells.withColumn("a", F.sum("n").over(rows)).withColumn("b", F.sum("n").over(columns))
    full = full.withColumn("top_row", F.row_number().over(rows.orderBy(n.desc(), "l2"))).withColumn("top_column", F.row_number().over(columns.orderBy(n.desc(), "l1")))
    full = full.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("t"))))
    best1, best2 = F.when(F.col("top_row") == 1, n), F.when(F.col("top_column") == 1, n)
    s = full.agg(
        F.max("t").cast("double").alias("t"),
        F.sum(n * n).cast("double").alias("nij"),
        F.sum(n * a).cast("double").alias("ni"),
        F.sum(n * b).cast("double").alias("nj"),
        F.sum(-n / t * F.log2(a / t)).alias("h1"),
        F.sum(-n / t * F.log2(b / t)).alias("h2"),
        F.sum(n / t * F.log2(n * t / (a * b).cast("double"))).alias("mi"),
        F.sum(best1).cast("double").alias("m1"),
        F.sum(best2).cast("double").alias("m2"),
        (F.countDistinct("l2") - F.countDistinct(F.when(F.col("top_row") == 1, F.col("l2")))).alias("orphans2"),
        (F.countDistinct("l1") - F.countDistinct(F.when(F.col("top_column") == 1, F.col("l1")))).alias("orphans1"),
    )
    t, nij, ni, nj, h1, h2, mi = (F.col(c) for c in ("t", "nij", "ni", "nj", "h1", "h2", "mi"))
    pairs = t * (t - 1) / 2
    agree = pairs + nij - (ni + nj) / 2
    chance = (t * (t * t + 1) - (t + 1) * ni - (t + 1) * nj + 2 * ni * nj / t) / (2 * (t - 1))
    together = (nij - t) / 2
    only1, only2 = (ni - nij) / 2, (nj - nij) / 2
    return s.select(
        (agree / pairs).alias("ri"),
        F.when(F.abs(pairs - chance) < 1e-9, 0.0).otherwise((agree - chance) / (pairs - chance)).alias("ari"),
        (together / (together + only1 + only2)).alias("jaccard"),
        F.sqrt(together / (together + only1) * together / (together + only2)).alias("fm"),
        F.when(h1 + h2 > 0, 2 * mi / (h1 + h2)).otherwise(1.0).alias("nmi"),
        F.when(h1 + h2 > 0, (h1 + h2 - 2 * mi) / (h1 + h2)).otherwise(0.0).alias("nvi"),
        mi.alias("mi"),
        (h1 + h2 - 2 * mi).alias("vi"),
        ((2 * t - F.col("m1") - F.col("m2")) / (2 * t)).alias("nvd"),
        (F.col("m1") / t).alias("purity"),
        F.greatest("orphans1", "orphans2").alias("ci_part"),
    )


def criterion_h(cells: DataFrame) -> float:
    """1 - matched / N under greedy one-to-one matching by falling cell size."""
    used1, used2, matched, total = set(), set(), 0, 0
    for r in cells.orderBy(F.col("n").desc(), "l1", "l2").toLocalIterator():  # K1 * K2 cells, a part at a time
        total += r.n
        if r.l1 not in used1 and r.l2 not in used2:
            used1.add(r.l1)
            used2.add(r.l2)
            matched += r.n
    return 1 - matched / total if total else 0.0


def evaluate(p1: DataFrame, p2: DataFrame, which: list[str] | tuple[str, ...] = ("ari", "ri", "ci_part", "nmi")) -> dict[str, float]:
    """The chosen indices of two partitions (id, label) with the same ids."""
    n1, n2 = p1.count(), p2.count()
    if n1 != n2:
        raise ValueError(f"labelings of {n1} and {n2} points")
    unknown = [w for w in which if w not in (*ALL, "ch")]
    if unknown:
        raise ValueError(f"unknown indices {unknown}")
    cells = contingency_of(p1, p2)
    row = indices(cells).first().asDict()
    if "ch" in which:
        row["ch"] = criterion_h(cells)
    return {w: row[w] for w in which}
