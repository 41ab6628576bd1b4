"""The clustering model: graph, statistics, peaks, labels; and evaluation of files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, knn, quantize, validity
from ..sources import binary, lines
from .cut import cut


@dataclass(frozen=True)
class DensityPeaks:
    """Options of a clustering; ``fit`` runs it.

    ``distance`` is a name (l2, l1, cos, mnkw, lev, dice, set, ...) or a callable of
    two pandas Series.  ``method`` is rpdiv, nndescent or brutef; ``exact`` compares
    every point with all denser ones.
    """

    n_clusters: int = 256
    k: int = 20
    method: str = "rpdiv"
    distance: str | Callable = "l2"
    p: float | None = None
    leaf_size: int | None = None
    max_iter: int = 100
    tol: float = 0.01
    nnd_start: float = 0.1
    seed: int = 1
    exact: bool = False
    tie_break: str = "rank"

    def fit(self, df: DataFrame, id_col: str = "id", value_col: str = "value") -> "Model":
        if self.n_clusters < 1 or self.k < 1:
            raise ValueError("n_clusters and k are 1 at least")
        pts = cut(knn.points(df, id_col, value_col))
        options = {"distance": self.distance, "id_col": "id", "value_col": "value", "p": self.p}
        if self.method != "brutef":
            options |= {"leaf_size": self.leaf_size, "max_iter": self.max_iter, "tol": self.tol, "nnd_start": self.nnd_start, "seed": self.seed}
        edges = cut(knn.build(pts, self.k, self.method, **options))
        stats = cut(density.statistics(edges, pts, self.distance, self.p, self.exact, self.tie_break))
        if self.tie_break == "additive" and stats.where("nhd is null").count() > 1:
            raise ValueError("several points have no denser one; use tie_break rank")
        peaks = density.select_peaks(stats, self.n_clusters)
        return Model(self, pts, edges, stats, peaks, density.propagate(stats, peaks))


@dataclass(frozen=True)
class Model:
    options: DensityPeaks
    points: DataFrame
    edges: DataFrame
    stats: DataFrame
    peaks: DataFrame
    labels: DataFrame

    def centroids(self) -> DataFrame:
        """(code, vector, freq) of the clusters."""
        return quantize.centroids(self.points.select("id", F.col("value").alias("vector")), self.labels.select("id", F.col("label").alias("cluster")))

    def nearest_peak_portion(self) -> float:
        local = self.stats.where("is_peak").select("id")
        return density.nearest_peak_portion(self.edges, local, self.points, self.options.distance, self.options.p).agg(F.avg("portion")).first()[0]

    def evaluate(self, truth: DataFrame, which=("ari", "ri", "ci_part", "nmi")) -> dict[str, float]:
        return validity.evaluate(self.labels, truth, which)

    def collect(self) -> tuple[list[int], list[int]]:
        """Labels in id order and peak ids in label order, as lists."""
        return [r.label for r in self.labels.orderBy("id").collect()], [r.id for r in self.peaks.orderBy("label").collect()]


def cluster_vectors(df: DataFrame, num_clusters: int, num_neighbors: int = 10, window: int = 20, nndes_start: float = 0.0, maxiter: int = 100, endcond: float = 0.05, distance: str = "l2", id_col: str = "id", value_col: str = "value") -> Model:
    """Clusters vectors; ``window`` bounds the leaves of the division."""
    if distance not in ("l2", "l1", "cos"):
        raise ValueError("distance is l2, l1 or cos")
    leaf = max(20, window if window > 0 else 2 * num_neighbors)
    return DensityPeaks(num_clusters, num_neighbors, "rpdiv", distance, leaf_size=leaf, max_iter=maxiter, tol=endcond, nnd_start=nndes_start).fit(df, id_col, value_col)


def cluster_by(df: DataFrame, distance: Callable, num_clusters: int, num_neighbors: int = 10, window: int = 20, nndes_start: float = 0.1, maxiter: int = 100, endcond: float = 0.05, id_col: str = "id", value_col: str = "value") -> Model:
    """Clusters by a callable over two pandas Series of values, a batch of pairs at a time."""
    leaf = max(20, window if window > 0 else 2 * num_neighbors)
    return DensityPeaks(num_clusters, num_neighbors, "rpdiv", distance, leaf_size=leaf, max_iter=maxiter, tol=endcond, nnd_start=nndes_start).fit(df, id_col, value_col)


def _labels(spark: SparkSession, path: str) -> DataFrame:
    return lines.read_partition(spark, path)


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return binary.read_codebook(spark, path).select(F.col("idx").alias("id"), "vector", "freq")


def _codes(spark: SparkSession, path: str) -> DataFrame:
    return binary.read_codebook(spark, path).select((F.col("idx") + 1).alias("code"), "vector")


def evaluate_files(spark: SparkSession, files: list[str], index: str = "ci") -> float:
    """An index of two files (both partitions or both codebooks), or of a training set and two.

    With a training set, partitions are derived from codebooks by nearest code, and
    codebooks from partitions as centroids, as the index needs them.
    """
    kinds = [lines.file_type(spark, f) for f in files]
    centroid = index in ("ci", "ci_star")
    if len(files) not in (2, 3) or None in kinds or (len(files) == 3) != (kinds[0] == "TS"):
        raise ValueError("two files, or a training set and two files")
    data = _vectors(spark, files[0]) if len(files) == 3 else None
    pairs = list(zip(files, kinds))[-2:]
    if index not in (*validity.ALL, "ch", "ci", "ci_star"):
        raise ValueError(f"unknown index {index!r}")
    if data is None and (len({k for _, k in pairs}) > 1 or (pairs[0][1] == "PA") == centroid or index == "ci_star"):
        raise ValueError(f"{index} of {kinds} needs other files or a training set")

    def as_codes(path: str, kind: str) -> DataFrame:
        if kind == "CB":
            return _codes(spark, path)
        found = quantize.centroids(data, _labels(spark, path).select("id", F.col("label").alias("cluster")), whole=True)
        return found.select(F.col("code").cast("long").alias("code"), "vector")

    def as_labels(path: str, kind: str) -> DataFrame:
        if kind == "PA":
            return _labels(spark, path)
        return quantize.optimal_partition(data, _codes(spark, path)).select("id", F.col("cluster").alias("label"))

    if centroid:
        a, b = (as_codes(*x) for x in pairs)
        return (quantize.centroid_index(a, b) if index == "ci" else quantize.centroid_index_star(data, a, b)).first()[0]
    a, b = (as_labels(*x) for x in pairs)
    return validity.evaluate(a, b, [index])[index]
