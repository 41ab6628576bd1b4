"""Density peaks over a neighbour graph.

Density is the inverse mean neighbour distance.  Each point looks for its nearest
denser point among its neighbours; only the few points that have none there are
compared with all denser points.  The K points with the largest product of density
and that distance are peaks, and labels run down the pointers by doubling.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances
from ..plans.cut import cut
from . import knn
from .blocks import dense, grid

FLOOR = 1e-20
#: Points without a denser neighbour that may be broadcast for the full scan.
BROADCAST_PEAKS = 10_000


def density(edges: DataFrame, tie_break: str = "rank") -> DataFrame:
    """(id, density); mode additive adds 1e-10 * id, mode rank leaves ties to the id."""
    raw = 1 / F.greatest(F.avg("dist"), F.lit(FLOOR))
    found = edges.groupBy(F.col("src").alias("id")).agg(raw.alias("density"))
    if tie_break == "additive":
        return found.withColumn("density", F.col("density") + 1e-10 * F.col("id"))
    if tie_break != "rank":
        raise ValueError("tie_break is rank or additive")
    return found


def delta_from_graph(edges: DataFrame, dens: DataFrame) -> DataFrame:
    """(id, nhd, delta): the nearest denser neighbour of points that have one."""
    src = dens.select(F.col("id").alias("src"), F.struct("density", "id").alias("order_src"))
    dst = dens.select(F.col("id").alias("dst"), F.struct("density", "id").alias("order_dst"))
    denser = edges.join(src, "src").join(dst, "dst").where("order_dst > order_src")
    best = denser.groupBy(F.col("src").alias("id")).agg(F.min(F.struct("rank", "dst", "dist")).alias("b"))
    return best.select("id", F.col("b.dst").alias("nhd"), F.col("b.dist").alias("delta"))


def neighbourhood_peaks(dens: DataFrame, found: DataFrame) -> DataFrame:
    """Points without a denser neighbour."""
    return dens.join(found, "id", "left_anti")


def delta_by_scan(some: DataFrame, dens: DataFrame, pts: DataFrame, distance: str | Callable = "l2", p: float | None = None) -> DataFrame:
    """(id, nhd, delta) of ``some`` points against all denser ones; the densest has none."""
    valued = dens.join(pts, "id")
    ours = some.select("id").join(valued, "id", "inner")
    kernel = None if callable(distance) or not knn._is_vector(pts) else distances.block_kernel(distance, p)
    if kernel is not None:
        exact = distances.pair_kernel(distance, p)

        def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(a) and len(b):
                x, y = dense(a.value), dense(b.value)
                rough = kernel(x, y)
                da, db = a.density.to_numpy(), b.density.to_numpy()
                ia, ib = a.id.to_numpy(), b.id.to_numpy()
                denser = (db[None] > da[:, None]) | ((db[None] == da[:, None]) & (ib[None] > ia[:, None]))
                rough[~denser] = np.inf
                once = distances.reach(distance, rough.min(1), x, y)
                reach = distances.reach(distance, once, x, y)
                for i, row in enumerate(rough):
                    least = row.min()
                    if np.isfinite(least):
                        near = np.flatnonzero(row <= reach[i])
                        real = exact(x[i][None], y[near])
                        j = np.lexsort((ib[near], real))[0]
                        found.append((ia[i], ib[near][j], real[j]))
            return pd.DataFrame(found, columns=["id", "nhd", "delta"])

        cells = grid(ours, valued, cell, "id long, nhd long, delta double", some.count(), dens.count())
    else:
        d = knn.expression(distance, p)
        left = ours.select(F.col("id").alias("i"), F.col("density").alias("di"), F.col("value").alias("vi"))
        if some.count() <= BROADCAST_PEAKS:
            left = F.broadcast(left)
        right = valued.select(F.col("id").alias("j"), F.col("density").alias("dj"), F.col("value").alias("vj"))
        pairs = right.join(left, (F.col("dj") > F.col("di")) | ((F.col("dj") == F.col("di")) & (F.col("j") > F.col("i"))))
        cells = pairs.select(F.col("i").alias("id"), F.col("j").alias("nhd"), d(F.col("vi"), F.col("vj")).alias("delta"))
    best = cells.groupBy("id").agg(F.min(F.struct("delta", "nhd")).alias("b"))
    return best.select("id", F.col("b.nhd").alias("nhd"), F.col("b.delta").alias("delta"))


def statistics(edges: DataFrame, pts: DataFrame, distance: str | Callable = "l2", p: float | None = None, exact: bool = False, tie_break: str = "rank", keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(id, density, delta, nhd, gamma, is_peak): is_peak marks points that the scan resolved."""
    edges = keep(edges)
    dens = keep(density(edges, tie_break))
    if exact:
        near = dens.sparkSession.createDataFrame([], "id long, nhd long, delta double")
        local = dens
    else:
        near = keep(delta_from_graph(edges, dens))
        local = keep(neighbourhood_peaks(dens, near))
    scanned = delta_by_scan(local, dens, pts, distance, p)
    found = keep(near.unionByName(scanned))
    most = found.agg(F.max("delta").alias("most"))
    stats = dens.join(found, "id", "left").join(local.select("id", F.lit(True).alias("is_peak")), "id", "left").crossJoin(F.broadcast(most))
    delta = F.coalesce("delta", "most", F.lit(0.0))
    return stats.select("id", "density", delta.alias("delta"), "nhd", (F.col("density") * delta).alias("gamma"), F.coalesce("is_peak", F.lit(False)).alias("is_peak"))


def select_peaks(stats: DataFrame, n_clusters: int) -> DataFrame:
    """(id, label): the densest point is always among the n_clusters peaks."""
    top = stats.orderBy(F.col("gamma").desc(), F.col("nhd").isNull().desc(), "id").limit(n_clusters)
    rows = top.select("id", "gamma", F.col("nhd").isNull().alias("root")).collect()  # n_clusters rows
    if len(rows) < n_clusters:
        raise ValueError(f"{n_clusters} clusters of {len(rows)} points")
    ranked = [(r.id, i) for i, r in enumerate(sorted(rows, key=lambda r: (-r.gamma, not r.root, r.id)), 1)]
    return stats.sparkSession.createDataFrame(ranked, "id long, label int")


def propagate(stats: DataFrame, peaks: DataFrame) -> DataFrame:
    """(id, label): pointers are doubled until each one rests at a peak.

    A point that has come to a peak leaves the next rounds, so that points never
    gather under the few peaks' keys.
    """
    own = stats.select("id", "nhd").join(F.broadcast(peaks.select("id", "label")), "id", "left")  # n_clusters rows
    rests = F.col("label").isNotNull() | F.col("nhd").isNull()
    at = cut(own.select("id", F.when(rests, F.col("id")).otherwise(F.col("nhd")).alias("to"), "label", rests.alias("rests")))
    while not at.where("not rests").isEmpty():
        onward = at.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("label").alias("found"), F.col("rests").alias("there"))
        moved = at.where("not rests").select("id", "to").join(onward, "to").select("id", F.col("further").alias("to"), F.col("found").alias("label"), F.col("there").alias("rests"))
        at = cut(at.where("rests").unionByName(moved))
    return at.select("id", "label")


def nearest_peak_portion(edges: DataFrame, peaks: DataFrame, pts: DataFrame, distance: str | Callable = "l2", p: float | None = None) -> DataFrame:
    """Of each peak's neighbours, the share that no other peak is strictly nearer to; (id, portion)."""
    d = knn.expression(distance, p)
    near = edges.join(peaks.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "dist")
    others = peaks.select("id").join(pts, "id").select(F.col("id").alias("other"), F.col("value").alias("vo"))
    if peaks.count() <= BROADCAST_PEAKS:
        others = F.broadcast(others)
    valued = near.join(pts.select(F.col("id").alias("dst"), F.col("value").alias("vd")), "dst")
    # a neighbour that is a peak itself is nearest to itself
    beaten = valued.join(others, (F.col("other") != F.col("src")) & (d(F.col("vo"), F.col("vd")) < F.col("dist")))
    lost = beaten.select("src", "dst").distinct().withColumn("lost", F.lit(1))
    return near.join(lost, ["src", "dst"], "left").groupBy(F.col("src").alias("id")).agg((1 - F.count("lost") / F.count("*")).alias("portion"))
