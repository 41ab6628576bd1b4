"""k-nearest-neighbour graphs as edge tables (src, dst, dist, rank).

``brute`` is exact: dense vectors go through a grid of blocks with a numpy kernel
and keep k rows a cell, other types meet blocks of values as arrays.  ``rpdiv`` routes all points through trees of random pivot
pairs and compares within leaves; descent improves a graph by comparing neighbours
of neighbours.  Both are deterministic in their seed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distances
from ..plans.cut import cut, drop
from .blocks import dense, grid

EDGES = "src long, dst long, dist double"


def points(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """(id, value) of usable rows: neither may be null."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).alias("value")).where("id is not null and value is not null")


def _is_vector(df: DataFrame) -> bool:
    return df.schema["value"].dataType.simpleString() in {f"array<{t}>" for t in ("float", "double", "int", "bigint")}


def expression(distance: str | Callable, p: float | None = None) -> Callable[[Column, Column], Column]:
    """The column form of a named distance or of a pandas callable."""
    if callable(distance):
        return F.pandas_udf(distance, "double")
    return distances.get(distance, p)


def top_k(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each source; ties go to the smaller id."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Values that travel as one array where only the expression of a distance exists.
BOOK = 1024


def _by_expression(pts: DataFrame, k: int, d: Callable[[Column, Column], Column]) -> DataFrame:
    """Each point meets blocks of all points as arrays, and keeps k of each; no pair is a row."""
    books = max(1, -(-pts.count() // BOOK))
    block = F.pmod(F.xxhash64("id"), F.lit(books)).cast("int")
    shelf = pts.groupBy(block.alias("j")).agg(F.collect_list(F.struct("id", "value")).alias("book"))
    asked = pts.select(F.col("id").alias("src"), F.col("value").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(books - 1))).alias("j"))
    others = F.filter("book", lambda x: x["id"] != F.col("src"))
    found = F.slice(F.array_sort(F.transform(others, lambda x: F.struct(d(F.col("a"), x["value"]).alias("dist"), x["id"].alias("dst")))), 1, k)
    return asked.join(shelf, "j").select("src", F.explode(found).alias("e")).select("src", "e.dst", "e.dist")


def brute(df: DataFrame, k: int, distance: str | Callable = "l2", id_col: str = "id", value_col: str = "value", p: float | None = None) -> DataFrame:
    """The exact graph; equal distances go to the smaller id."""
    pts = points(df, id_col, value_col)
    kernel = None if callable(distance) or not _is_vector(pts) else distances.block_kernel(distance, p)
    if kernel is None and not callable(distance):
        return top_k(_by_expression(pts, k, expression(distance, p)), k)
    exact = None if callable(distance) else distances.pair_kernel(distance, p)

    def own(a: pd.DataFrame, b: pd.DataFrame):
        for src, value in zip(a.id, a.value):
            others = b[b.id != src]
            real = np.asarray(distance(pd.Series([value] * len(others)), others.value.reset_index(drop=True)), float) if len(others) else np.empty(0)
            yield src, others.id.to_numpy(), real

    def dense_rows(a: pd.DataFrame, b: pd.DataFrame):
        x, y, left, right = dense(a.value), dense(b.value), a.id.to_numpy(), b.id.to_numpy()
        if distance == "l2":  # smaller norms round less
            centre = y.mean(0)
        for at in range(0, len(x), 512):
            u, v = (x[at : at + 512] - centre, y - centre) if distance == "l2" else (x[at : at + 512], y)
            rough = kernel(u, v)
            rough[left[at : at + 512, None] == right[None]] = np.inf
            kth = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            # whatever rounding may hide is measured again, ties included
            least = distances.reach(distance, distances.reach(distance, kth, u, v), u, v)
            for i, row in enumerate(rough):
                some = np.flatnonzero((row <= least[i]) & np.isfinite(row))
                yield left[at + i], right[some], exact(x[at + i][None], y[some])

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        src, dst, dist = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        if len(a) and len(b):
            for i, ids, real in own(a, b) if callable(distance) else dense_rows(a, b):
                best = np.lexsort((ids, real))[:k]
                src.append(np.full(len(best), i))
                dst.append(ids[best])
                dist.append(real[best])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "dist": np.concatenate(dist)})

    n = pts.count()
    return top_k(grid(pts, pts, cell, EDGES, n, n), k)


def merge(graph: DataFrame | None, found: DataFrame, k: int) -> DataFrame:
    """Bounded insertion as a set: one row for each (src, dst), the k nearest of each source.

    Rows of ``graph`` keep ``is_new`` false; what ``found`` adds is new.
    """
    fresh = found.select("src", "dst", "dist", F.lit(True).alias("is_new"))
    every = fresh if graph is None else graph.select("src", "dst", "dist", F.lit(False).alias("is_new")).unionByName(fresh)
    return top_k(every.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("is_new").alias("is_new")), k)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both orientations."""
    return edges.select(F.explode(F.array(F.struct("src", "dst", "dist"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))).alias("e")).select("e.*")


def reverse(edges: DataFrame) -> DataFrame:
    """Who has a point among its neighbours."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def with_distance(pairs: DataFrame, pts: DataFrame, distance: str | Callable = "l2", p: float | None = None) -> DataFrame:
    """(src, dst) with the distance of their values."""
    d = expression(distance, p)
    return pairs.join(pts.toDF("src", "_a"), "src").join(pts.toDF("dst", "_b"), "dst").select("src", "dst", d(F.col("_a"), F.col("_b")).alias("dist"))


def recompute(edges: DataFrame, df: DataFrame, distance: str | Callable = "l2", id_col: str = "id", value_col: str = "value", p: float | None = None) -> DataFrame:
    """The same edges with distances measured anew."""
    ranks = edges.select("src", "dst", "rank")
    return with_distance(ranks, points(df, id_col, value_col), distance, p).join(ranks, ["src", "dst"])


def random_graph(pts: DataFrame, k: int, seed: int, distance, p: float | None = None) -> DataFrame:
    """k hashed draws a point, less itself and repeats."""
    shelves = max(64, pts.count() >> 17)  # of about 131,072 points at most
    shelf_of = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shelves))
    ids = pts.select("id", shelf_of.alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("id")))
    counts = cut(ids.groupBy("s").agg(F.max("r").alias("n")))
    most = counts.count()
    shelf = counts.withColumn("j", F.row_number().over(Window.orderBy("s")) - 1)  # a row for each shelf
    draw = pts.select("id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("t")).withColumn("j", F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.lit(max(1, most))))
    aimed = draw.join(F.broadcast(shelf), "j").select("id", "s", (F.pmod(F.xxhash64("t", "id", F.lit(seed + 1)), F.col("n")) + 1).cast("int").alias("r"))
    pairs = aimed.join(ids.select(F.col("id").alias("dst"), "s", "r"), ["s", "r"])
    pairs = pairs.select(F.col("id").alias("src"), "dst").where("src <> dst").distinct()
    return with_distance(pairs, pts, distance, p)


#: Points of a leaf of the tree of pivots, and the sample from which it is grown: four a leaf within these bounds.
GROUP = 20_000
LEAST_SAMPLE, MOST_SAMPLE = 20_000, 400_000
#: Divisions of one round.
TREES = 3
#: Points of a leaf where distances are a product of matrices, which is cheap for whole leaves.
LEAF = 1000
#: Points whose neighbours are searched among all, and the share of them that a settled graph must hold.
ASKED, SETTLED = 512, 0.93


def _values(column) -> np.ndarray:
    """Rows of a matrix for number arrays, objects otherwise."""
    column = list(column)
    if len(column) and isinstance(column[0], (np.ndarray, list)) and not isinstance(column[0][0] if len(column[0]) else "", str):
        return dense(column)
    out = np.empty(len(column), object)
    for i, x in enumerate(column):
        out[i] = tuple(x) if isinstance(x, (np.ndarray, list)) else x
    return out


def _split(x: np.ndarray, rng, kernel) -> tuple[np.ndarray, np.ndarray] | None:
    """Two different random pivots, and who is strictly nearer to the first."""
    order = rng.permutation(len(x))
    a = x[order[0]]
    other = next((i for i in order[1:] if not np.array_equal(x[i], a)), None)
    if other is None:
        return None
    pivots = x[[order[0], other]]
    d = kernel(x, pivots)
    near = d[:, 0] < d[:, 1]
    return (pivots, near) if near.any() and not near.all() else None


def _leaf_edges(ids: np.ndarray, x: np.ndarray, k: int, leaf: int, rng, kernel):
    """Edges within the leaves of a recursive division; parts that cannot be split are cut in runs."""
    stack = [(np.arange(len(ids)), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) >= leaf and depth <= 30:
            made = _split(x[part], rng, kernel)
            if made is not None:
                stack += [(part[made[1]], depth + 1), (part[~made[1]], depth + 1)]
                continue
        for at in range(0, len(part), max(2, leaf)):
            run = part[at : at + max(2, leaf)]
            d = kernel(x[run], x[run])
            np.fill_diagonal(d, np.inf)
            near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(run) - 1)]
            yield np.repeat(ids[run], near.shape[1]), ids[run][near].ravel(), np.take_along_axis(d, near, 1).ravel()


def divide(pts: DataFrame, k: int, leaf: int, seed: int, distance: str | Callable, p: float | None, n: int, trees: int = 1) -> DataFrame:
    """A round of divisions: edges among points that fall into one leaf of one of ``trees`` trees.

    A tree grown from a bounded sample deals the points into groups of about GROUP
    points, which are divided on to leaves in the task that holds the group.  Groups
    that are larger, because the sample was, or many points are equal, are cut by hash.
    """
    kernel = distances.values_kernel(distance, p)
    want = max(1, n // GROUP)
    sample = None
    if want > 1:
        size = min(max(LEAST_SAMPLE, 4 * want), MOST_SAMPLE)
        sample = _values([r.value for r in pts.orderBy(F.xxhash64("id", F.lit(seed))).limit(size).collect()])
    grown = []  # of each tree its nodes (pivots, left, right); children < 0 are groups
    for t in range(trees):
        tree: list[tuple] = []
        rng = np.random.default_rng([seed, t])
        if sample is not None:
            most, groups, todo = max(4, len(sample) // want), 0, [(np.arange(len(sample)), None, None)]
            while todo:
                part, parent, side = todo.pop()
                made = _split(sample[part], rng, kernel) if len(part) > most else None
                if made is None:
                    groups += 1
                    at = -groups
                else:
                    at = len(tree)
                    tree.append([made[0], None, None])
                    todo += [(part[made[1]], at, 1), (part[~made[1]], at, 2)]
                if parent is not None:
                    tree[parent][side] = at
        grown.append(tree)

    def route(batches):
        for b in batches:
            x = _values(b.value)
            for t, tree in enumerate(grown):
                at = np.zeros(len(b), int) if tree else np.full(len(b), -1)
                while (at >= 0).any():
                    for node in np.unique(at[at >= 0]):
                        rows = np.flatnonzero(at == node)
                        pivots, left, right = tree[node]
                        d = kernel(x[rows], pivots)
                        at[rows] = np.where(d[:, 0] < d[:, 1], left, right)
                yield pd.DataFrame({"tree": t, "leaf": -at.astype(np.int64), "id": b.id, "value": b.value})

    value = pts.schema["value"].dataType.simpleString()
    dealt = pts.mapInPandas(route, f"tree long, leaf long, id long, value {value}")
    cuts = F.lit(1)
    if want > 1:
        sizes = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (4 * GROUP)).alias("cuts")).where("cuts > 1")
        # groups of more than 4 * GROUP points: n / (4 * GROUP) rows a tree at most
        dealt = dealt.join(sizes, ["tree", "leaf"], "left")
        cuts = F.coalesce("cuts", F.lit(1))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), cuts))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        local = np.random.default_rng([seed, int(part.tree.iloc[0]), int(part.leaf.iloc[0])])
        found = list(_leaf_edges(part.id.to_numpy(), _values(part.value), k, leaf, local, kernel))
        return pd.DataFrame(dict(zip(("src", "dst", "dist"), map(np.concatenate, zip(*found)))))

    return dealt.select("tree", "leaf", "salt", "id", "value").groupBy("tree", "leaf", "salt").applyInPandas(compare, EDGES)


#: Hubs of a task in a descent round, numbers of their members' values (128 MB), and edges that it gathers before it keeps the nearest.
HUBS, HUB_NUMBERS, GATHERED = 2048, 1 << 24, 1 << 20


def _nearest_found(found: list, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different edges of each source; sources and targets are places below n."""
    src, dst, dist = (np.concatenate(x) for x in zip(*found))
    once = np.unique(src.astype(np.int64) * n + dst, return_index=True)[1]
    order = once[np.lexsort((dst[once], dist[once], src[once]))]
    src = src[order]
    starts = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
    rank = np.arange(len(src)) - np.repeat(starts, np.diff(np.append(starts, len(src))))
    return src[rank < k], dst[order][rank < k], dist[order][rank < k]


def join_neighbours(graph: DataFrame, pts: DataFrame, k: int, distance: str | Callable, p: float | None, n: int) -> DataFrame:
    """Edges that a descent round finds: points that meet at a hub, one of them new.

    At a hub meet its neighbours and the k nearest points that have it as a neighbour,
    so a hub holds 2 * k points at most.  Some thousand hubs share a task, to which each
    of their members is sent once, and which gives k edges of a source at most: those
    that are shorter than the longest one that the source has.
    """
    kernel = distances.values_kernel(distance, p)
    back = graph.select(F.col("dst").alias("hub"), F.col("src").alias("id"), "dist", "is_new")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("hub").orderBy("dist", "id"))).where(F.col("r") <= k)
    ways = graph.select(F.col("src").alias("hub"), F.col("dst").alias("id"), "is_new").unionByName(back.select("hub", "id", "is_new"))
    width = (pts.agg(F.max(F.size("value"))).first()[0] or 1) if _is_vector(pts) else 16
    tasks = -(-n // min(HUBS, max(1, HUB_NUMBERS // (2 * k * max(1, width)))))
    ways = ways.groupBy("hub", "id").agg(F.max("is_new").alias("is_new")).withColumn("task", F.pmod(F.xxhash64("hub"), F.lit(tasks)))
    reach = graph.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("reach"))
    members = ways.select("task", "id").distinct().join(pts.join(reach, "id", "left").select("id", "value", F.coalesce("reach", F.lit(float("inf"))).alias("reach")), "id")
    members = members.select(F.col("task").alias("at"), F.col("id").alias("point"), "value", "reach")

    def compare(met: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("point")
        ids, x, reach = known["point"].to_numpy(), _values(known["value"]), known["reach"].to_numpy()
        hub = met["hub"].to_numpy()
        order = np.lexsort((met["id"].to_numpy(), hub))
        hub, place, fresh = hub[order], np.searchsorted(ids, met["id"].to_numpy()[order]).astype(np.int32), met["is_new"].to_numpy(bool)[order]
        starts = np.flatnonzero(np.concatenate(([True], hub[1:] != hub[:-1])))
        found, held = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))], 0
        for s, e in zip(starts, np.append(starts[1:], len(hub))):
            new = fresh[s:e]
            if e - s < 2 or not new.any():
                continue
            at = place[s:e]
            d = np.asarray(kernel(x[at], x[at]), float)
            i, j = np.nonzero((new[:, None] | new[None]) & (d < reach[at][:, None]) & (at[:, None] != at[None]))
            found.append((at[i], at[j], d[i, j]))
            held += len(i)
            if held > max(GATHERED, len(found[0][0])):
                found = [_nearest_found(found, k, len(ids))]
                held = 0
        src, dst, dist = _nearest_found(found, k, len(ids)) if len(ids) else found[0]
        return pd.DataFrame({"src": ids[src], "dst": ids[dst], "dist": dist})

    return ways.groupBy("task").cogroup(members.groupBy("at")).applyInPandas(compare, EDGES)


def _sampled_reach(pts: DataFrame, k: int, distance: str | Callable, p: float | None, seed: int) -> list[tuple]:
    """(src, reach, wanted) of ASKED points: the distance within which their k nearest lie, and how many those are."""
    kernel = distances.values_kernel(distance, p)
    asked = pts.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(ASKED).collect()
    ids, x = np.array([r.id for r in asked]), _values([r.value for r in asked])

    def near(batches):
        for b in batches:
            if len(b):
                d = np.asarray(kernel(x, _values(b.value)), float)
                d[(ids[:, None] == b.id.to_numpy()[None]) | np.isnan(d)] = np.inf
                d = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                yield pd.DataFrame({"src": np.repeat(ids, d.shape[1]), "dist": d.ravel()})

    nearest = F.slice(F.array_sort(F.collect_list("dist")), 1, k)  # of k distances a batch
    found = pts.mapInPandas(near, "src long, dist double").where(F.col("dist") < float("inf")).groupBy("src").agg(nearest.alias("d"))
    rows = [(r.src, r.d[-1], len(r.d)) for r in found.collect()]  # ASKED at most
    slack = 1e-7 * max((r[1] for r in rows), default=0)  # kernels round differently in blocks of other sizes
    return [(src, d + 1e-6 * abs(d) + slack, wanted) for src, d, wanted in rows]


def _sampled_recall(graph: DataFrame, reach: list[tuple]) -> float:
    """The share of the asked points' nearest neighbours that a graph holds; equal distances are as good."""
    if not reach:
        return 1.0
    asked = graph.sparkSession.createDataFrame(reach, "src long, reach double, wanted long")
    hits = graph.join(F.broadcast(asked), "src").where("dist <= reach").groupBy("src", "wanted").agg(F.count("*").alias("c"))
    return (hits.agg(F.sum(F.least("c", "wanted"))).first()[0] or 0) / sum(r[2] for r in reach)


def _updates(graph: DataFrame, before: DataFrame | None) -> int:
    return graph.count() if before is None else graph.where("is_new").count()


def approximate(df: DataFrame, k: int, distance: str | Callable = "l2", id_col: str = "id", value_col: str = "value", p: float | None = None, leaf_size: int | None = None, max_iter: int = 100, tol: float = 0.01, nnd_start: float = 0.1, method: str = "rpdiv", seed: int = 1, width: int | None = None) -> DataFrame:
    """Rounds of division, joined by descent, until they settle.

    The graph is built with ``width`` neighbours, of which the k nearest are returned,
    measured once more.  A round of division compares the leaves of some trees.  From the
    second round on descent follows, and division ends once descent brings less than
    ``nnd_start`` of n * width new edges; ``nnd_start=0`` leaves descent out.  Method
    nndescent starts from a random graph and has no division.

    Rounds settle once fewer than ``tol`` edges are new.  Unless ``width`` is given it
    begins with 3 * k, and a graph that holds, or will hold once it settles, less than
    SETTLED of the nearest neighbours of some points, which are searched among all, goes
    on half as wide again: the larger a table of many dimensions, the more neighbours
    lead to the nearest ones.
    """
    whole = pts = cut(points(df, id_col, value_col))
    if pts.schema["value"].dataType.simpleString() == "array<double>":
        short = F.col("value").cast("array<float>")
        if pts.agg(F.bool_and(short.cast("array<double>").eqNullSafe(F.col("value")))).first()[0]:
            pts = pts.select("id", short.alias("value"))  # the same numbers in half the space
    n = max(1, pts.count())
    w = max(k, width or 3 * k)
    least = LEAF if distance in ("l2", "cos") and _is_vector(pts) else 20
    leaf_of = lambda w: max(20, leaf_size) if leaf_size else max(least, int(2.5 * w))
    dividing = method != "nndescent"
    widened, reach = False, None
    graph: DataFrame | None = None if dividing else cut(merge(None, random_graph(pts, w, seed, distance, p), w))
    for round_ in range(max_iter):
        moved = 0.0
        if dividing:
            found = divide(pts, w, leaf_of(w), seed + 7 * round_, distance, p, n, TREES)
            new = cut(merge(graph, found, w))
            moved += _updates(new, graph) / (n * w)
            drop(graph)
            graph = new
        if not dividing or (nnd_start > 0 and round_):
            # after it has got wider, any two neighbours may meet again
            known, widened = graph.withColumn("is_new", F.lit(True)) if widened else graph, False
            new = cut(merge(graph, join_neighbours(known, pts, w, distance, p, n), w))
            moved = _updates(new, graph) / (n * w)
            drop(graph)
            graph = new
            # trees bring little once neighbours of neighbours are known
            dividing = dividing and moved > nnd_start
        if width or w >= n - 1:
            if moved < tol:
                break
        elif moved < max(tol, 0 if round_ == 0 else nnd_start):
            reach = _sampled_reach(pts, k, distance, p, seed) if reach is None else reach
            held = _sampled_recall(graph, reach)
            if moved < tol and held >= SETTLED:
                break
            if held + (0 if moved < tol else moved) < SETTLED:
                w, widened, dividing = min(n - 1, w + w // 2 + 1), True, method != "nndescent"
    best = top_k(graph.select("src", "dst", "dist"), k)
    return top_k(with_distance(best.select("src", "dst"), whole, distance, p), k)


def build(df: DataFrame, k: int, method: str = "rpdiv", **options) -> DataFrame:
    """A graph by name: brutef, rpdiv or nndescent."""
    if method in ("brutef", "brute"):
        return brute(df, k, **{o: v for o, v in options.items() if o in ("distance", "id_col", "value_col", "p")})
    if method not in ("rpdiv", "nndescent"):
        raise ValueError(f"unknown method {method!r}")
    return approximate(df, k, method=method, **options)


def recall(graph: DataFrame, truth: DataFrame, k: int, compared: int | None = None) -> DataFrame:
    """recall, ratio of summed lengths, and pairs of both graphs' first k neighbours.

    With ``compared``, the number of distances that were taken, also the cost: its share
    of all pairs of points.
    """
    a, b = graph.where(F.col("rank") <= k), truth.where(F.col("rank") <= k)
    hits = b.join(a.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("hits"))
    totals = b.agg(F.count("*").alias("wanted"), F.sum("dist").alias("best"), F.countDistinct("src").alias("n")).crossJoin(a.agg(F.sum("dist").alias("length")))
    out = [(F.col("hits") / F.col("wanted")).alias("recall"), (F.col("length") / F.col("best")).alias("ratio"), F.col("wanted")]
    if compared is not None:
        out.append((F.lit(float(compared)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("cost"))
    return hits.crossJoin(totals).select(*out)


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.sum("dist").alias("sum_dist"), F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"))


def add_edges(edges: DataFrame, more: DataFrame, each_way: bool = False) -> DataFrame:
    """Adds edges that aren't there yet, in one or both directions."""
    columns = ["src", "dst", "dist"]
    more = both_ways(more.select(columns)) if each_way else more.select(columns)
    return edges.select(columns).unionByName(more.join(edges, ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"]))


def remove_edges(edges: DataFrame, gone: DataFrame, each_way: bool = False) -> DataFrame:
    pairs = gone.select("src", "dst")
    if each_way:
        pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(pairs, ["src", "dst"], "left_anti")


def graph_properties(edges: DataFrame, df: DataFrame, id_col: str = "id", value_col: str = "value") -> DataFrame:
    """k, points, dimensions, least and greatest coordinate."""
    pts = points(df, id_col, value_col)
    degree = edges.groupBy("src").agg(F.count("*").alias("c")).agg(F.max("c").alias("k"))
    shape = pts.agg(F.count("*").alias("n_points"), F.max(F.size("value")).alias("dim"), F.min(F.array_min("value")).cast("double").alias("min_coord"), F.max(F.array_max("value")).cast("double").alias("max_coord"))
    return degree.crossJoin(shape)
