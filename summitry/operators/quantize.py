"""Codebooks and partitions: nearest code vectors, centroids, errors, edits.

A codebook is (code, vector), a training set (id, vector[, freq]), a partition
(id, cluster).  Codes travel in arrays of bounded size, so that assignment is a
projection; codebooks of a bounded size are broadcast, larger ones are joined.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distances
from ..plans.cut import cut
from . import knn
from .blocks import dense, grid

#: Codes that travel together as one array.
BOOK = 1024
#: Numbers in a codebook that may be broadcast: 64 MB.
BROADCAST_NUMBERS = 8 << 20


def nearest_code(data: DataFrame, codebook: DataFrame, distance: str = "l2sq") -> DataFrame:
    """(id, code, error): the nearest code vector by any distance, ties to the smaller code, null distances last.

    Of equal code vectors only the smallest code can be the nearest, so each different
    vector is measured once.  The least of each array of codes is taken in a projection,
    and the least of those is combined map-side.
    """
    d = distances.get(distance)
    codebook = codebook.groupBy("vector").agg(F.min("code").alias("code"))
    shape = codebook.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")).first()
    books = max(1, -(-shape["n"] // BOOK))
    shelf = codebook.groupBy(F.pmod(F.xxhash64("code"), F.lit(books)).alias("j")).agg(F.collect_list(F.struct("code", F.col("vector").alias("v"))).alias("book"))
    errors = F.transform("book", lambda c: F.struct(d(F.col("vector"), c["v"]).alias("error"), c["code"].alias("code")))
    best = F.array_min(F.transform(errors, lambda e: F.struct(e["error"].isNull().alias("none"), e["error"].alias("error"), e["code"].alias("code"))))
    if shape["numbers"] <= BROADCAST_NUMBERS:
        met = data.select("id", "vector").crossJoin(F.broadcast(shelf))  # ``books`` rows for each one
    else:
        met = data.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(books - 1))).alias("j")).join(shelf, "j")
    found = met.select("id", best.alias("b")).groupBy("id").agg(F.min("b").alias("b"))
    return found.select("id", "b.code", "b.error")


def _members(data: DataFrame, partition: DataFrame) -> DataFrame:
    data = data if "freq" in data.columns else data.withColumn("freq", F.lit(1))
    return data.join(partition, "id")


def cluster_dimensions(data: DataFrame, partition: DataFrame) -> DataFrame:
    """(cluster, dim, value, freq): weighted component means; sums are combined map-side."""
    parts = _members(data, partition).select("cluster", "freq", F.posexplode("vector").alias("dim", "x"))
    return parts.groupBy("cluster", "dim").agg((F.sum(F.col("x").cast("double") * F.col("freq")) / F.sum("freq")).alias("value"), F.sum("freq").alias("freq"))


def centroids(data: DataFrame, partition: DataFrame, n_clusters: int | None = None, whole: bool = False) -> DataFrame:
    """(code, vector, freq) for every cluster; numbered clusters without members have freq 0."""
    value = F.floor(F.col("value") + 0.5) if whole else F.col("value")
    entries = F.array_sort(F.collect_list(F.struct("dim", value.alias("value"))))
    found = cluster_dimensions(data, partition).groupBy(F.col("cluster").alias("code")).agg(F.transform(entries, lambda e: e["value"]).alias("vector"), F.max("freq").alias("freq"))
    if n_clusters is None:
        return found
    every = data.sparkSession.range(1, n_clusters + 1).select(F.col("id").cast(found.schema["code"].dataType).alias("code"))
    return every.join(found, "code", "left").select("code", "vector", F.coalesce("freq", F.lit(0)).alias("freq"))


def global_centroid(data: DataFrame) -> DataFrame:
    """(dim, value) over all vectors."""
    return cluster_dimensions(data, data.select("id", F.lit(0).alias("cluster"))).select("dim", "value")


def optimal_partition(data: DataFrame, codebook: DataFrame, distance: str = "l2sq") -> DataFrame:
    """(id, cluster, error)."""
    return nearest_code(data, codebook, distance).withColumnRenamed("code", "cluster")


def point_errors(data: DataFrame, partition: DataFrame, codebook: DataFrame, distance: str = "l2sq") -> DataFrame:
    """(id, cluster, freq, error): distance to the own cluster's code vector."""
    d = distances.get(distance)
    book = codebook.select(F.col("code").alias("cluster"), F.col("vector").alias("code_vector"))
    return _members(data, partition).join(book, "cluster").select("id", "cluster", "freq", d(F.col("vector"), F.col("code_vector")).alias("error"))


def cluster_errors(errors: DataFrame) -> DataFrame:
    """(cluster, members, freq, error, mean_error)."""
    return errors.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("freq").alias("freq"), F.sum(F.col("error") * F.col("freq")).alias("error"), (F.sum(F.col("error") * F.col("freq")) / F.sum("freq")).alias("mean_error"))


def worst_points(errors: DataFrame) -> DataFrame:
    """(cluster, id, error): the member with the largest error."""
    best = errors.groupBy("cluster").agg(F.max(F.struct("error", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("cluster", (-F.col("b.i")).alias("id"), F.col("b.error").alias("error"))


def average_error(errors: DataFrame, size: int) -> DataFrame:
    """Mean error of a component over all members."""
    return errors.agg((F.sum(F.col("error") * F.col("freq")) / (F.sum("freq") * size)).alias("average_error"))


def log2_factorial(n: Column) -> Column:
    """log2 n! by Stirling's series of n + 8, less the factors in between."""
    x = n.cast("double") + 8
    series = x * F.log(x) - x + 0.5 * F.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    for i in range(8):
        series = series - F.log(x - i)
    return series / np.log(2.0)


def stochastic_complexity(data: DataFrame, partition: DataFrame, n_clusters: int | None = None) -> DataFrame:
    """Code length in bits of 0/1 vectors given their clusters, per vector.

    Of T vectors in K clusters: the bits that name a partition with the clusters'
    sizes, log2 of T! / prod(size!), and the sizes themselves, log2 of
    (T + K - 1)! / ((T - 1)! (K - 1)!); for each cluster and component with o ones and
    z zeros, log2 of (o + z + 1)! / (o! z!).  K counts the clusters of the partition
    unless given.
    """
    parts = _members(data, partition).select("cluster", "freq", F.posexplode("vector").alias("dim", "x"))
    dims = parts.groupBy("cluster", "dim").agg(F.sum("freq").alias("freq"), F.sum(F.when(F.col("x") > 0, F.col("freq")).otherwise(0)).alias("ones"))
    lg = log2_factorial
    bits = lg(F.col("freq") + 1) - lg(F.col("ones")) - lg(F.col("freq") - F.col("ones"))
    per = dims.groupBy("cluster").agg(F.max("freq").alias("freq"), F.sum(bits).alias("bits"))
    total = per.agg(F.sum("freq").alias("t"), F.lit(n_clusters).cast("long").alias("given") if n_clusters else F.count("*").alias("given"), F.sum("bits").alias("bits"), F.sum(lg(F.col("freq"))).alias("sizes"))
    t, k = F.col("t"), F.col("given")
    return total.select(((lg(t) - F.col("sizes") + lg(t + k - 1) - lg(t - 1) - lg(k - 1) + F.col("bits")) / t).alias("complexity"))


def duplicates(data: DataFrame) -> DataFrame:
    """How many vectors equal an earlier one."""
    return data.groupBy("vector").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


def unroll(data: DataFrame) -> DataFrame:
    """Each vector as often as its frequency says."""
    return data.where("freq > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("freq").cast("int")))).drop("freq")


def subspace(data: DataFrame, partition: DataFrame, cluster) -> DataFrame:
    return data.join(partition.where(F.col("cluster") == cluster).select("id"), "id", "left_semi")


def total_freq(data: DataFrame) -> DataFrame:
    return data.agg(F.sum("freq").alias("total_freq"))


def merge_codebooks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The codes of b follow those of a."""
    last = a.agg(F.coalesce(F.max("code"), F.lit(0)).alias("last"))
    return a.select("code", "vector").unionByName(b.crossJoin(F.broadcast(last)).select((F.col("code") + F.col("last")).alias("code"), "vector"))


def remove_code(codebook: DataFrame, code: int) -> DataFrame:
    """Takes a code out; the last one gets its number."""
    last = codebook.agg(F.max("code").alias("last"))
    kept = codebook.where(F.col("code") != code).crossJoin(F.broadcast(last))
    return kept.withColumn("code", F.when(F.col("code") == F.col("last"), F.lit(code)).otherwise(F.col("code"))).drop("last")


def join_clusters(partition: DataFrame, into: int, gone: int) -> DataFrame:
    """Members of ``gone`` go to ``into``; the last cluster takes the number that is free."""
    last = partition.agg(F.max("cluster").alias("last"))
    moved = F.when(F.col("cluster") == gone, F.lit(into)).otherwise(F.col("cluster"))
    named = partition.crossJoin(F.broadcast(last)).withColumn("cluster", moved)
    return named.withColumn("cluster", F.when((F.col("cluster") == F.col("last")) & (F.col("last") != gone), F.lit(gone)).otherwise(F.col("cluster"))).drop("last")


def move_points(partition: DataFrame, moves: DataFrame) -> DataFrame:
    """Gives the points of ``moves`` (id, cluster) their new cluster."""
    return partition.join(moves.select("id", F.col("cluster").alias("to")), "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))


def all_in_first(data: DataFrame) -> DataFrame:
    return data.select("id", F.lit(1).alias("cluster"))


def all_in_own(data: DataFrame) -> DataFrame:
    return data.select("id", F.col("id").alias("cluster"))


def repartition_cluster(data: DataFrame, partition: DataFrame, codebook: DataFrame, cluster, distance: str = "l2sq") -> DataFrame:
    """Reassigns the members of one cluster to their nearest codes."""
    return move_points(partition, optimal_partition(subspace(data, partition, cluster), codebook, distance))


def repartition_for_new(data: DataFrame, partition: DataFrame, codebook: DataFrame, new_codes: list, distance: str = "l2sq") -> DataFrame:
    """Moves points for which one of the new codes is strictly nearer than their own."""
    own = point_errors(data, partition, codebook, distance).select("id", F.col("error").alias("own"))
    found = optimal_partition(data, codebook.where(F.col("code").isin(new_codes)), distance)
    return move_points(partition, found.join(own, "id").where("error < own"))


def empty_clusters(partition: DataFrame, n_clusters: int) -> DataFrame:
    return partition.sparkSession.range(1, n_clusters + 1).select(F.col("id").alias("cluster")).join(partition.select("cluster").distinct(), "cluster", "left_anti")


def fill_empty(data: DataFrame, partition: DataFrame, codebook: DataFrame, n_clusters: int) -> DataFrame:
    """Points of the largest errors become the only members of the empty clusters."""
    empty = [r.cluster for r in empty_clusters(partition, n_clusters).orderBy("cluster").collect()]  # n_clusters at most
    if not empty:
        return partition
    worst = point_errors(data, partition, codebook).orderBy(F.col("error").desc(), "id").limit(len(empty)).collect()
    moves = [(r.id, c) for r, c in zip(worst, empty)]
    return move_points(partition, partition.sparkSession.createDataFrame(moves, "id long, cluster int"))


def fill_empty_random(data: DataFrame, partition: DataFrame, codebook: DataFrame, n_clusters: int, seed: int = 1) -> DataFrame:
    """The codebook with a random vector for each empty cluster, all different and in no other code."""
    empty = [r.cluster for r in empty_clusters(partition, n_clusters).orderBy("cluster").collect()]  # n_clusters at most
    kept = codebook.join(partition.select(F.col("cluster").alias("code")).distinct(), "code", "left_semi").select("code", "vector")
    fresh = data.join(kept.select("vector"), "vector", "left_anti").groupBy("vector").agg(F.min("id").alias("id"))
    drawn = fresh.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(len(empty)).collect()
    kind = data.schema["vector"].dataType.simpleString()
    rows = [(c, r.vector) for c, r in zip(empty, drawn)]
    return kept.unionByName(partition.sparkSession.createDataFrame(rows, f"code {kept.schema['code'].dataType.simpleString()}, vector {kind}"))


def cluster_statistics(data: DataFrame, partition: DataFrame) -> DataFrame:
    """(cluster, uniques, freq, sums): different vectors, members and component sums of each cluster."""
    uniques = _members(data, partition).groupBy("cluster", "vector").agg(F.sum("freq").alias("freq")).groupBy("cluster").agg(F.count("*").alias("uniques"), F.sum("freq").alias("freq"))
    dims = cluster_dimensions(data, partition)
    sums = dims.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", (F.col("value") * F.col("freq")).alias("s")))).alias("e"))
    return uniques.join(sums.select("cluster", F.transform("e", lambda x: x["s"]).alias("sums")), "cluster")


def sort_codebook(codebook: DataFrame, mode: str) -> DataFrame:
    """(place, code, vector, freq) by data or frequency, rising or falling, or by the vectors' means."""
    mean = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("vector")
    orders = {"data_ascending": F.col("vector").asc(), "data_descending": F.col("vector").desc(), "freq_ascending": F.col("freq").asc(), "freq_descending": F.col("freq").desc(), "vector_mean": mean.asc()}
    if mode not in orders:
        raise ValueError(f"mode is one of {', '.join(orders)}")
    # codebooks are small beside the data they stand for, so one sorted run numbers them
    return codebook.withColumn("place", F.row_number().over(Window.orderBy(orders[mode], "code"))).select("place", "code", "vector", "freq")


#: Numbers in a block of a cluster's members (16 MB), and distances that a task holds at a time.
BLOCK_NUMBERS = 1 << 21
#: Pairs that are measured again at a time.
PAIRS = 1 << 14


def _nearest_rows(x: np.ndarray, y: np.ndarray, own: np.ndarray, other: np.ndarray, distance: str):
    """(row of x, row of y, order, distance) of the nearest row of y with another number, ties to the first.

    Order is 0 for numbers, 1 for NaN and 2 for null, which come in this order.
    """
    kernel = distances.block_kernel(distance)
    exact = distances.ordered_kernel(distance) if kernel else None
    kernel = kernel or distances.values_kernel(distance)
    u, v, odd_x, odd_y = x, y, np.zeros(len(x), bool), np.zeros(len(y), bool)
    if exact:
        odd_x, odd_y = ~np.isfinite(x).all(1), ~np.isfinite(y).all(1)
        u, v = np.where(odd_x[:, None], 0, x), np.where(odd_y[:, None], 0, y)
        if distance == "l2":  # smaller norms round less
            centre = v.mean(0)
            u, v = u - centre, v - centre
    step = max(1, BLOCK_NUMBERS // len(y))
    for at in range(0, len(x), step):
        some = slice(at, at + step)
        same = own[some, None] == other[None]
        rough = np.asarray(kernel(u[some], v), float)
        least = np.where(same | odd_y, np.inf, rough)
        least = np.fmin.reduce(least, axis=1)
        # rows that aren't finite are inf or NaN away, and matter where nothing nearer is
        far = ~np.isfinite(least) | odd_x[some]
        if exact:  # whatever rounding may hide is measured again, ties included
            least = distances.reach(distance, distances.reach(distance, least, u[some], v), u[some], v)
        i, j = np.nonzero((~(rough > least[:, None]) & ~odd_y | far[:, None]) & ~same)
        if exact:
            real = np.concatenate([np.empty(0), *(exact(x[i[p : p + PAIRS] + at], y[j[p : p + PAIRS]]) for p in range(0, len(i), PAIRS))])
        else:
            real = rough[i, j]
        order = np.isnan(real).astype(int)
        if distance == "cos":  # of a zero vector
            order[(order > 0) & ~(odd_x[i + at] | odd_y[j])] = 2
        first = np.lexsort((j, np.where(order > 0, 0, real), order, i))
        first = first[np.unique(i[first], return_index=True)[1]]
        yield i[first] + at, j[first], order[first], real[first]


def nearest_in_cluster(data: DataFrame, partition: DataFrame, ids: DataFrame, distance: str = "l2") -> DataFrame:
    """(id, nearest, dist): of each wanted point, the nearest other member of its cluster, ties to the smaller id.

    Points meet in cells, which hold some whole clusters or two blocks of a large one.  A
    cell gives one row for each point that asks, and no pair is a row.  Null distances come
    last; vectors with null components, or of another size, are at a null distance.
    """
    distances.get(distance)
    schema = data.schema
    whole = schema["vector"].dataType.simpleString() in {f"array<{t}>" for t in ("float", "double", "int", "bigint")}
    if whole:  # numbers that are floats travel as such
        vector = F.when(F.forall("vector", lambda x: x.isNotNull()), F.col("vector").cast("array<double>"))
        short = vector.cast("array<float>")
        is_short = short.cast("array<double>").eqNullSafe(vector)
        values = data.select("id", F.when(is_short, short).alias("short"), F.when(~is_short, vector).alias("vector"))
        shape = data.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    else:
        values = data.select("id", F.lit(None).cast("boolean").alias("short"), "vector")
        shape = data.agg(F.count("*").alias("n"), F.lit(64).alias("width")).first()
    rows = max(1, BLOCK_NUMBERS // max(1, shape["width"] or 1))
    asking = ids.select("id").distinct().withColumn("asks", F.lit(True))
    members = values.join(partition.select("id", "cluster").where("cluster is not null"), "id").join(asking, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    blocks = lambda n: F.ceil(n / rows).cast("int")
    large = members.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("asks").alias("w")).where(F.col("n") > rows)
    large = large.select("cluster", F.col("cluster").alias("own"), blocks(F.col("w")).alias("across"), blocks(F.col("n")).alias("down"))
    # clusters of more than a block: n / rows rows at most
    met = members.join(F.broadcast(large), "cluster", "left").where("across is null or across > 0")
    across, down = F.coalesce("across", F.lit(1)), F.coalesce("down", F.lit(1))
    i, j = F.pmod(F.xxhash64("id"), F.greatest(across, F.lit(1))).cast("int"), F.pmod(F.xxhash64("id"), down).cast("int")
    offers = F.transform(F.sequence(F.lit(0), F.greatest(across, F.lit(1)) - 1), lambda c: F.struct(c.alias("i"), j.alias("j"), (F.col("asks") & (c == i)).alias("asks"), F.lit(True).alias("offers")))
    other = F.filter(F.sequence(F.lit(0), down - 1), lambda c: F.col("asks") & (c != j))
    asked = F.transform(other, lambda c: F.struct(i.alias("i"), c.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("offers")))
    bucket = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("cluster"), F.lit(max(64, -(-shape["n"] // rows)))))
    placed = met.select("id", "cluster", "own", bucket.alias("bucket"), "short", "vector", F.explode(F.concat(offers, asked)).alias("c")).select("id", "cluster", "own", "bucket", "short", "vector", "c.*")

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        number, group = pd.factorize(part["id"], sort=True)[0], pd.factorize(part["cluster"])[0]
        value = np.empty(len(part), object)
        for k, (s, v) in enumerate(zip(part["short"], part["vector"])):
            value[k] = v if s is None else s
        size = np.array([-1 if v is None else len(v) if whole else 0 for v in value])
        asks, has = part["asks"].to_numpy(bool), part["offers"].to_numpy(bool)
        point, nearest, order, dist = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        by = np.lexsort((number, group))
        for at in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
            a, b = at[asks[at]], at[has[at]]
            if not len(a) or not len(b):
                continue
            rest = b[number[b] != number[b[0]]]
            found, kind, real = np.where(number[a] != number[b[0]], b[0], rest[0] if len(rest) else -1), np.full(len(a), 2), np.full(len(a), np.nan)
            for s in np.unique(size[a]):
                left, right = np.flatnonzero(size[a] == s), b[size[b] == s]
                if s < 0 or not len(right):
                    continue
                x, y = (dense(value[p]) if whole else knn._values(value[p]) for p in (a[left], right))
                for k, l, o, d in _nearest_rows(x, y, number[a[left]], number[right], distance):
                    real[left[k]], kind[left[k]] = d, o
                    found[left[k][o < 2]] = right[l[o < 2]]
            ok = found >= 0
            for out, some in zip((point, nearest, order, dist), (a, found, kind, real)):
                out.append(some[ok])
        name, point, nearest = part["id"].to_numpy(), np.concatenate(point), np.concatenate(nearest)
        return pd.DataFrame({"id": name[point], "kind": np.concatenate(order), "dist": np.concatenate(dist), "nearest": name[nearest]})

    name = schema["id"].dataType.simpleString()
    found = placed.groupBy("own", "bucket", "i", "j").applyInPandas(cell, f"id {name}, kind int, dist double, nearest {name}")
    best = found.groupBy("id").agg(F.min(F.struct("kind", "dist", "nearest")).alias("b"))
    dist = F.when(F.col("b.kind") == 0, F.col("b.dist")).when(F.col("b.kind") == 1, F.lit(float("nan")))
    return best.select("id", F.col("b.nearest").alias("nearest"), dist.alias("dist"))


def single_link(data: DataFrame, partition: DataFrame) -> DataFrame:
    """(c1, c2, dist, id1, id2): the nearest pair of points of every two clusters."""
    members = data.join(partition, "id").select("id", "cluster", "vector")

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for c1, p in a.groupby("cluster"):
            for c2, q in b[b.cluster > c1].groupby("cluster"):
                x, y, i, j = dense(p.vector), dense(q.vector), p.id.to_numpy(), q.id.to_numpy()
                rough = distances.block_kernel("l2")(x, y)
                once = distances.reach("l2", rough.min(1), x, y)
                near = np.argwhere(rough <= distances.reach("l2", np.full(len(x), once.min()), x, y)[:, None])
                real = np.sqrt(((x[near[:, 0]] - y[near[:, 1]]) ** 2).sum(1))
                k = np.lexsort((j[near[:, 1]], i[near[:, 0]], real))[0]
                rows.append((c1, c2, real[k], i[near[k, 0]], j[near[k, 1]]))
        return pd.DataFrame(rows, columns=["c1", "c2", "dist", "id1", "id2"])

    n, kind = members.count(), members.schema["cluster"].dataType.simpleString()
    found = grid(members, members, cell, f"c1 {kind}, c2 {kind}, dist double, id1 long, id2 long", n, n)
    best = found.groupBy("c1", "c2").agg(F.min(F.struct("dist", "id1", "id2")).alias("b"))
    return best.select("c1", "c2", "b.dist", "b.id1", "b.id2")


def gabriel_neighbours(codebook: DataFrame) -> DataFrame:
    """(c1, c2): codes whose midpoint has no nearer code than the two."""
    a, b = codebook.toDF(*[f"{c}1" for c in codebook.columns]), codebook.toDF(*[f"{c}2" for c in codebook.columns])
    pairs = a.join(b, F.col("code1") < F.col("code2")).select("code1", "code2", F.zip_with("vector1", "vector2", lambda x, y: (x + y) / 2).alias("vector"))
    mids = cut(pairs.withColumn("id", F.monotonically_increasing_id()))
    near = nearest_code(mids, codebook)
    return mids.join(near, "id").where((F.col("code") == F.col("code1")) | (F.col("code") == F.col("code2"))).select(F.col("code1").alias("c1"), F.col("code2").alias("c2"))


def orphans(a: DataFrame, b: DataFrame) -> DataFrame:
    """Codes of b that are nearest to no code of a."""
    mapped = nearest_code(a.select(F.col("code").alias("id"), "vector"), b)
    return b.join(mapped.select("code").distinct(), "code", "left_anti")


def centroid_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger number of orphans of the two directions."""
    one = orphans(a, b).agg(F.count("*").alias("x"))
    return one.crossJoin(orphans(b, a).agg(F.count("*").alias("y"))).select(F.greatest("x", "y").alias("ci"))


def _overlap(cells: DataFrame, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Points that mapped clusters share, each target counted once with its largest overlap."""
    m = mapping.select(F.col("id").alias(source), F.col("code").alias(target))
    return cells.join(m, [source, target], "right").groupBy(target).agg(F.max(F.coalesce("n", F.lit(0))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"))


def centroid_index_star(data: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of points in the overlaps of clusters that are paired by nearest code vectors."""
    pa = optimal_partition(data, a).select("id", F.col("cluster").alias("l1"))
    pb = optimal_partition(data, b).select("id", F.col("cluster").alias("l2"))
    cells = pa.join(pb, "id").groupBy("l1", "l2").agg(F.count("*").alias("n"))
    as_data = lambda book: book.select(F.col("code").alias("id"), "vector")
    s12 = _overlap(cells, nearest_code(as_data(a), b), "l1", "l2").withColumnRenamed("s", "s12")
    s21 = _overlap(cells, nearest_code(as_data(b), a), "l2", "l1").withColumnRenamed("s", "s21")
    total = cells.agg(F.sum("n").alias("t"))
    return s12.crossJoin(s21).crossJoin(total).select(((F.col("s12") + F.col("s21")) / 2 / F.col("t")).alias("ci_star"))


def codebook_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Summed absolute differences of a's codes to their nearest in b, and exact matches."""
    near = nearest_code(a.select(F.col("code").alias("id"), "vector"), b)
    paired = near.join(a.select(F.col("code").alias("id"), "vector"), "id").join(b.select("code", F.col("vector").alias("other")), "code")
    gap = distances.l1(F.col("vector"), F.col("other"))
    return paired.select(gap.alias("g")).agg(F.sum("g").alias("gap"), F.count(F.when(F.col("g") == 0, 1)).alias("matches"))


def matched_sizes(cells: DataFrame) -> DataFrame:
    """(l1, l2, size1, size2): every first cluster with its largest overlap; null sides are unmatched."""
    s1 = cells.groupBy("l1").agg(F.sum("n").alias("size1"))
    s2 = cells.groupBy("l2").agg(F.sum("n").alias("size2"))
    best = cells.groupBy("l1").agg(F.max_by("l2", F.struct("n", F.col("l2"))).alias("l2"))
    return best.join(s1, "l1").join(s2, "l2", "full").select("l1", "l2", "size1", "size2")


def dimension_stats(data: DataFrame) -> DataFrame:
    """(dim, mean, least, most, n_unique) of every dimension."""
    parts = data.select(F.posexplode("vector").alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
    return parts.groupBy("dim").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.countDistinct("x").alias("n_unique"))


#: Equal parts of a dimension's range that are counted before any sort.
BINS = 1024


def dimension_nth(data: DataFrame, n: int) -> DataFrame:
    """(dim, value): the n-th smallest value of each dimension, from 0; ties count.

    Counts of bins tell which bin of each dimension holds it; only that one is sorted.
    """
    parts = data.select("id", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    ends = parts.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)
    binned = parts.join(F.broadcast(ends), "dim").select("id", "dim", "x", F.when(F.col("high") > F.col("low"), place).otherwise(0).cast("long").alias("bin"))  # a row for each dimension
    counts = binned.groupBy("dim", "bin").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("dim").orderBy("bin"))
    holds = counts.withColumn("upto", upto).where((F.col("upto") > n) & (F.col("upto") - F.col("c") <= n)).select("dim", "bin", (F.col("upto") - F.col("c")).alias("before"))
    order = Window.partitionBy("dim").orderBy("x", "id")
    ranked = binned.join(F.broadcast(holds), ["dim", "bin"]).withColumn("r", F.row_number().over(order) + F.col("before"))
    return ranked.where(F.col("r") == n + 1).select("dim", F.col("x").alias("value"))


def unique_values(data: DataFrame, dim: int) -> DataFrame:
    """The distinct values of a dimension in order."""
    return data.select(F.get("vector", F.lit(dim)).cast("double").alias("value")).distinct().orderBy("value")


def all_binary(data: DataFrame) -> DataFrame:
    return data.agg(F.bool_and(F.forall("vector", lambda x: (x == 0) | (x == 1))).alias("is_binary"))
