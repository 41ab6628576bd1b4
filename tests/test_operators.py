"""Properties, hand-computed cases and differential tests of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from summitry.functions import distances, ngrams, vectors
from summitry.operators import density, knn, quantize, ranking, validity
from summitry.plans.cut import cut
from summitry.plans.model import DensityPeaks, cluster_vectors, cluster_by
from summitry.streaming import assign


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("x")).first().x


def blobs(spark, n=120, k=3, seed=5):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(20 * c, 1.0, (n // k, 2)) for c in range(k)])
    rows = [(i, [float(v) for v in p], i // (n // k) + 1) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, value array<double>, truth int")


def test_string_distances(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, distances.levenshtein(a, b), a="abcde", b="a2zde") == 2
    assert one(spark, ngrams.string_dice(a, b), a="abc", b="abc") == pytest.approx(0)
    assert one(spark, ngrams.string_dice(a, b), a="", b="abc") == pytest.approx(1)
    # of aaaa and aa the bigrams aa, aa, aa and aa share one
    assert one(spark, ngrams.dice(a, b, 2), a="aaaa", b="aa") == pytest.approx(2 / 4)


def test_set_dice(spark):
    x = one(spark, distances.set_dice(F.col("a"), F.col("b")), a=list("ABDEH"), b=list("BDEF"))
    assert x == pytest.approx(1 - 2 / 3)


def test_vector_functions(spark):
    a, b = F.col("a"), F.col("b")
    v = {"a": [3.0, 4.0], "b": [0.0, 0.0]}
    assert one(spark, distances.l2(a, b), **v) == 5
    assert one(spark, distances.l1(a, b), **v) == 7
    assert one(spark, distances.minkowski(2)(a, b), **v) == 25
    assert one(spark, distances.cosine(a, b), **v) is None
    assert one(spark, vectors.normalise(a), **v) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.normalise(b), **v) == [0.0, 0.0]
    assert one(spark, vectors.subset(a, [False, True]), **v) == [4.0]
    assert one(spark, vectors.compare(a, b), **v) == 1
    with pytest.raises(ValueError):
        distances.get("nothing")


@pytest.mark.parametrize("name", ["l2", "l1", "cos"])
def test_block_kernel_agrees_with_expression(spark, name):
    df = blobs(spark, 60)
    fast = {(r.src, r.dst): r.dist for r in knn.brute(df, 4, name).collect()}
    d = distances.get(name)
    pts = knn.points(df, "id", "value")
    pairs = pts.toDF("src", "a").join(pts.toDF("dst", "b"), F.col("src") != F.col("dst")).select("src", "dst", d(F.col("a"), F.col("b")).alias("dist"))
    slow = {(r.src, r.dst): r.dist for r in knn.top_k(pairs, 4).collect()}
    assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k]) for k in fast)


def test_graph_properties_and_recall(spark):
    df = blobs(spark, 150)
    exact = knn.brute(df, 5).cache()
    assert exact.where("src = dst").count() == 0 and exact.count() == 150 * 5
    assert knn.recall(exact, exact, 5).first().recall == 1
    for method in ("rpdiv", "nndescent"):
        found = knn.build(df, 5, method, max_iter=8, tol=0.01)
        assert knn.recall(found, exact, 5).first().recall >= 0.9


def test_clusters_blobs(spark):
    df = blobs(spark)
    truth = df.select("id", F.col("truth").alias("label"))
    for model in (DensityPeaks(3, 8, "brutef").fit(df), cluster_vectors(df, 3, 8, maxiter=6), DensityPeaks(3, 8, "brutef", exact=True, tie_break="additive").fit(df)):
        assert model.evaluate(truth, ("ari", "nmi", "nvd")) == pytest.approx({"ari": 1, "nmi": 1, "nvd": 0})
    labels, peaks = model.collect()
    assert len(labels) == 120 and len(peaks) == 3 and [labels[p] for p in peaks] == [1, 2, 3]


def test_custom_distance(spark):
    df = blobs(spark, 45)

    def l2(a, b):
        return ((np.stack(a.to_list()) - np.stack(b.to_list())) ** 2).sum(1) ** 0.5 if len(a) else a.astype(float)

    def series(a, b):
        import pandas as pd

        return pd.Series(l2(a, b))

    found = cluster_by(df, series, 3, 5, maxiter=4)
    assert found.evaluate(df.select("id", F.col("truth").alias("label")), ("ari",))["ari"] == pytest.approx(1)


def test_duplicates_have_one_root(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(15)] + [(15, [2.0, 2.0])], "id long, value array<double>")
    model = DensityPeaks(2, 3, "brutef").fit(df)
    assert model.stats.where("nhd is null").count() == 1
    assert model.labels.where("label is null").count() == 0


def test_too_many_clusters(spark):
    df = blobs(spark, 6)
    with pytest.raises(ValueError):
        DensityPeaks(7, 2, "brutef").fit(df)


def test_indices_of_equal_labelings(spark):
    p = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, label int")
    q = p.withColumn("label", 9 - F.col("label"))
    got = validity.evaluate(p, q, (*validity.ALL, "ch"))
    for name in ("ri", "ari", "nmi", "jaccard", "fm", "purity"):
        assert got[name] == pytest.approx(1)
    for name in ("nvd", "vi", "nvi", "ch", "ci_part"):
        assert got[name] == pytest.approx(0)
    with pytest.raises(ValueError):
        validity.evaluate(p, p.limit(3))
    with pytest.raises(ValueError):
        validity.evaluate(p, p, ("nothing",))


def test_codebooks(spark, monkeypatch):
    df = blobs(spark, 30)
    data, part = df.select("id", F.col("value").alias("vector")), df.select("id", F.col("truth").alias("cluster"))
    book = quantize.centroids(data, part, 4)
    assert book.where("freq = 0").count() == 1
    book = book.where("freq > 0").select("code", "vector")
    assert quantize.optimal_partition(data, book).join(part.withColumnRenamed("cluster", "c"), "id").where("c <> cluster").count() == 0
    assert quantize.centroid_index(book, book).first().ci == 0
    assert quantize.centroid_index_star(data, book, book).first().ci_star == 1
    merged = quantize.merge_codebooks(book, book)
    assert merged.count() == 6 and merged.select("code").distinct().count() == 6
    assert {r.code for r in quantize.remove_code(book, 1).collect()} == {1, 2}
    assert quantize.fill_empty(data, part, book, 5).select("cluster").distinct().count() == 5
    assert quantize.join_clusters(part, 1, 2).select("cluster").distinct().count() == 2
    assert quantize.all_in_own(data).select("cluster").distinct().count() == 30
    assert quantize.all_binary(data).first()[0] is False
    assert quantize.repartition_for_new(data, quantize.all_in_first(data), book, [2, 3]).where("cluster = 2").count() == 10
    want = sorted(tuple(r) for r in quantize.nearest_code(data, book, "l1").collect())
    for numbers in (0, 1 << 20):  # codes in arrays of one, joined and broadcast
        monkeypatch.setattr(quantize, "BOOK", 1)
        monkeypatch.setattr(quantize, "BROADCAST_NUMBERS", numbers)
        assert sorted(tuple(r) for r in quantize.nearest_code(data, book, "l1").collect()) == want


def test_additive_density(spark):
    edges = spark.createDataFrame([(1, 2, 0.5, 1), (2, 1, 0.5, 1)], "src long, dst long, dist double, rank int")
    got = {r.id: r.density for r in density.density(edges, "additive").collect()}
    assert got[2] - got[1] == pytest.approx(1e-10, rel=1e-3)
    with pytest.raises(ValueError):
        density.density(edges, "other")


def test_samples_repeat(spark):
    df = spark.range(50)
    assert ranking.sample(df, 5, "id").collect() == ranking.sample(df.repartition(7), 5, "id").collect()
    assert df.select(ranking.uniform("id", 1).alias("u")).where("u < 0 or u >= 1").count() == 0
    assert df.select(ranking.integer("id", 1, 3, 6).alias("u")).where("u < 3 or u > 6").count() == 0


def test_ties_in_exact_graphs(spark):
    """399 points at one distance: the smallest ids are the neighbours; the same far from the origin."""
    for shift in (0.0, 1e6):
        rows = [(0, [shift, shift])] + [(i, [shift + 1.0, shift]) for i in range(1, 400)]
        df = spark.createDataFrame(rows, "id long, value array<double>")
        assert [r.dst for r in knn.brute(df, 3).where("src = 0").orderBy("rank").collect()] == [1, 2, 3]


def test_exact_graphs_by_any_distance(spark):
    words = [(i, w) for i, w in enumerate(["abc", "abd", "xbd", "xyd", "xyz", "abc", ""])]
    df = spark.createDataFrame(words, "id long, value string")
    lev = lambda a, b: pd.Series([len(set(x) ^ set(y)) for x, y in zip(a, b)], dtype=float)
    got = {(r.src, r.dst, r.dist) for r in knn.brute(df, 2, "lev").collect()}
    assert (0, 5, 0.0) in got and (0, 1, 1.0) in got and len(got) == 14
    own = {(r.src, r.dst, r.dist) for r in knn.brute(df, 2, lev).collect()}
    assert (0, 5, 0.0) in own and (0, 1, 2.0) in own and len(own) == 14


def test_kernels_agree_with_expressions(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd"), rng.integers(0, 9))) for _ in range(12)]
    vectors = rng.integers(0, 3, (12, 5)).astype(float)
    for name in ("lev", "dice", "l2sq", "l2floor", "entropy", "bjaccard", "bdice", "set"):
        values = texts if name in ("lev", "dice") else [sorted(set(t)) for t in texts] if name == "set" else vectors.tolist()
        kind = {"lev": "string", "dice": "string", "set": "array<string>"}.get(name, "array<double>")
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
        rows = df.crossJoin(df.toDF("j", "w")).select("i", "j", distances.get(name)(F.col("v"), F.col("w")).alias("d")).collect()
        kernel = distances.values_kernel(name)
        matrix = kernel(knn._values(values), knn._values(values))
        for r in rows:
            assert abs(matrix[r.i, r.j] - r.d) < 1e-9, (name, values[r.i], values[r.j])


def test_recall_of_settled_graphs(spark):
    """Default rounds on the table: nine of ten true neighbours at least."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS value")
    truth = cut(knn.brute(df, 10))
    assert knn.recall(knn.build(df, 10, "rpdiv"), truth, 10).first().recall >= 0.9
    names = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_partkey AS id", "concat(p_name, p_type) AS value")
    close = cut(knn.brute(names, 5, "lev"))
    found = knn.build(names, 5, "rpdiv", distance="lev")
    length = lambda g: g.agg(F.sum("dist")).first()[0]
    assert length(found) <= 1.05 * length(close)


def test_labels_of_long_chains(spark):
    stats = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "id long, nhd long")
    peaks = spark.createDataFrame([(0, 1), (150, 2)], "id long, label int")
    got = {r.id: r.label for r in density.propagate(stats, peaks).collect()}
    assert got == {i: 1 if i < 150 else 2 for i in range(300)}


def test_labels_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=2) + 20 * (i % 2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, value array<double>")
    model = DensityPeaks(2, 8, "brutef").fit(df)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = assign.label_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/state")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.id: r.code for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 80 and all(got[i] == got[i % 2] for i in got) and got[0] != got[1]


def most_rows(df):
    """The most rows that any step of a plan made, after it ran."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        if "AdaptiveSparkPlan" in node.getClass().getName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getName():
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_nearest_members_make_no_pairs(spark, monkeypatch):
    """One cluster beside small ones, some points alone, copies, ties; by every kind of distance, in cells of any size."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(0, 4, 3)], 1 if i % 3 else i // 40) for i in range(400)] + [(400, [1.0, 2.0, 0.1], 77)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, cluster int")
    data, part = df.select("id", "vector"), df.select("id", "cluster")
    for name in ("l2", "l1", "cos", "l2sq", "bjaccard", "entropy"):
        d = distances.get(name)
        pairs = df.toDF("i", "a", "cluster").join(df.toDF("j", "b", "cluster"), "cluster").where("i <> j").select("i", "j", d(F.col("a"), F.col("b")).alias("d"))
        best = pairs.groupBy("i").agg(F.min(F.struct(F.col("d").isNull().alias("n"), "d", "j")).alias("m"))
        want = {(r.i, r.m.j, None if r.m.d is None else round(r.m.d, 9)) for r in best.collect()}
        for numbers in (1 << 21, 90):
            monkeypatch.setattr(quantize, "BLOCK_NUMBERS", numbers)
            got = quantize.nearest_in_cluster(data, part, data, name)
            assert {(r.id, r.nearest, None if r.dist is None else round(r.dist, 9)) for r in got.collect()} == want, (name, numbers)
    few = quantize.nearest_in_cluster(data, part, data.where("id in (4, 9)"))
    assert {r.id for r in few.collect()} == {4, 9}
    monkeypatch.setattr(quantize, "BLOCK_NUMBERS", 1 << 21)
    assert most_rows(quantize.nearest_in_cluster(data, part, data)) <= 2 * len(rows)


def test_nearest_members_of_odd_vectors(spark):
    """Null distances come last and NaN before them, as in SQL; a lone member has no row."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [3.0, 4.0], 1), (4, [nan, 0.0], 1), (5, [None, 1.0], 1), (6, [inf, 0.0], 1), (7, None, 2), (8, [1.0, 1.0], 2), (9, [1.0, 1.0], 3), (10, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, cluster int")
    got = {r.id: (r.nearest, r.dist) for r in quantize.nearest_in_cluster(df.select("id", "vector"), df.select("id", "cluster"), df).collect()}
    assert got[4][0] == 2 and got.pop(4)[1] != 0
    assert got == {1: (2, None), 2: (3, 5.0), 3: (2, 5.0), 5: (1, None), 6: (2, inf), 7: (8, None), 8: (7, None)}


def test_equal_codes_are_measured_once(spark, monkeypatch):
    """The smallest of equal codes is found; codes at a null distance come last; one row for each id."""
    rows = [(c, [float(c % 20), 1.0]) for c in range(3000)] + [(-5, [None, 1.0]), (-6, None)]
    book = spark.createDataFrame(rows, "code long, vector array<double>")
    data = spark.createDataFrame([(i, [i % 23 + 0.25, 2.0]) for i in range(200)] + [(7, [3.0, 1.0]), (300, None)], "id long, vector array<double>")
    monkeypatch.setattr(quantize, "BOOK", 4)
    found = quantize.nearest_code(data, book, "l1")
    got = {r.id: (r.code, r.error) for r in found.collect()}
    assert found.count() == len(got) == 201
    assert all(got[i] == (min(i % 23, 19), abs(i % 23 + 0.25 - min(i % 23, 19)) + 1) for i in range(200) if i != 7)
    assert got[7] == (3, 0.0) and got[300] == (-6, None)
    assert most_rows(found) <= len(rows)


def test_recall_where_neighbours_lead_nowhere(spark):
    """Independent components: a graph of 3 * k neighbours settles with too few true ones, and goes on wider."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(4000, 64)).tolist())], "id long, value array<double>")
    truth = cut(knn.brute(df, 10))
    assert knn.recall(knn.build(df, 10, "rpdiv"), truth, 10).first().recall >= 0.9
