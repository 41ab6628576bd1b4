"""Queries over single functions, edits, readers and writers, each with its SQL."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances, vectors
from ..operators import knn, quantize, ranking
from ..sources import binary, lines, viewer
from .queries import _BOOK, _ERRORS, _L2, _V, K, _edges, _embeddings, _folder, _training, query, r6, table

# Vectors

_PAIR = "SELECT a.vec_id AS vec_id, {e} FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings) b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, sf_dir) -> DataFrame:
    v = _embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), "value")
    return v.select("vec_id", F.col("value").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("value").alias("y")), "vec_id")


@query("dist_floor_l2", _PAIR.format(e="floor(list_distance(list_transform(x, lambda p: 10 * p), list_transform(y, lambda p: 10 * p)))::BIGINT AS dist"))
def dist_floor_l2(spark, sf_dir):
    ten = lambda c: F.transform(c, lambda v: v * 10)
    return _pairs(spark, sf_dir).select("vec_id", distances.floor_l2(ten("x"), ten("y")).cast("long").alias("dist"))


@query("vec_compare", _PAIR.format(e="CASE WHEN x[:2] < y[:2] THEN -1 WHEN x[:2] > y[:2] THEN 1 ELSE 0 END AS sign, CASE WHEN list_transform(x, lambda p: floor(4 * p)) < list_transform(y, lambda p: floor(4 * p)) THEN -1 WHEN list_transform(x, lambda p: floor(4 * p)) > list_transform(y, lambda p: floor(4 * p)) THEN 1 ELSE 0 END AS rough_sign"))
def vec_compare(spark, sf_dir):
    rough = lambda c: F.transform(c, lambda v: F.floor(v * 4))
    return _pairs(spark, sf_dir).select("vec_id", vectors.compare(F.slice("x", 1, 2), F.slice("y", 1, 2)).alias("sign"), vectors.compare(rough("x"), rough("y")).alias("rough_sign"))


@query("vec_average", _PAIR.format(e="list_sum(list_transform(list_zip(x, y), lambda p: floor((floor(100 * p[1]) + floor(100 * p[2])) / 2)))::BIGINT AS total"))
def vec_average(spark, sf_dir):
    whole = lambda c: F.transform(c, lambda v: F.floor(v * 100))
    mean = vectors.average(whole("x"), whole("y"))
    return _pairs(spark, sf_dir).select("vec_id", F.aggregate(mean, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("vec_subset", "SELECT vec_id, len(embedding[1:3] || embedding[10:10])::INT AS size, round(list_sum(embedding[1:3]::DOUBLE[] || embedding[10:10]::DOUBLE[]), 6) AS total FROM embeddings")
def vec_subset(spark, sf_dir):
    some = vectors.subset(F.col("value"), [i in (0, 1, 2, 9) for i in range(64)])
    return _embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), F.size(some).alias("size"), r6(F.aggregate(some, F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query("error_distances", _PAIR.format(e="round(pow(list_distance(x, y), 2), 6) AS mse, round(1e6 * len(list_filter(list_zip(x, y), lambda p: (p[1] > 0) <> (p[2] > 0))) / len(list_filter(list_zip(x, y), lambda p: p[1] > 0 OR p[2] > 0))) AS jaccard"))
def error_distances(spark, sf_dir):
    d = lambda error: distances.get(distances.of_error(error))(F.col("x"), F.col("y"))
    return _pairs(spark, sf_dir).select("vec_id", r6(d("mse")).alias("mse"), d("jaccard").alias("jaccard"))


@query("printable_errors", f"WITH {_ERRORS} SELECT id, round(error * 64, 5) AS binary, round(error, 6) AS plain FROM err")
def printable_errors(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    errors = quantize.point_errors(data, part, quantize.centroids(data, part))
    return errors.select("id", F.round(vectors.printable_error(F.col("error"), F.lit(1), 64), 5).alias("binary"), r6(vectors.printable_error(F.col("error"), F.lit(2), 64)).alias("plain"))


@query("sorted_vectors", "SELECT r, vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY floor(4 * embedding[1]::DOUBLE) DESC, floor(4 * embedding[2]::DOUBLE), embedding[3]) AS r FROM embeddings) WHERE r <= 100")
def sorted_vectors(spark, sf_dir):
    rough = _embeddings(spark, sf_dir).select("id", F.array(F.floor(F.col("value")[0] * 4).cast("double"), F.floor(F.col("value")[1] * 4).cast("double"), F.col("value")[2]).alias("vector"))
    first = ranking.sort_vectors(rough, [(0, False), (1, True), (2, True)]).limit(100)
    return lines.numbered_by(first.select("id", F.struct(-F.col("vector")[0], F.col("vector")[1], F.col("vector")[2]).alias("at")), "at").select((F.col("n") + 1).alias("r"), F.col("id").alias("vec_id"))


# Graphs

_TIES = f"v AS (SELECT vec_id AS id, list_transform(embedding[:6], lambda x: floor(4 * x::DOUBLE)) AS e FROM embeddings), near AS MATERIALIZED (SELECT src, dst, dist, rank FROM (SELECT a.id AS src, b.id AS dst, {{d}} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {{d}}, b.id) AS rank FROM v a JOIN v b ON a.id <> b.id) WHERE rank <= {K})"


def _tied(spark, sf_dir) -> DataFrame:
    return _embeddings(spark, sf_dir).select("id", F.transform(F.slice("value", 1, 6), lambda x: F.floor(x * 4).cast("double")).alias("value"))


@query("knn_ties", "WITH " + _TIES.format(d="list_distance(a.e, b.e)") + " SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM near")
def knn_ties(spark, sf_dir):
    return knn.brute(_tied(spark, sf_dir), K).select("src", "dst", r6("dist").alias("dist"), F.col("rank").cast("int").alias("rank"))


@query("knn_recall_of_l1", f"WITH {_L2}, " + "other AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, l2 FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.e, b.e) AS l2, list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))) AS dist FROM v a JOIN v b ON a.id <> b.id))" + " SELECT round((SELECT count(*) FROM near n JOIN other o ON o.src = n.src AND o.dst = n.dst AND o.rank <= 5 WHERE n.rank <= 5) / count(*), 6) AS recall, count(*) AS wanted FROM near WHERE rank <= 5")
def knn_recall_of_l1(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    found = knn.recall(knn.brute(e, K, "l1"), _edges(spark, sf_dir), 5)
    return found.select(r6("recall").alias("recall"), "wanted")


@query("knn_insert", f"WITH {_L2}, e AS (SELECT src, dst, dist, rank % 2 = 0 AS is_new FROM near), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM e) SELECT src, dst, round(dist, 6) AS dist, is_new FROM k WHERE r <= 4")
def knn_insert(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    old, new = edges.where("rank % 2 = 1"), edges.where("rank % 2 = 0 or rank = 1")
    return knn.merge(old, new, 4).select("src", "dst", r6("dist").alias("dist"), "is_new")


@query("knn_random", "SELECT vec_id AS src, true AS within FROM embeddings")
def knn_random(spark, sf_dir):
    """Every point draws neighbours, never itself, never one twice, at most k."""
    pts = knn.points(_embeddings(spark, sf_dir), "id", "value")
    drawn = knn.random_graph(pts, K, 3, "l2")
    return drawn.groupBy("src").agg((F.count("*").between(1, K) & (F.countDistinct("dst") == F.count("*")) & (F.min(F.abs(F.col("src") - F.col("dst"))) > 0)).alias("within"))


# Codebooks and partitions

_CODES = "b AS (SELECT p_partkey AS code, [p_size::DOUBLE, floor(p_retailprice / 100)] AS c FROM part), s AS (SELECT s_suppkey AS id, [(s_suppkey % 50)::DOUBLE, floor(s_acctbal / 500)] AS x FROM supplier)"


@query("nearest_code_l1_large", f"WITH {_CODES} SELECT id, code, error FROM (SELECT id, code, abs(x[1] - c[1]) + abs(x[2] - c[2]) AS error, row_number() OVER (PARTITION BY id ORDER BY abs(x[1] - c[1]) + abs(x[2] - c[2]), code) AS r FROM s, b) WHERE r = 1")
def nearest_code_l1_large(spark, sf_dir):
    book = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 100).cast("double")).alias("vector"))
    data = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_suppkey") % 50).cast("double"), F.floor(F.col("s_acctbal") / 500).cast("double")).alias("vector"))
    return quantize.nearest_code(data, book, "l1")


_BITS = "v AS (SELECT vec_id AS id, label AS c, list_transform(embedding, lambda x: (x > 0)::INT) AS e FROM embeddings), n AS (SELECT c, count(*) AS n FROM v GROUP BY c), o AS (SELECT c, d, sum(x) AS o FROM (SELECT c, unnest(e) AS x, unnest(range(len(e))) AS d FROM v) GROUP BY c, d)"


@query("stochastic_complexity", f"WITH {_BITS}, t AS (SELECT sum(n) AS t, count(*) AS k, sum(lgamma(n + 1)) AS g FROM n), b AS (SELECT sum(lgamma(n + 2) - lgamma(o + 1) - lgamma(n - o + 1)) AS b FROM o JOIN n USING (c)) SELECT round((CASE WHEN true THEN lgamma(t + 1) - g + lgamma(t + k) - lgamma(t) - lgamma(k) + b END) / ln(2) / t, 6) AS complexity FROM t, b")
def stochastic_complexity(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    bits = data.select("id", F.transform("vector", lambda x: (x > 0).cast("int")).alias("vector"))
    return quantize.stochastic_complexity(bits, part).select(r6("complexity").alias("complexity"))


@query("average_jaccard_error", f"WITH {_BITS}, m AS (SELECT c, list((2 * o >= n)::INT ORDER BY d) AS b FROM o JOIN n USING (c) GROUP BY c), e AS (SELECT CASE WHEN len(list_filter(list_zip(e, b), lambda p: p[1] + p[2] > 0)) > 0 THEN round(1e6 * len(list_filter(list_zip(e, b), lambda p: p[1] <> p[2])) / len(list_filter(list_zip(e, b), lambda p: p[1] + p[2] > 0))) ELSE 0 END AS j, round(1e6 * len(list_filter(list_zip(e, b), lambda p: p[1] <> p[2])) / greatest(1, list_sum(e) + list_sum(b))) AS d FROM v JOIN m USING (c)) SELECT round(avg(j) / 64, 6) AS jaccard, round(avg(d) / 64, 6) AS dice FROM e")
def average_jaccard_error(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    data = data.select("id", F.transform("vector", lambda x: (x > 0).cast("int")).alias("vector"))
    book = quantize.centroids(data, part, whole=True)
    mean = lambda error, name: quantize.average_error(quantize.point_errors(data, part, book, distances.of_error(error)), 64).select(r6("average_error").alias(name))
    return mean("jaccard", "jaccard").crossJoin(mean("dice", "dice"))  # a row each


@query("cluster_statistics", f"WITH {_V} SELECT label AS cluster, count(DISTINCT e) AS uniques, count(*) AS freq, round(sum(e[1]), 6) AS first, round(sum(e[64]), 6) AS last FROM v GROUP BY label")
def cluster_statistics(spark, sf_dir):
    found = quantize.cluster_statistics(*_training(spark, sf_dir))
    return found.select("cluster", "uniques", "freq", r6(F.col("sums")[0]).alias("first"), r6(F.col("sums")[63]).alias("last"))


for _mode, _order in {"data_ascending": "c", "data_descending": "c DESC", "freq_ascending": "n", "freq_descending": "n DESC", "vector_mean": "list_sum(c)"}.items():

    def _sorted(spark, sf_dir, mode=_mode):
        data, part = _training(spark, sf_dir)
        return quantize.sort_codebook(quantize.centroids(data, part), mode).select("place", "code", F.col("freq").cast("long").alias("freq"))

    query(f"codebook_{_mode}", f"WITH {_BOOK}, s AS (SELECT label AS code, count(*) AS n FROM v GROUP BY label) SELECT row_number() OVER (ORDER BY {_order}, code)::INT AS place, code, n AS freq FROM book JOIN s USING (code)")(_sorted)


@query("codebook_edits", f"WITH {_BOOK}, m AS (SELECT max(code) AS m FROM book), j AS (SELECT code, c FROM book UNION ALL SELECT code + m, c FROM book, m) SELECT CASE WHEN code = (SELECT max(code) FROM j) THEN 2 ELSE code END AS code, round(c[1], 6) AS x0 FROM j WHERE code <> 2")
def codebook_edits(spark, sf_dir):
    """A codebook joined to itself, then code 2 taken out."""
    book = quantize.centroids(*_training(spark, sf_dir)).select("code", "vector")
    return quantize.remove_code(quantize.merge_codebooks(book, book), 2).select("code", r6(F.col("vector")[0]).alias("x0"))


@query("repartition_for_new", f"WITH {_ERRORS}, n AS (SELECT v.id, code, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS near, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(e, c), code) AS r FROM v, book WHERE code IN (1, 4)) SELECT v.id, CASE WHEN n.near < err.error THEN n.code ELSE v.label END AS cluster FROM v JOIN err ON err.id = v.id JOIN n ON n.id = v.id AND r = 1")
def repartition_for_new(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.repartition_for_new(data, part, quantize.centroids(data, part), [1, 4])


@query("fill_empty_random", f"WITH {_BOOK}, e AS (SELECT c AS code, row_number() OVER (ORDER BY c) AS r FROM range(10, 13) t(c)), d AS (SELECT id, row_number() OVER (ORDER BY md5(concat('1:', id::VARCHAR)), id) AS r, e[1] AS x0 FROM v) SELECT code::INT AS code, round(x0, 6) AS x0 FROM e JOIN d USING (r) UNION ALL SELECT code, round(c[1], 6) FROM book WHERE code > 0")
def fill_empty_random(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    filled = quantize.fill_empty_random(data, part.where("cluster > 0"), quantize.centroids(data, part).where("code > 0"), 12)
    return filled.select("code", r6(F.col("vector")[0]).alias("x0"))


@query("total_freq", "SELECT sum(l_linenumber)::BIGINT AS total_freq FROM lineitem")
def total_freq(spark, sf_dir):
    return quantize.total_freq(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("freq")))


# Random draws


@query("random_ranges", "SELECT c_custkey, true AS within FROM customer")
def random_ranges(spark, sf_dir):
    """Whole numbers and fractions stay in their ranges and are the same for each row and seed."""
    drawn = table(spark, sf_dir, "customer").select("c_custkey", ranking.integer("c_custkey", 5, -3, 12).alias("i"), ranking.integer("c_custkey", 5, -3, 12).alias("j"), ranking.uniform("c_custkey", 5).alias("u"))
    return drawn.select("c_custkey", (F.col("i").between(-3, 12) & (F.col("i") == F.col("j")) & (F.col("u") >= 0) & (F.col("u") < 1)).alias("within"))


@query("shuffled", "SELECT (row_number() OVER (ORDER BY md5(concat('9:', c_custkey::VARCHAR)), c_custkey) - 1)::BIGINT AS n, c_custkey FROM customer")
def shuffled(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(ranking.draw("c_custkey", 9), "c_custkey").alias("at"))
    return lines.numbered_by(rows, "at").select("n", "c_custkey")


# Files


@query("roundtrip_strings", "SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS id, p_name AS text FROM part")
def roundtrip_strings(spark, sf_dir):
    path = _folder(spark, "strings")
    table(spark, sf_dir, "part").repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey").select("p_name").write.text(path)
    return lines.read_strings(spark, path)


@query("roundtrip_sets", "WITH b AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS i FROM lineitem GROUP BY l_orderkey) SELECT (row_number() OVER (ORDER BY l_orderkey) - 1)::BIGINT AS id, len(i)::INT AS size, i[1]::VARCHAR AS first FROM b")
def roundtrip_sets(spark, sf_dir):
    path = _folder(spark, "sets")
    baskets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("i"))
    baskets.repartitionByRange(3, "l_orderkey").sortWithinPartitions("l_orderkey").select(F.concat_ws(" ", F.col("i").cast("array<string>")).alias("value")).write.text(path)
    return lines.read_sets(spark, path).select("id", F.size("items").alias("size"), F.col("items")[0].alias("first"))


@query("encoded_items", "WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS t FROM lineitem), f AS (SELECT t, min((l_orderkey, l_linenumber)) AS place FROM i GROUP BY t), c AS (SELECT t, row_number() OVER (ORDER BY place) - 1 AS code FROM f) SELECT l_orderkey AS id, sum(code)::BIGINT AS total, count(*) AS n FROM i JOIN c USING (t) GROUP BY l_orderkey")
def encoded_items(spark, sf_dir):
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("t")))), lambda x: x["t"])
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(items.alias("items"))
    coded = lines.encode_items(sets)
    return coded.select("id", F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("items").cast("long").alias("n"))


@query("roundtrip_statistics", f"WITH {_L2}, d AS (SELECT src AS id, 1 / avg(dist) AS density FROM near GROUP BY src) SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS id, round(density, 3) AS density FROM d")
def roundtrip_statistics(spark, sf_dir):
    stats = _edges(spark, sf_dir).groupBy(F.col("src").alias("id")).agg((1 / F.avg("dist")).alias("density"), F.min("dst").alias("nhd"), F.max("dist").alias("delta"))
    path = _folder(spark, "statistics")
    lines.write_statistics(stats, path)
    parts = F.split(F.trim("value"), r"\s+")
    return lines.numbered(spark, path).select(F.col("line").alias("id"), F.round(parts[1].cast("double"), 3).alias("density"))


@query("roundtrip_codebook_text", f"WITH {_BOOK} SELECT (row_number() OVER (ORDER BY code) - 1)::BIGINT AS idx, list_sum(list_transform(c, lambda x: floor(round(100 * x, 6) + 0.5)))::BIGINT AS total FROM book")
def roundtrip_codebook_text(spark, sf_dir):
    path = _folder(spark, "book")
    book = quantize.centroids(*_training(spark, sf_dir)).select(F.col("code").alias("id"), F.transform("vector", lambda x: x * 100).alias("features"))
    lines.write_vectors(book, path, 6)
    return lines.read_codebook_text(spark, path).select("idx", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _local(spark, name: str) -> str:
    """A path for the writers of single binary files."""
    return urlparse(_folder(spark, name)).path


@query("roundtrip_ivec", f"WITH {_L2} SELECT src, dst, rank::INT AS rank FROM near")
def roundtrip_ivec(spark, sf_dir):
    path = _local(spark, "ivec")
    binary.write_ivec(_edges(spark, sf_dir), path)
    return binary.read_ivec(spark, f"file://{path}").select("src", "dst", "rank")


@query("roundtrip_lshkit", "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS id, round(embedding[1]::DOUBLE, 6) AS x0, round(embedding[64]::DOUBLE, 6) AS x63 FROM embeddings")
def roundtrip_lshkit(spark, sf_dir):
    path = _local(spark, "lshkit")
    binary.write_lshkit(_embeddings(spark, sf_dir), path, "value")
    return binary.read_lshkit(spark, f"file://{path}").select("id", r6(F.col("features")[0]).alias("x0"), r6(F.col("features")[63]).alias("x63"))


@query("roundtrip_codebook", "SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS idx, p_brand AS name, p_size AS x0, floor(p_retailprice)::INT AS x1, (1 + p_size % 3)::INT AS freq FROM part")
def roundtrip_codebook(spark, sf_dir):
    path = _local(spark, "codebook")
    rows = table(spark, sf_dir, "part").select(F.struct("p_partkey").alias("at"), F.col("p_brand").alias("name"), F.array(F.col("p_size").cast("int"), F.floor("p_retailprice").cast("int")).alias("vector"), (1 + F.col("p_size") % 3).cast("int").alias("freq"))
    binary.write_codebook(lines.numbered_by(rows, "at").withColumnRenamed("n", "idx"), path)
    return binary.read_codebook(spark, f"file://{path}").select("idx", "name", F.col("vector")[0].alias("x0"), F.col("vector")[1].alias("x1"), "freq")


@query("roundtrip_graph", f"WITH {_L2} SELECT src, dst, rank::INT AS rank, label FROM near JOIN (SELECT vec_id AS src, label FROM embeddings) USING (src)")
def roundtrip_graph(spark, sf_dir):
    path = _folder(spark, "graph")
    nodes = _embeddings(spark, sf_dir).select(F.col("id").alias("index"), F.array("label").alias("data"))
    lines.write_graph(nodes, _edges(spark, sf_dir), path)
    found, edges, _ = lines.read_graph(spark, path)
    return edges.join(found.withColumnRenamed("index", "src"), "src").select("src", "dst", F.col("rank").cast("int").alias("rank"), F.col("data")[0].alias("label"))


@query("string_graph_lines", f"WITH {_L2}, n AS (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY rank) AS near FROM near GROUP BY src) SELECT (row_number() OVER (ORDER BY src) - 1)::BIGINT AS line, src::VARCHAR AS text, near FROM n")
def string_graph_lines(spark, sf_dir):
    path = _folder(spark, "wgraph")
    names = _embeddings(spark, sf_dir).select("id", F.col("id").cast("string").alias("text"))
    lines.write_string_graph(_edges(spark, sf_dir), names, path)
    near = F.regexp_replace(F.regexp_replace(F.split("value", ": ")[1], r"\([^)]*\), $", ""), r"\([^)]*\), ", ",")
    return lines.numbered(spark, path).select("line", F.split("value", ": ")[0].alias("text"), near.alias("near"))


@query("graph_preview", f"WITH {_L2} SELECT src, string_agg(dst::VARCHAR, ' ' ORDER BY rank) AS near FROM near WHERE src < 5 GROUP BY src")
def graph_preview(spark, sf_dir):
    return viewer.first_lists(_edges(spark, sf_dir), 5)
