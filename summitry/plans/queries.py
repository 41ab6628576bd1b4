"""The registered queries over the shared tables, each with its SQL where it has one.

Floating results are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distances, ngrams, vectors
from ..operators import density, knn, quantize, ranking, validity
from ..sources import generators, lines, viewer
from .cut import shared_folder
from .model import DensityPeaks

K, CLUSTERS = 10, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("value"), "label")


def _edges(spark, sf_dir) -> DataFrame:
    return knn.brute(_embeddings(spark, sf_dir), K)


def _stats(spark, sf_dir, exact: bool = False) -> DataFrame:
    pts = knn.points(_embeddings(spark, sf_dir), "id", "value")
    return density.statistics(knn.brute(pts, K), pts, exact=exact)


def _successors(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the row of the next id, if there is one: an equi-join, linear in the table."""
    right = df.select((F.col(key) - 1).alias(key), F.col(value).alias("b"))
    return df.select(key, F.col(value).alias("a")).join(right, key)


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Distances of every vector, string or set to the next one

_NEXT = "SELECT a.vec_id AS vec_id, round({e}, 6) AS dist FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings) b ON b.vec_id = a.vec_id + 1"
_VECTOR_SQL = {
    "l2": "list_distance(x, y)",
    "l1": "list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2])))",
    "minkowski_p3": "list_sum(list_transform(list_zip(x, y), lambda p: pow(abs(p[1] - p[2]), 3)))",
    "l05": "list_sum(list_transform(list_zip(x, y), lambda p: pow(abs(p[1] - p[2]), 0.5)))",
    "cosine": "1 - list_cosine_similarity(x, y)",
    "squared_l2": "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "dot": "list_inner_product(x, y)",
    "binary_jaccard": "CASE WHEN len(list_filter(list_zip(x, y), lambda p: p[1] > 0 OR p[2] > 0)) > 0 THEN round(1e6 * len(list_filter(list_zip(x, y), lambda p: (p[1] > 0) <> (p[2] > 0))) / len(list_filter(list_zip(x, y), lambda p: p[1] > 0 OR p[2] > 0))) ELSE 0 END",
    "binary_dice": "round(1e6 * len(list_filter(list_zip(x, y), lambda p: (p[1] > 0) <> (p[2] > 0))) / (len(list_filter(list_zip(x, y), lambda p: (p[1] > 0) <> (p[2] > 0))) + 2 * len(list_filter(list_zip(x, y), lambda p: p[1] > 0 AND p[2] > 0))))",
    "entropy": "list_sum(list_transform(list_zip(x, y), lambda p: -log2(greatest(CASE WHEN p[2] > 0 THEN p[1] / 1e6 ELSE 1 - p[1] / 1e6 END, 0.001))))",
}
_VECTOR_EXPRESSIONS = {"l2": distances.l2, "l1": distances.l1, "minkowski_p3": distances.minkowski(3), "l05": distances.l05, "cosine": distances.cosine, "squared_l2": distances.squared_l2, "dot": distances.dot, "binary_jaccard": distances.binary_jaccard, "binary_dice": distances.binary_dice, "entropy": distances.entropy}


def _vector_distance(f):
    def run(spark, sf_dir):
        pairs = _successors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "v")
        return pairs.select("vec_id", r6(f(F.col("a"), F.col("b"))).alias("dist"))

    return run


for _name, _f in _VECTOR_EXPRESSIONS.items():
    query(f"dist_{_name}", _NEXT.format(e=_VECTOR_SQL[_name]))(_vector_distance(_f))

_NAMES = "WITH n AS (SELECT DISTINCT p_name AS s FROM part WHERE p_name IS NOT NULL), p AS (SELECT a.s AS a, b.s AS b FROM n a JOIN n b ON a.s < b.s)"
_GRAMS = """, g AS (SELECT s, k, substr(s, i::BIGINT, k::BIGINT) AS gram, count(*) AS c FROM n, range(2, 4) r(k), range(1, 200) t(i) WHERE i <= length(s) - k + 1 GROUP BY ALL),
 z AS (SELECT s, k, sum(c) AS size FROM g GROUP BY ALL),
 m AS (SELECT x.s AS a, y.s AS b, x.k, sum(least(x.c, y.c)) AS both FROM g x JOIN g y ON x.gram = y.gram AND x.k = y.k AND x.s < y.s GROUP BY ALL),
 d AS (SELECT p.a, p.b, r.k, coalesce(2.0 * m.both / (u.size + v.size), 0) AS dice FROM p, range(2, 4) r(k) LEFT JOIN m ON m.a = p.a AND m.b = p.b AND m.k = r.k LEFT JOIN z u ON u.s = p.a AND u.k = r.k LEFT JOIN z v ON v.s = p.b AND v.k = r.k)"""


# Two strings of each row: linear in the table
_TWO = "WITH p AS (SELECT p_partkey AS id, p_name AS a, p_type AS b FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL)"
_TWO_GRAMS = """, s AS (SELECT id, 0 AS side, a AS s FROM p UNION ALL SELECT id, 1, b FROM p),
 g AS (SELECT id, side, k, substr(s, i::BIGINT, k::BIGINT) AS gram, count(*) AS c FROM s, range(2, 4) r(k), range(1, 200) t(i) WHERE i <= length(s) - k + 1 GROUP BY ALL),
 z AS (SELECT id, k, sum(c) AS size FROM g GROUP BY ALL),
 m AS (SELECT x.id, x.k, sum(least(x.c, y.c)) AS both FROM g x JOIN g y ON x.id = y.id AND x.gram = y.gram AND x.k = y.k AND x.side = 0 AND y.side = 1 GROUP BY ALL),
 d AS (SELECT z.id, z.k, coalesce(2.0 * m.both / z.size, 0) AS dice FROM z LEFT JOIN m ON m.id = z.id AND m.k = z.k)"""


def _two_strings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_type").alias("b")).where("a is not null and b is not null")


@query("dist_levenshtein", _TWO + " SELECT id, levenshtein(a, b)::DOUBLE AS dist FROM p")
def dist_levenshtein(spark, sf_dir):
    return _two_strings(spark, sf_dir).select("id", distances.levenshtein(F.col("a"), F.col("b")).alias("dist"))


@query("dist_dice_bigram", _TWO + _TWO_GRAMS + " SELECT id, round(1 - dice, 6) AS dist FROM d WHERE k = 2")
def dist_dice_bigram(spark, sf_dir):
    return _two_strings(spark, sf_dir).select("id", r6(1 - ngrams.dice(F.col("a"), F.col("b"), 2)).alias("dist"))


@query("dist_dice_string", _TWO + _TWO_GRAMS + " SELECT id, round(0.9 * (1 - max(CASE WHEN k = 3 THEN dice END)) + 0.1 * (1 - max(CASE WHEN k = 2 THEN dice END)), 6) AS dist FROM d GROUP BY id")
def dist_dice_string(spark, sf_dir):
    return _two_strings(spark, sf_dir).select("id", r6(ngrams.string_dice(F.col("a"), F.col("b"))).alias("dist"))


@query("dice_join_trigram", _NAMES + _GRAMS + " SELECT a, b, round(dice, 6) AS dice FROM d WHERE k = 3 AND dice > 0")
def dice_join_trigram(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("s")).where("s is not null").distinct()
    return ngrams.dice_join(names, "s", "s", 3).select("a", "b", r6("dice").alias("dice"))


@query("dist_dice_set", """WITH t AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents)
 SELECT a.doc_id, round(1 - 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)), 6) AS dist FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def dist_dice_set(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    return _successors(words, "doc_id", "w").select("doc_id", r6(distances.set_dice(F.col("a"), F.col("b"))).alias("dist"))


@query("custom_distance", _NEXT.format(e=_VECTOR_SQL["l2"]))
def custom_distance(spark, sf_dir):
    def own(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_numpy()), np.stack(b.to_numpy())
        return pd.Series(np.sqrt(((x - y) ** 2).sum(1)))

    pairs = _successors(_embeddings(spark, sf_dir).withColumnRenamed("id", "vec_id"), "vec_id", "value")
    return pairs.select("vec_id", r6(knn.expression(own)(F.col("a"), F.col("b"))).alias("dist"))


@query("vector_algebra", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
 SELECT vec_id, round(sqrt(list_inner_product(x, x)), 6) AS length, round(list_sum(list_transform(x, lambda t: abs(t))), 6) AS manhattan, round(x[1] * 2 + x[1], 6) AS tripled, round(x[3] / sqrt(list_inner_product(x, x)), 6) AS unit2, floor(list_sum(x) / len(x) + 0.5) AS mean FROM v""")
def vector_algebra(spark, sf_dir):
    v = _embeddings(spark, sf_dir)
    x = F.col("value")
    return v.select(F.col("id").alias("vec_id"), r6(vectors.length(x)).alias("length"), r6(vectors.manhattan_length(x)).alias("manhattan"), r6(vectors.add(vectors.scale(x, 2.0), x)[0]).alias("tripled"), r6(vectors.normalise(x)[2]).alias("unit2"), vectors.rounded_mean(x).cast("double").alias("mean"))


# Graphs

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_KNN = f"""{_V}, near AS MATERIALIZED (SELECT src, dst, dist, rank FROM (SELECT a.id AS src, b.id AS dst, {{d}} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {{d}}, b.id) AS rank FROM v a JOIN v b ON a.id <> b.id) WHERE rank <= {K})"""
_L2 = _KNN.format(d="list_distance(a.e, b.e)")


def _graph_out(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", r6("dist").alias("dist"), F.col("rank").cast("int").alias("rank"))


@query("knn_brute_l2", f"WITH {_L2} SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM near")
def knn_brute_l2(spark, sf_dir):
    return _graph_out(_edges(spark, sf_dir))


@query("knn_brute_l1", "WITH " + _KNN.format(d=_VECTOR_SQL["l1"].replace("list_zip(x, y)", "list_zip(a.e, b.e)")) + " SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM near")
def knn_brute_l1(spark, sf_dir):
    return _graph_out(knn.brute(_embeddings(spark, sf_dir), K, "l1"))


@query("knn_brute_cosine", "WITH " + _KNN.format(d="1 - list_cosine_similarity(a.e, b.e)") + " SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM near")
def knn_brute_cosine(spark, sf_dir):
    return _graph_out(knn.brute(_embeddings(spark, sf_dir), K, "cos"))


@query("knn_string", """WITH n AS (SELECT p_name AS s, min(p_partkey) AS id FROM part WHERE p_name IS NOT NULL GROUP BY p_name)
 SELECT src, dst, dist, rank::INT AS rank FROM (SELECT a.id AS src, b.id AS dst, levenshtein(a.s, b.s)::DOUBLE AS dist, row_number() OVER (PARTITION BY a.id ORDER BY levenshtein(a.s, b.s), b.id) AS rank FROM n a JOIN n b ON a.id <> b.id) WHERE rank <= 5""")
def knn_string(spark, sf_dir):
    names = table(spark, sf_dir, "part").where("p_name is not null").groupBy(F.col("p_name").alias("value")).agg(F.min("p_partkey").alias("id"))
    return _graph_out(knn.brute(names, 5, "lev"))


@query("reverse_knn", f"WITH {_L2} SELECT dst AS id, count(*) AS in_degree, round(avg(dist), 6) AS mean_dist FROM near GROUP BY dst")
def reverse_knn(spark, sf_dir):
    return knn.reverse(_edges(spark, sf_dir)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("in_degree"), r6(F.avg("dist")).alias("mean_dist"))


@query("mutual_knn", f"WITH {_L2} SELECT a.src, a.dst, round(a.dist, 6) AS dist FROM near a JOIN near b ON a.src = b.dst AND a.dst = b.src")
def mutual_knn(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return knn.mutual(edges).select("src", "dst", r6("dist").alias("dist"))


@query("graph_edge_stats", f"WITH {_L2} SELECT count(*) AS n_edges, round(sum(dist), 4) AS sum_dist, round(min(dist), 6) AS min_dist, round(max(dist), 6) AS max_dist FROM near")
def graph_edge_stats(spark, sf_dir):
    return knn.edge_stats(_edges(spark, sf_dir)).select("n_edges", F.round("sum_dist", 4).alias("sum_dist"), r6("min_dist").alias("min_dist"), r6("max_dist").alias("max_dist"))


@query("graph_edits", f"WITH {_L2}, m AS (SELECT src, dst, dist FROM near UNION SELECT dst, src, dist FROM near) SELECT src, dst, round(dist, 6) AS dist FROM m WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.rank = 1 AND ((n.src = m.src AND n.dst = m.dst) OR (n.src = m.dst AND n.dst = m.src)))")
def graph_edits(spark, sf_dir):
    """Makes all edges mutual, then removes both directions of every nearest one."""
    edges = _edges(spark, sf_dir)
    return knn.remove_edges(knn.add_edges(edges, edges, each_way=True), edges.where("rank = 1"), each_way=True).select("src", "dst", r6("dist").alias("dist"))


@query("graph_properties", f"WITH {_L2} SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM near GROUP BY src)) AS k, count(*) AS n_points, max(len(e))::INT AS dim, round(min(list_min(e)), 6) AS min_coord, round(max(list_max(e)), 6) AS max_coord FROM v")
def graph_properties(spark, sf_dir):
    found = knn.graph_properties(_edges(spark, sf_dir), _embeddings(spark, sf_dir))
    return found.select("k", "n_points", "dim", r6("min_coord").alias("min_coord"), r6("max_coord").alias("max_coord"))


@query("graph_recompute_l1", f"WITH {_L2} SELECT src, dst, round({_VECTOR_SQL['l1'].replace('list_zip(x, y)', 'list_zip(a.e, b.e)')}, 6) AS dist FROM near JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def graph_recompute_l1(spark, sf_dir):
    return knn.recompute(_edges(spark, sf_dir), _embeddings(spark, sf_dir), "l1").select("src", "dst", r6("dist").alias("dist"))


@query("knn_rpdiv")
def knn_rpdiv(spark, sf_dir):
    return _graph_out(knn.build(_embeddings(spark, sf_dir), K, "rpdiv"))


@query("knn_nndescent")
def knn_nndescent(spark, sf_dir):
    return _graph_out(knn.build(_embeddings(spark, sf_dir), K, "nndescent"))


@query("knn_recall", f"SELECT true AS settled, {K} * count(*) AS wanted FROM embeddings")
def knn_recall(spark, sf_dir):
    """Whether the approximate graph holds nine of ten true neighbours."""
    found = knn.recall(knn.build(_embeddings(spark, sf_dir), K, "rpdiv"), _edges(spark, sf_dir), K)
    return found.select((F.col("recall") >= 0.9).alias("settled"), "wanted")


# Density peaks

_DP = f"""WITH RECURSIVE {_L2},
 dens AS (SELECT src AS id, 1 / greatest(avg(dist), 1e-20) AS density FROM near GROUP BY src),
 g AS (SELECT src AS id, dst AS nhd, dist AS delta FROM (SELECT n.*, row_number() OVER (PARTITION BY src ORDER BY rank) AS r FROM near n JOIN dens a ON a.id = src JOIN dens b ON b.id = dst WHERE (b.density, b.id) > (a.density, a.id)) WHERE r = 1),
 lone AS (SELECT id, density FROM dens WHERE id NOT IN (SELECT id FROM g)),
 s AS (SELECT id, nhd, delta FROM (SELECT p.id, q.id AS nhd, list_distance(x.e, y.e) AS delta, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(x.e, y.e), q.id) AS r FROM lone p JOIN dens q ON (q.density, q.id) > (p.density, p.id) JOIN v x ON x.id = p.id JOIN v y ON y.id = q.id) WHERE r = 1),
 found AS (SELECT * FROM g UNION ALL SELECT * FROM s),
 stats AS (SELECT d.id, d.density, coalesce(f.delta, (SELECT max(delta) FROM found)) AS delta, f.nhd, l.id IS NOT NULL AS is_peak FROM dens d LEFT JOIN found f ON f.id = d.id LEFT JOIN lone l ON l.id = d.id),
 peaks AS (SELECT id, row_number() OVER (ORDER BY density * delta DESC, nhd IS NULL DESC, id)::INT AS label FROM stats ORDER BY label LIMIT {CLUSTERS}),
 lab(id, label) AS (SELECT id, label FROM peaks UNION ALL SELECT s.id, lab.label FROM stats s JOIN lab ON s.nhd = lab.id WHERE s.id NOT IN (SELECT id FROM peaks))"""


@query("dp_density", _DP + " SELECT id, round(density, 6) AS density FROM dens")
def dp_density(spark, sf_dir):
    return density.density(_edges(spark, sf_dir)).select("id", r6("density").alias("density"))


@query("dp_delta", _DP + " SELECT id, nhd, round(delta, 6) AS delta FROM stats")
def dp_delta(spark, sf_dir):
    return _stats(spark, sf_dir).select("id", "nhd", r6("delta").alias("delta"))


@query("dp_exact_delta", _DP + " SELECT id, nhd, round(delta, 6) AS delta FROM stats")
def dp_exact_delta(spark, sf_dir):
    """All points against all denser ones; with an exact graph the same as dp_delta."""
    return _stats(spark, sf_dir, exact=True).select("id", "nhd", r6("delta").alias("delta"))


@query("dp_neighborhood_peaks", _DP + " SELECT id, round(density, 6) AS density FROM lone")
def dp_neighborhood_peaks(spark, sf_dir):
    return _stats(spark, sf_dir).where("is_peak").select("id", r6("density").alias("density"))


@query("dp_peak_portion", _DP + """ SELECT n.src AS id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM lone o JOIN v x ON x.id = o.id JOIN v y ON y.id = n.dst WHERE o.id <> n.src AND list_distance(x.e, y.e) < n.dist) THEN 0.0 ELSE 1.0 END), 6) AS portion FROM near n JOIN lone p ON p.id = n.src GROUP BY n.src""")
def dp_peak_portion(spark, sf_dir):
    pts = knn.points(_embeddings(spark, sf_dir), "id", "value")
    edges = knn.brute(pts, K)
    local = density.statistics(edges, pts).where("is_peak").select("id")
    return density.nearest_peak_portion(edges, local, pts).select("id", r6("portion").alias("portion"))


@query("dp_gamma_topk", _DP + " SELECT p.id, p.label, round(s.density * s.delta, 6) AS gamma FROM peaks p JOIN stats s ON s.id = p.id")
def dp_gamma_topk(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    return density.select_peaks(stats, CLUSTERS).join(stats, "id").select("id", "label", r6("gamma").alias("gamma"))


def _model(spark, sf_dir):
    return DensityPeaks(n_clusters=CLUSTERS, k=K, method="brutef").fit(_embeddings(spark, sf_dir))


@query("dp_labels", _DP + " SELECT id, label FROM lab")
def dp_labels(spark, sf_dir):
    return _model(spark, sf_dir).labels


@query("dp_cluster_sizes", _DP + " SELECT label, count(*) AS n FROM lab GROUP BY label")
def dp_cluster_sizes(spark, sf_dir):
    return _model(spark, sf_dir).labels.groupBy("label").agg(F.count("*").alias("n"))


@query("dp_ari", _DP + """, c AS (SELECT l.label AS l1, v.label AS l2, count(*)::DOUBLE AS n FROM lab l JOIN v ON v.id = l.id GROUP BY 1, 2),
 t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS together FROM c), a AS (SELECT sum(x * (x - 1) / 2) AS s FROM (SELECT sum(n) AS x FROM c GROUP BY l1)), b AS (SELECT sum(x * (x - 1) / 2) AS s FROM (SELECT sum(n) AS x FROM c GROUP BY l2))
 SELECT round((together - a.s * b.s / (t * (t - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (t * (t - 1) / 2)), 6) AS ari FROM t, a, b""")
def dp_ari(spark, sf_dir):
    both = _model(spark, sf_dir).labels.select("id", F.col("label").alias("l1")).join(_embeddings(spark, sf_dir).select("id", F.col("label").alias("l2")), "id")
    return validity.indices(validity.contingency(both, "l1", "l2")).select(r6("ari").alias("ari"))


# Validity indices of two labelings of the documents, and of the parts

_CELLS = "c AS (SELECT lang AS l1, source AS l2, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, sum(n) OVER (PARTITION BY l1) AS a, sum(n) OVER (PARTITION BY l2) AS b, sum(n) OVER () AS t FROM c)"
_PAIRS = f"WITH {_CELLS}, p AS (SELECT max(t) AS t, sum(n * (n - 1) / 2) AS n11, sum(n * (a - 1) / 2) AS sa, sum(n * (b - 1) / 2) AS sb FROM f)"
_ENT = f"WITH {_CELLS}, e AS (SELECT sum(-n / t * log2(a / t)) AS h1, sum(-n / t * log2(b / t)) AS h2, sum(n / t * log2(n * t / (a * b))) AS mi FROM f)"
_INDEX_SQL = {
    "ri": _PAIRS + " SELECT round((t * (t - 1) / 2 + 2 * n11 - sa - sb) / (t * (t - 1) / 2), 6) AS ri FROM p",
    "ari": _PAIRS + " SELECT round((n11 - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM p",
    "jaccard": _PAIRS + " SELECT round(n11 / (sa + sb - n11), 6) AS jaccard FROM p",
    "fm": _PAIRS + " SELECT round(n11 / sqrt(sa * sb), 6) AS fm FROM p",
    "nmi": _ENT + " SELECT round(2 * mi / (h1 + h2), 6) AS nmi FROM e",
    "nvi": _ENT + " SELECT round((h1 + h2 - 2 * mi) / (h1 + h2), 6) AS nvi FROM e",
    "mi": _ENT + " SELECT round(mi, 6) AS mi FROM e",
    "vi": _ENT + " SELECT round(h1 + h2 - 2 * mi, 6) AS vi FROM e",
    "nvd": f"WITH {_CELLS} SELECT round((2 * max(t) - (SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY l1)) - (SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY l2))) / (2 * max(t)), 6) AS nvd FROM f",
    "purity": f"WITH {_CELLS} SELECT round((SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY l1)) / max(t), 6) AS purity FROM f",
    "ci_part": f"WITH {_CELLS}, x AS (SELECT l2 FROM (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY n DESC, l2) AS r FROM c) WHERE r = 1), y AS (SELECT l1 FROM (SELECT *, row_number() OVER (PARTITION BY l2 ORDER BY n DESC, l1) AS r FROM c) WHERE r = 1) SELECT greatest((SELECT count(DISTINCT l2) FROM c) - (SELECT count(DISTINCT l2) FROM x), (SELECT count(DISTINCT l1) FROM c) - (SELECT count(DISTINCT l1) FROM y)) AS ci_part FROM (SELECT 1)",
}


def _validity(index: str):
    def run(spark, sf_dir):
        row = validity.indices(validity.contingency(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source"))
        return row.select((F.col(index) if index == "ci_part" else r6(index)).alias(index))

    return run


for _index, _sql in _INDEX_SQL.items():
    query(f"evi_{_index}", _sql)(_validity(_index))


@query("contingency", "SELECT p_brand AS l1, p_type AS l2, count(*) AS n FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY 1, 2")
def contingency(spark, sf_dir):
    return validity.contingency(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("contingency_margins", "SELECT p_brand AS l1, p_type AS l2, count(*)::BIGINT AS n FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY CUBE (p_brand, p_type)")
def contingency_margins(spark, sf_dir):
    return validity.margins(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("criterion_h", """WITH RECURSIVE c AS (SELECT lang AS l1, source AS l2, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (ORDER BY n DESC, l1, l2) AS r FROM c),
 g(r, u1, u2, m) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], 0::DOUBLE UNION ALL
  SELECT o.r, CASE WHEN list_contains(u1, l1) OR list_contains(u2, l2) THEN u1 ELSE list_append(u1, l1) END, CASE WHEN list_contains(u1, l1) OR list_contains(u2, l2) THEN u2 ELSE list_append(u2, l2) END, CASE WHEN list_contains(u1, l1) OR list_contains(u2, l2) THEN m ELSE m + n END FROM g JOIN o ON o.r = g.r + 1)
 SELECT round(1 - max(m) / (SELECT sum(n) FROM c), 6) AS ch FROM g""")
def criterion_h(spark, sf_dir):
    value = validity.criterion_h(validity.contingency(table(spark, sf_dir, "documents"), "lang", "source"))
    return spark.createDataFrame([(round(value, 6),)], "ch double")


@query("matched_sizes", f"WITH {_CELLS}, s1 AS (SELECT l1, sum(n)::BIGINT AS size1 FROM c GROUP BY 1), s2 AS (SELECT l2, sum(n)::BIGINT AS size2 FROM c GROUP BY 1), m AS (SELECT l1, l2 FROM (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY n DESC, l2 DESC) AS r FROM c) WHERE r = 1), j AS (SELECT m.l1, m.l2, size1 FROM m JOIN s1 ON s1.l1 = m.l1) SELECT j.l1, coalesce(j.l2, s2.l2) AS l2, size1, size2 FROM j FULL JOIN s2 ON s2.l2 = j.l2")
def matched_sizes(spark, sf_dir):
    return quantize.matched_sizes(validity.contingency(table(spark, sf_dir, "documents"), "lang", "source"))


# Codebooks: the clusters are the embeddings' labels


def _training(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _embeddings(spark, sf_dir)
    return e.select("id", F.col("value").alias("vector")), e.select("id", F.col("label").alias("cluster"))


_BOOK = f"{_V}, parts AS (SELECT id, label, unnest(e) AS x, unnest(range(len(e))) AS dim FROM v), means AS (SELECT label, dim, avg(x) AS m FROM parts GROUP BY ALL), book AS (SELECT label AS code, list(m ORDER BY dim) AS c FROM means GROUP BY label)"
_ERRORS = _BOOK + ", err AS (SELECT v.id, v.label, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS error FROM v JOIN book ON code = label)"


@query("cluster_centroids", f"WITH {_BOOK} SELECT label AS cluster, dim::INT AS dim, round(m, 6) AS value FROM means")
def cluster_centroids(spark, sf_dir):
    return quantize.cluster_dimensions(*_training(spark, sf_dir)).select("cluster", "dim", r6("value").alias("value"))


@query("global_centroid", f"WITH {_BOOK} SELECT dim::INT AS dim, round(avg(x), 6) AS value FROM parts GROUP BY dim")
def global_centroid(spark, sf_dir):
    return quantize.global_centroid(_training(spark, sf_dir)[0]).select("dim", r6("value").alias("value"))


@query("nearest_centroid", f"WITH {_BOOK} SELECT id, code, round(dist, 6) AS error FROM (SELECT v.id, code, pow(list_distance(e, c), 2) AS dist, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(e, c), code) AS r FROM v, book) WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.nearest_code(data, quantize.centroids(data, part)).select("id", "code", r6("error").alias("error"))


@query("cluster_mse", f"WITH {_ERRORS} SELECT label AS cluster, count(*) AS members, round(sum(error), 6) AS error, round(avg(error), 6) AS mean_error FROM err GROUP BY label")
def cluster_mse(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    errors = quantize.point_errors(data, part, quantize.centroids(data, part))
    return quantize.cluster_errors(errors).select("cluster", "members", r6("error").alias("error"), r6("mean_error").alias("mean_error"))


@query("average_error", f"WITH {_ERRORS} SELECT round(avg(error) / 64, 8) AS average_error FROM err")
def average_error(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.average_error(quantize.point_errors(data, part, quantize.centroids(data, part)), 64).select(F.round("average_error", 8).alias("average_error"))


@query("worst_points", f"WITH {_ERRORS} SELECT label AS cluster, id, round(error, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY error DESC, id) AS r FROM err) WHERE r = 1")
def worst_points(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.worst_points(quantize.point_errors(data, part, quantize.centroids(data, part))).select("cluster", "id", r6("error").alias("error"))


@query("single_link", f"WITH {_V} SELECT c1, c2, round(dist, 6) AS dist, id1, id2 FROM (SELECT a.label AS c1, b.label AS c2, list_distance(a.e, b.e) AS dist, a.id AS id1, b.id AS id2, row_number() OVER (PARTITION BY a.label, b.label ORDER BY list_distance(a.e, b.e), a.id, b.id) AS r FROM v a JOIN v b ON a.label < b.label) WHERE r = 1")
def single_link(spark, sf_dir):
    return quantize.single_link(*_training(spark, sf_dir)).select("c1", "c2", r6("dist").alias("dist"), "id1", "id2")


@query("nearest_in_cluster", f"WITH {_V} SELECT id, nearest, round(dist, 6) AS dist FROM (SELECT a.id, b.id AS nearest, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS r FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id) WHERE r = 1")
def nearest_in_cluster(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.nearest_in_cluster(data, part, data.select("id")).select("id", "nearest", r6("dist").alias("dist"))


@query("duplicates", "SELECT (count(*) - count(DISTINCT embedding))::BIGINT AS duplicates FROM embeddings")
def duplicates(spark, sf_dir):
    return quantize.duplicates(_training(spark, sf_dir)[0])


@query("unroll", "SELECT p_partkey AS id, p_size AS size, unnest(range(1, p_size + 1))::INT AS copy FROM part WHERE p_size > 0")
def unroll(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_size").alias("freq"))
    return quantize.unroll(parts)


@query("dim_stats", f"WITH {_BOOK} SELECT dim::INT AS dim, round(avg(x), 6) AS mean, round(min(x), 6) AS least, round(max(x), 6) AS most, count(DISTINCT x) AS n_unique FROM parts GROUP BY dim")
def dim_stats(spark, sf_dir):
    found = quantize.dimension_stats(_training(spark, sf_dir)[0])
    return found.select("dim", r6("mean").alias("mean"), r6("least").alias("least"), r6("most").alias("most"), "n_unique")


@query("dim_nth", f"WITH {_BOOK} SELECT dim::INT AS dim, round(x, 6) AS value FROM (SELECT dim, x, row_number() OVER (PARTITION BY dim ORDER BY x, id) AS r FROM parts) WHERE r = 101")
def dim_nth(spark, sf_dir):
    return quantize.dimension_nth(_training(spark, sf_dir)[0], 100).select("dim", r6("value").alias("value"))


@query("dim_unique", "SELECT DISTINCT embedding[1]::DOUBLE AS value FROM embeddings")
def dim_unique(spark, sf_dir):
    return quantize.unique_values(_training(spark, sf_dir)[0], 0)


_BOOK2 = _BOOK + ", means2 AS (SELECT id % 10 AS label, dim, avg(x) AS m FROM parts GROUP BY ALL), book2 AS (SELECT label AS code, list(m ORDER BY dim) AS c FROM means2 GROUP BY label)"
_MAPS = _BOOK2 + """, m12 AS (SELECT a, b FROM (SELECT x.code AS a, y.code AS b, row_number() OVER (PARTITION BY x.code ORDER BY list_distance(x.c, y.c), y.code) AS r FROM book x, book2 y) WHERE r = 1),
 m21 AS (SELECT a, b FROM (SELECT x.code AS a, y.code AS b, row_number() OVER (PARTITION BY x.code ORDER BY list_distance(x.c, y.c), y.code) AS r FROM book2 x, book y) WHERE r = 1)"""


def _two_books(spark, sf_dir):
    """Centroids of the labels, and of the ids' last digits."""
    data, part = _training(spark, sf_dir)
    other = data.select("id", F.pmod("id", F.lit(10)).cast("int").alias("cluster"))
    return data, quantize.centroids(data, part), quantize.centroids(data, other)


@query("centroid_index", f"WITH {_MAPS} SELECT greatest((SELECT count(*) FROM book2) - (SELECT count(DISTINCT b) FROM m12), (SELECT count(*) FROM book) - (SELECT count(DISTINCT b) FROM m21)) AS ci")
def centroid_index(spark, sf_dir):
    _, a, b = _two_books(spark, sf_dir)
    return quantize.centroid_index(a, b)


@query("ci_star", f"""WITH {_MAPS}, p1 AS (SELECT id, code FROM (SELECT v.id, code, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(e, c), code) AS r FROM v, book) WHERE r = 1), p2 AS (SELECT id, code FROM (SELECT v.id, code, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(e, c), code) AS r FROM v, book2) WHERE r = 1),
 cells AS (SELECT p1.code AS l1, p2.code AS l2, count(*) AS n FROM p1 JOIN p2 ON p1.id = p2.id GROUP BY 1, 2),
 s12 AS (SELECT coalesce(sum(n), 0) AS s FROM (SELECT m.b, max(coalesce(n, 0)) AS n FROM m12 m LEFT JOIN cells ON l1 = m.a AND l2 = m.b GROUP BY m.b)), s21 AS (SELECT coalesce(sum(n), 0) AS s FROM (SELECT m.b, max(coalesce(n, 0)) AS n FROM m21 m LEFT JOIN cells ON l2 = m.a AND l1 = m.b GROUP BY m.b))
 SELECT round((s12.s + s21.s) / 2.0 / (SELECT count(*) FROM v), 6) AS ci_star FROM s12, s21""")
def ci_star(spark, sf_dir):
    data, a, b = _two_books(spark, sf_dir)
    return quantize.centroid_index_star(data, a, b).select(r6("ci_star").alias("ci_star"))


@query("codebook_gap", f"WITH {_MAPS} SELECT round(sum(g), 6) AS gap, count(CASE WHEN g = 0 THEN 1 END) AS matches FROM (SELECT list_sum(list_transform(list_zip(x.c, y.c), lambda p: abs(p[1] - p[2]))) AS g FROM m12 JOIN book x ON x.code = a JOIN book2 y ON y.code = b)")
def codebook_gap(spark, sf_dir):
    _, a, b = _two_books(spark, sf_dir)
    return quantize.codebook_gap(a, b).select(r6("gap").alias("gap"), "matches")


@query("join_clusters", "SELECT vec_id AS id, CASE WHEN label = 7 THEN 2 WHEN label = (SELECT max(label) FROM embeddings) THEN 7 ELSE label END AS cluster FROM embeddings")
def join_clusters(spark, sf_dir):
    return quantize.join_clusters(_training(spark, sf_dir)[1], 2, 7)


@query("fill_empty", f"WITH {_ERRORS}, w AS (SELECT id, row_number() OVER (ORDER BY error DESC, id) AS r FROM err), n AS (SELECT c, row_number() OVER (ORDER BY c) AS r FROM range(1, 13) t(c) WHERE c NOT IN (SELECT label FROM v)) SELECT v.id, coalesce(n.c, v.label)::INT AS cluster FROM v LEFT JOIN w ON w.id = v.id LEFT JOIN n ON n.r = w.r")
def fill_empty(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.fill_empty(data, part, quantize.centroids(data, part), 12)


@query("repartition_cluster", f"WITH {_BOOK}, b AS (SELECT id, code FROM (SELECT v.id, code, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(e, c), code) AS r FROM v, book) WHERE r = 1) SELECT v.id, CASE WHEN v.label = 3 THEN b.code ELSE v.label END AS cluster FROM v JOIN b ON b.id = v.id")
def repartition_cluster(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.repartition_cluster(data, part, quantize.centroids(data, part), 3)


@query("gabriel_neighbours", f"WITH {_BOOK}, m AS (SELECT x.code AS c1, y.code AS c2, list_transform(list_zip(x.c, y.c), lambda p: (p[1] + p[2]) / 2) AS h FROM book x JOIN book y ON x.code < y.code) SELECT c1, c2 FROM (SELECT c1, c2, b.code, row_number() OVER (PARTITION BY c1, c2 ORDER BY round(pow(list_distance(h, b.c), 2), 9), b.code) AS r FROM m, book b) WHERE r = 1 AND code IN (c1, c2)")
def gabriel_neighbours(spark, sf_dir):
    data, part = _training(spark, sf_dir)
    return quantize.gabriel_neighbours(quantize.centroids(data, part))


# Sorts, samples, files


@query("topk_overall", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_overall(spark, sf_dir):
    return ranking.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 50, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("topk_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    found = ranking.top_per_group(table(spark, sf_dir, "lineitem"), 3, "l_suppkey", F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"))
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("sample_per_cluster", "SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat('1:', vec_id::VARCHAR)), vec_id)::INT AS rank FROM embeddings) WHERE rank <= 20")
def sample_per_cluster(spark, sf_dir):
    return ranking.sample_per_group(table(spark, sf_dir, "embeddings"), 20, "label", "vec_id").select("label", "vec_id", "rank")


@query("sample_rows", "SELECT c_custkey, c_name FROM customer ORDER BY md5(concat('1:', c_custkey::VARCHAR)), c_custkey LIMIT 40")
def sample_rows(spark, sf_dir):
    return ranking.sample(table(spark, sf_dir, "customer"), 40, "c_custkey").select("c_custkey", "c_name")


@query("viewer_samples", "WITH r AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('1:', doc_id::VARCHAR)), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS size FROM documents WHERE lang IS NOT NULL) SELECT lang AS label, max(size) AS size, md5(string_agg(text, '|' ORDER BY rank)) AS digest FROM r WHERE rank <= 20 GROUP BY lang")
def viewer_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = viewer.cluster_samples(docs.select(F.col("doc_id").alias("id"), "text"), docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")))
    return found.select("label", "size", F.md5(F.concat_ws("|", "samples")).alias("digest"))


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"


@query("roundtrip_partition", "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS id, label + 1 AS label FROM embeddings")
def roundtrip_partition(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).alias("label"))
    path = _folder(spark, "labels")
    lines.write_partition(labels, path, labels.agg(F.max("label")).first()[0])
    return lines.read_partition(spark, path)


@query("roundtrip_vectors", "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS id, round(embedding[1]::DOUBLE, 6) AS x0, round(embedding[64]::DOUBLE, 6) AS x63, len(embedding)::INT AS dim FROM embeddings")
def roundtrip_vectors(spark, sf_dir):
    path = _folder(spark, "vectors")
    lines.write_vectors(_embeddings(spark, sf_dir), path, 6, value_col="value")
    return lines.read_vectors(spark, path).select("id", F.col("features")[0].alias("x0"), F.col("features")[63].alias("x63"), F.size("features").alias("dim"))


@query("roundtrip_knn_text", f"WITH {_L2} SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM near")
def roundtrip_knn_text(spark, sf_dir):
    path = _folder(spark, "graph")
    lines.write_knn_text(_edges(spark, sf_dir), path)
    return lines.read_knn_text(spark, path).select("src", "dst", "dist", F.col("rank").cast("int").alias("rank"))


@query("generate_worms")
def generate_worms(spark, sf_dir):
    return generators.worms_2d(spark, 8).groupBy("label", "component").agg(F.count("*").alias("n"))
