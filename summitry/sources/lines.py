"""Text sources: one object a line, with line numbers as ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut

# The beginnings of files, and the rule under a header.
TRAINING_SET, CODEBOOK, PARTITIONING = "VQ TRAINING SET", "VQ CODEBOOK", "VQ PARTITIONING"
FORMAT_VERSION = "2.0"
RULE = "-------------------------------------"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with line numbers from 0, files in path order, counted without moving rows.

    The lines of every block of a file are counted, and the counts' prefix sums (a row
    for each block) are its first line number.  A partition may hold several blocks;
    each one's lines stand together in it.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("mid"))
    block = ["file_path", "file_block_start"]
    rows, base = [], 0
    for r in raw.groupBy(*block).agg(F.count("*").alias("n"), F.min("mid").alias("first")).orderBy(*block).collect():
        rows.append((r["file_path"], r["file_block_start"], base - r["first"]))
        base += r["n"]
    shifts = spark.createDataFrame(rows, "file_path string, file_block_start long, shift long")
    return raw.join(F.broadcast(shifts), block).select((F.col("mid") + F.col("shift")).alias("line"), "value")


def _required(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no data")
    return df


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, features): white-space separated numbers; every line has as many as the first."""
    rows = numbered(spark, path).where("trim(value) <> ''")
    out = rows.select(F.col("line").alias("id"), F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x.cast("double")).alias("features"))
    first = _required(out, path).orderBy("id").first()
    bad = out.where((F.size("features") != len(first.features)) | F.exists("features", lambda x: x.isNull())).limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].id + 1} of {path} is not {len(first.features)} numbers")
    return out


def read_vectors_permissive(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Vectors of the first line's dimensionality, and how many lines had another."""
    rows = numbered(spark, path).where("trim(value) <> ''")
    out = rows.select(F.col("line").alias("id"), F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x.cast("double")).alias("features"))
    dim = len(_required(out, path).orderBy("id").first().features)
    fits = (F.size("features") == dim) & ~F.exists("features", lambda x: x.isNull())
    return out.where(fits), out.where(~fits).count()


def read_codebook_text(spark: SparkSession, path: str) -> DataFrame:
    """(idx, vector) of a text codebook: a vector a line, rounded to whole numbers."""
    return read_vectors(spark, path).select(F.col("id").alias("idx"), F.transform("features", lambda x: F.floor(x + 0.5).cast("int")).alias("vector"))


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark, path).select(F.col("line").alias("id"), F.col("value").alias("text"))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(id, items): blank-separated tokens, empty ones skipped."""
    return numbered(spark, path).select(F.col("line").alias("id"), F.filter(F.split("value", " "), lambda t: t != "").alias("items"))


def encode_items(sets: DataFrame) -> DataFrame:
    """Items as whole numbers, in the order in which they first occur."""
    parts = sets.select("id", F.posexplode("items").alias("pos", "item"))
    first = parts.groupBy("item").agg(F.min(F.struct("id", "pos")).alias("at"))
    codes = numbered_by(first, "at").select("item", F.col("n").cast("int").alias("code"))
    coded = parts.join(codes, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    return sets.select("id").join(coded, "id", "left").select("id", F.coalesce(F.transform("c", lambda x: x["code"]), F.array().cast("array<int>")).alias("items"))


def numbered_by(df: DataFrame, order: str) -> DataFrame:
    """Rows with their rank n from 0, by sorted partitions and prefix sums of their counts."""
    ranked = cut(df.orderBy(order).withColumn("mid", F.monotonically_increasing_id()).withColumn("part", F.shiftright("mid", 33)))
    counts = {r["part"]: r["count"] for r in ranked.groupBy("part").count().collect()}
    rows, base = [], 0
    for part in sorted(counts):
        rows.append((part, base))
        base += counts[part]
    bases = df.sparkSession.createDataFrame(rows, "part long, base long")
    return ranked.join(F.broadcast(bases), "part").withColumn("n", F.col("base") + F.expr("mid & ((1L << 33) - 1)")).drop("mid", "part", "base")


def _header(rows: DataFrame) -> tuple[list[str], int]:
    """Lines above the rule, and the rule's line number."""
    head = [r.value for r in rows.where("line < 20").orderBy("line").collect()]
    for i, value in enumerate(head[1:], 1):
        if value.startswith("----"):
            return head[:i], i
    return [], -1


def read_partition(spark: SparkSession, path: str, rows_expected: int | None = None) -> DataFrame:
    """(id, label) of a partition file; labels start at 1.  Files without a header hold labels only."""
    rows = numbered(spark, path)
    head, rule = _header(rows)
    out = rows.where(F.col("line") > rule).where("trim(value) <> ''").select((F.col("line") - rule - 1).alias("id"), F.split(F.trim("value"), r"\s+")[0].try_cast("int").alias("label"))
    if head:
        if not head[0].startswith(PARTITIONING):
            raise ValueError(f"{path} is no partition file")
        count, size = int(head[1]), int(head[2])
        if rows_expected is not None and size != rows_expected:
            raise ValueError(f"{path} is of {size} points, not {rows_expected}")
        if out.where((F.col("label") < 1) | (F.col("label") > count) | F.col("label").isNull()).limit(1).count():
            raise ValueError(f"{path} has labels outside 1..{count}")
    return out


def read_labels_for_view(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(id, label) and the number of clusters, for the cluster viewer."""
    head, _ = _header(numbered(spark, path))
    labels = read_partition(spark, path)
    return labels, int(head[1]) if head else labels.agg(F.max("label")).first()[0]


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes (index, data), edges (src, dst, rank) and header of a "Graph v." file."""
    rows = numbered(spark, path)
    head, rule = _header(rows)
    if not head or not head[0].startswith("Graph v."):
        raise ValueError(f"{path} is no graph file")
    info = {"nvec": int(head[1]), "k": int(head[2]), "dim": int(head[3])}
    numbers = rows.where(F.col("line") > rule).where("trim(value) <> ''").select((F.col("line") - rule - 1).alias("index"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int")).alias("x"))
    nodes = numbers.select("index", F.slice("x", 1, info["dim"]).alias("data"))
    edges = numbers.select(F.col("index").alias("src"), F.posexplode(F.slice("x", info["dim"] + 1, 1 << 30)).alias("rank", "dst"))
    return nodes, edges.select("src", F.col("dst").cast("long").alias("dst"), (F.col("rank") + 1).alias("rank")), info


def read_knn_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, rank, dst, dist) of "id K ids distances" lines under a line with their number."""
    rows = numbered(spark, path).where("line > 0 and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("x"))
    k = F.element_at("x", 2).cast("int")
    pairs = F.arrays_zip(F.slice("x", F.lit(3), k).alias("dst"), F.slice("x", k + 3, k).alias("dist"))
    return rows.select(F.col("x")[0].cast("long").alias("src"), F.posexplode(pairs).alias("rank", "p")).select("src", (F.col("rank") + 1).alias("rank"), F.col("p.dst").cast("long").alias("dst"), F.col("p.dist").cast("double").alias("dist"))


def file_type(spark: SparkSession, path: str, order: str = "123") -> str | None:
    """TS, CB or PA by a file's first line; without one, the file with an extension in ``order``."""
    kinds = {"1": ("TS", ".ts"), "2": ("CB", ".cb"), "3": ("PA", ".pa")}
    for candidate in [path, *(path + kinds[o][1] for o in order)]:
        try:
            first = spark.read.format("binaryFile").load(candidate).select(F.substring(F.decode(F.substring("content", 1, 64), "ISO-8859-1"), 1, 64).alias("h")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        for what, kind in ((CODEBOOK, "CB"), (TRAINING_SET, "TS"), (PARTITIONING, "PA")):
            if first and first.h.startswith(what):
                return kind
    return None


# Writers


def _write_lines(lines: DataFrame, path: str, single: bool, mode: str) -> None:
    """Writes (order columns..., value) sorted; part files are in order too."""
    keys = [c for c in lines.columns if c != "value"]
    ordered = lines.coalesce(1).sortWithinPartitions(*keys) if single else lines.orderBy(*keys)
    ordered.select("value").write.mode(mode).text(path)


def write_partition(labels: DataFrame, path: str, n_clusters: int, header: bool = True, method: str = "", names: DataFrame | None = None, single: bool = True, mode: str = "errorifexists") -> None:
    """A partition file: header, rule, and a label (with the name, if any) a line in id order."""
    value = F.col("label").cast("string")
    if names is not None:
        labels = labels.join(names.select("id", "name"), "id", "left")
        value = F.concat_ws(" ", value, "name")
    lines = labels.select(F.lit(1).alias("o"), "id", value.alias("value"))
    if header:
        head = [f"{PARTITIONING} {FORMAT_VERSION}", str(n_clusters), str(labels.count()), *([method] if method else []), RULE]
        lines = labels.sparkSession.createDataFrame([(0, i, v) for i, v in enumerate(head)], "o int, id long, value string").unionByName(lines)
    _write_lines(lines, path, single, mode)


def write_statistics(stats: DataFrame, path: str, single: bool = True, mode: str = "errorifexists") -> None:
    """``nhd density delta`` a line in id order; the densest point's pointer is -1."""
    _write_lines(stats.select("id", F.format_string("%d %f %f", F.coalesce("nhd", F.lit(-1)), "density", "delta").alias("value")), path, single, mode)


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("e"))


def write_knn_text(edges: DataFrame, path: str, single: bool = True, mode: str = "errorifexists") -> None:
    near = _neighbours(edges)
    ids = F.concat_ws(" ", F.transform("e", lambda x: x["dst"].cast("string")))
    dists = F.concat_ws(" ", F.transform("e", lambda x: F.format_string("%f", x["dist"])))
    lines = near.select(F.lit(1).alias("o"), "src", F.concat_ws(" ", F.col("src").cast("string"), F.size("e").cast("string"), ids, dists).alias("value"))
    head = near.agg(F.lit(0).alias("o"), F.lit(-1).cast("long").alias("src"), F.count("*").cast("string").alias("value"))
    _write_lines(head.unionByName(lines), path, single, mode)


def write_string_graph(edges: DataFrame, texts: DataFrame, path: str, single: bool = True, mode: str = "errorifexists") -> None:
    """``string: neighbour(dist), ...`` a line."""
    named = edges.join(texts.select(F.col("id").alias("dst"), F.col("text").alias("to")), "dst")
    near = named.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "to", "dist"))).alias("e")).join(texts.select(F.col("id").alias("src"), "text"), "src")
    parts = F.concat_ws("", F.transform("e", lambda x: F.format_string("%s(%.4f), ", x["to"], x["dist"])))
    _write_lines(near.select("src", F.concat(F.col("text"), F.lit(": "), parts).alias("value")), path, single, mode)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, header: bool = True, single: bool = True, mode: str = "errorifexists") -> None:
    """A "Graph v. 1" file, or its lines alone."""
    near = edges.groupBy(F.col("src").alias("index")).agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("e"))
    every = nodes.join(near, "index", "left")
    numbers = F.concat(F.transform("data", lambda x: x.cast("string")), F.coalesce(F.transform("e", lambda x: x["dst"].cast("string")), F.array().cast("array<string>")))
    lines = every.select(F.lit(1).alias("o"), "index", F.concat(F.concat_ws(" ", numbers), F.lit(" ")).alias("value"))
    if header:
        k = edges.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        shape = nodes.agg(F.count("*"), F.max(F.size("data"))).first()
        head = ["Graph v. 1", str(shape[0]), str(k), str(shape[1]), RULE]
        lines = nodes.sparkSession.createDataFrame([(0, i, v) for i, v in enumerate(head)], "o int, index long, value string").unionByName(lines.withColumn("index", F.col("index").cast("long")))
    _write_lines(lines, path, single, mode)


def write_list(df: DataFrame, id_col: str, value_col: str, path: str, single: bool = True, mode: str = "errorifexists") -> None:
    """One number a line."""
    kind = df.schema[value_col].dataType.simpleString()
    value = F.format_string("%f", F.col(value_col)) if kind in ("double", "float") else F.col(value_col).cast("string")
    _write_lines(df.select(F.col(id_col).alias("id"), value.alias("value")), path, single, mode)


def write_vectors(df: DataFrame, path: str, precision: int = 6, id_col: str = "id", value_col: str = "features", single: bool = True, mode: str = "errorifexists") -> None:
    value = F.concat_ws(" ", F.transform(value_col, lambda x: F.format_string(f"%.{precision}f", x.cast("double"))))
    _write_lines(df.select(F.col(id_col).alias("id"), value.alias("value")), path, single, mode)
