"""Round trips and malformed inputs of the file formats; the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from summitry.plans import cli, model
from summitry.sources import binary, generators, lines, viewer


def put(path, text):
    path.write_text(text)
    return str(path)


def test_vectors(spark, tmp_path):
    good = lines.read_vectors(spark, put(tmp_path / "a.txt", "1 2.5\t3 \n 4 5 6\n"))
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(0, [1, 2.5, 3]), (1, [4, 5, 6])]
    bad = put(tmp_path / "b.txt", "1 2\n3\n4 5\n")
    with pytest.raises(ValueError):
        lines.read_vectors(spark, bad)
    kept, dropped = lines.read_vectors_permissive(spark, bad)
    assert kept.count() == 2 and dropped == 1
    with pytest.raises(ValueError):
        lines.read_vectors(spark, put(tmp_path / "c.txt", ""))


def test_sets(spark, tmp_path):
    sets = lines.read_sets(spark, put(tmp_path / "s.txt", "B  A\nA C\n\n"))
    assert [r["items"] for r in sets.orderBy("id").collect()] == [["B", "A"], ["A", "C"], []]
    assert [r["items"] for r in lines.encode_items(sets).orderBy("id").collect()] == [[0, 1], [1, 2], []]


def test_line_numbers_over_partitions(spark, tmp_path):
    path = put(tmp_path / "n.txt", "".join(f"{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert lines.numbered(spark, path).where("line <> cast(value as long)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_partition_checks(spark, tmp_path):
    path = put(tmp_path / "x.pa", "VQ PARTITIONING 2.0\n2\n3\nMade\n-------------------------------------\n1\n2\n1\n")
    assert [r.label for r in lines.read_partition(spark, path).orderBy("id").collect()] == [1, 2, 1]
    assert lines.read_labels_for_view(spark, path)[1] == 2
    assert lines.file_type(spark, str(tmp_path / "x")) == "PA"
    with pytest.raises(ValueError):
        lines.read_partition(spark, path, 4)
    with pytest.raises(ValueError):
        lines.read_partition(spark, put(tmp_path / "y.pa", "VQ PARTITIONING 2.0\n2\n1\n-----\n3\n"))


def test_graphs(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 0.5, 1), (0, 2, 1.5, 2), (1, 0, 0.5, 1), (1, 2, 2.0, 2), (2, 0, 1.5, 1), (2, 1, 2.0, 2)], "src long, dst long, dist double, rank int")
    lines.write_knn_text(edges, str(tmp_path / "t"))
    assert lines.read_knn_text(spark, str(tmp_path / "t")).select("src", "dst", "dist").exceptAll(edges.select("src", "dst", "dist")).count() == 0
    binary.write_ivec(edges, str(tmp_path / "g.ivec"))
    assert binary.read_ivec(spark, str(tmp_path / "g.ivec")).select("src", "dst", "rank").exceptAll(edges.select("src", "dst", "rank")).count() == 0
    nodes = spark.createDataFrame([(i, [i, -i]) for i in range(3)], "index long, data array<int>")
    lines.write_graph(nodes, edges, str(tmp_path / "l"))
    n, e, info = lines.read_graph(spark, str(tmp_path / "l"))
    assert info == {"nvec": 3, "k": 2, "dim": 2} and n.count() == 3 and e.select("src", "dst", "rank").exceptAll(edges.select("src", "dst", "rank")).count() == 0
    texts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, text string")
    lines.write_string_graph(edges, texts, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first().value == "a: b(0.5000), c(1.5000), "


def test_binary_vectors(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.5, 4.5])], "id long, features array<double>")
    binary.write_lshkit(df, str(tmp_path / "m"))
    assert binary.read_lshkit(spark, str(tmp_path / "m")).orderBy("id").collect() == df.orderBy("id").collect()
    assert binary.bits(b"\x80").tolist() == [1, 0, 0, 0, 0, 0, 0, 0] and binary.bit_value(np.array([0, 1, 1])) == 6


@pytest.mark.parametrize("low,high", [(0, 200), (0, 60000), (-70000, 70000)])
def test_codebook(spark, tmp_path, low, high):
    rows = [(0, "one", [low, high], 3), (1, None, [1, 2], 1)]
    nodes = spark.createDataFrame(rows, binary.NODE)
    binary.write_codebook(nodes, str(tmp_path / "b.cb"), method="made")
    assert [tuple(r) for r in binary.read_codebook(spark, str(tmp_path / "b.cb")).orderBy("idx").collect()] == rows
    assert lines.file_type(spark, str(tmp_path / "b.cb")) == "CB"


def test_old_codebook(spark, tmp_path):
    head = b"VQ CODEBOOK 1.0\n2\n1\n1\n0\n0\n0\n0\n255\nold\n-----\n"
    (tmp_path / "o.cb").write_bytes(head + bytes([7, 9]) + bytes([5, 1]))
    assert [tuple(r) for r in binary.read_codebook(spark, str(tmp_path / "o.cb")).collect()] == [(0, None, [7, 9], 261)]


def test_generators(spark):
    flat = generators.worms_2d(spark, 4, seed=3)
    assert flat.select(F.min(F.array_min("features"))).first()[0] == 0 and flat.select("label").distinct().count() >= 1
    deep = generators.worms_high_dim(spark, 2, 8)
    assert deep.groupBy("label").count().agg(F.min("count"), F.max("count")).first() == (4200, 4200)
    assert generators.gaussian(spark, 9, 3).count() == 9
    assert generators.uniform(spark, 9, 2, 5, 6).where("features[0] < 5 or features[1] >= 6").count() == 0


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(30 * c, 1, (30, 2)) for c in range(3)])
    data = put(tmp_path / "d.txt", "".join(f"{a} {b}\n" for a, b in x))
    truth = put(tmp_path / "t.pa", "VQ PARTITIONING 2.0\n3\n90\n-----\n" + "".join(f"{i // 30 + 1}\n" for i in range(90)))
    out = cli.main(["cluster", data, "--type", "vec", "--clusters", "3", "-k", "6", "--algo", "brutef", "--gt-pa", truth, "--out-pa", str(tmp_path / "o"), "--out-dd", str(tmp_path / "s"), "--calcnbprop"], spark)
    assert out["ari"] == pytest.approx(1) and 0 <= out["nearest_peak_portion"] <= 1
    assert spark.read.text(str(tmp_path / "s")).count() == 90
    assert lines.read_partition(spark, str(tmp_path / "o"), 90).count() == 90
    cli.main(["graph", data, "--type", "vec", "-k", "4", "--algo", "brutef", "--outf", "ivec", "-o", str(tmp_path / "g")], spark)
    assert cli.main(["graph", data, "--type", "vec", "-k", "4", "--algo", "brutef", "--gt", str(tmp_path / "g")], spark)["recall"] == 1
    assert model.evaluate_files(spark, [truth, truth], "nmi") == pytest.approx(1)
    with pytest.raises(ValueError):
        model.evaluate_files(spark, [truth, truth], "ci")


def test_evaluate_codebooks(spark, tmp_path):
    data = spark.createDataFrame([(i, None, [i % 2 * 100 + i, 5], 1) for i in range(10)], binary.NODE)
    book = spark.createDataFrame([(0, None, [4, 5], 1), (1, None, [105, 5], 1)], binary.NODE)
    binary.write_codebook(data, str(tmp_path / "d.ts"), training_set=True)
    binary.write_codebook(book, str(tmp_path / "b.cb"))
    files = [str(tmp_path / f) for f in ("d.ts", "b.cb", "b.cb")]
    assert model.evaluate_files(spark, files[1:], "ci") == 0
    assert model.evaluate_files(spark, files, "ci_star") == 1
    assert model.evaluate_files(spark, files, "ari") == pytest.approx(1)


def test_viewer(spark):
    texts = spark.createDataFrame([(i, f"<{i}>") for i in range(30)], "id long, text string")
    labels = spark.createDataFrame([(i, 1 + i % 30 // 25) for i in range(30)], "id long, label int")
    page = viewer.page(viewer.cluster_samples(texts, labels))
    assert page.count("<li>") == 25 and "&lt;" in page and "(size=25)" in page


def test_lines_of_many_files(spark, tmp_path):
    """Small files share partitions; their lines are numbered in path order."""
    folder = tmp_path / "many"
    folder.mkdir()
    wanted = []
    for i in range(60):
        some = [f"{i}-{j}" for j in range(i % 4 + (i == 7) * 50)]
        (folder / f"part-{i:05d}.txt").write_text("".join(x + "\n" for x in some))
        wanted += some
    got = {r.line: r.value for r in lines.numbered(spark, str(folder)).collect()}
    assert got == dict(enumerate(wanted))
