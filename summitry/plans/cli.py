"""Command line: cluster, graph and evaluate files.

    python -m summitry.plans.cli cluster DATA --type vec --clusters 15 --neighbors 30 --out-pa labels.pa
    python -m summitry.plans.cli graph DATA --type txt -k 20 --algo rpdiv --outf txt -o graph
    python -m summitry.plans.cli evaluate a.pa b.pa --index ari
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..operators import knn, validity
from ..sources import binary, lines
from . import model


def load(spark: SparkSession, path: str, kind: str, fmt: str = "ascii") -> tuple[DataFrame, str]:
    if kind == "vec":
        return (binary.read_lshkit if fmt == "lshkit" else lines.read_vectors)(spark, path), "features"
    return (lines.read_strings(spark, path), "text") if kind == "txt" else (lines.read_sets(spark, path), "items")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="summitry", description="density peaks clustering")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("cluster", "graph"):
        c = sub.add_parser(name)
        c.add_argument("data")
        c.add_argument("--type", choices=("vec", "txt", "set"), required=True)
        c.add_argument("--format", choices=("ascii", "lshkit"), default="ascii")
        c.add_argument("--neighbors", "-k", type=int, default=20)
        c.add_argument("--bfsize", "-W", type=int)
        c.add_argument("--num-iter", "-I", type=int, default=100)
        c.add_argument("--dfunc", choices=("l2", "l1", "mnkw", "cos", "lev", "dice"))
        c.add_argument("--distpar", type=float, default=1.0)
        c.add_argument("--algo", "--knng-algo", choices=("rpdiv", "nndes", "brutef"), default="rpdiv")
        c.add_argument("--delta", "--knng-delta", type=float, default=0.01)
        c.add_argument("--nndes", "--knng-nndes", type=float, default=0.1 if name == "cluster" else 0.0)
        c.add_argument("--seed", type=int, default=1)
    c = sub.choices["cluster"]
    c.add_argument("--clusters", type=int, default=256)
    c.add_argument("--calcnbprop", action="store_true")
    c.add_argument("--exact", action="store_true")
    c.add_argument("--out-pa")
    c.add_argument("--pa-no-header", action="store_true")
    c.add_argument("--out-dd")
    c.add_argument("--out-cb")
    c.add_argument("--gt-pa")
    g = sub.choices["graph"]
    g.add_argument("--outf", choices=("txt", "ivec", "wgraph"), default="txt")
    g.add_argument("-o", "--out")
    g.add_argument("--gt")
    e = sub.add_parser("evaluate")
    e.add_argument("files", nargs="+")
    e.add_argument("--index", choices=(*validity.ALL, "ch", "ci", "ci_star"), default="ci")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "evaluate":
        out = {a.index: model.evaluate_files(spark, a.files, a.index)}
        print(*(f"{k} {v}" for k, v in out.items()), sep="\n")
        return out
    df, value = load(spark, a.data, a.type, a.format)
    distance = a.dfunc or {"vec": "l2", "txt": "lev", "set": "set"}[a.type]
    method = {"nndes": "nndescent"}.get(a.algo, a.algo)
    if a.command == "graph":
        options = {"distance": distance, "value_col": value, "p": a.distpar}
        if method != "brutef":
            options |= {"leaf_size": a.bfsize, "max_iter": a.num_iter, "tol": a.delta, "nnd_start": a.nndes, "seed": a.seed}
        edges = knn.build(df, a.neighbors, method, **options)
        out = {}
        if a.gt:
            truth = knn.recompute(binary.read_ivec(spark, a.gt), df, distance, value_col=value, p=a.distpar)
            out = knn.recall(edges, truth, a.neighbors).first().asDict()
        if a.out and a.outf == "txt":
            lines.write_knn_text(edges, a.out)
        elif a.out and a.outf == "ivec":
            binary.write_ivec(edges, a.out)
        elif a.out:
            lines.write_string_graph(edges, df, a.out)
    else:
        options = model.DensityPeaks(a.clusters, a.neighbors, method, distance, a.distpar, a.bfsize, a.num_iter, a.delta, a.nndes, a.seed, a.exact)
        fitted = options.fit(df, value_col=value)
        out = fitted.evaluate(lines.read_partition(spark, a.gt_pa)) if a.gt_pa else {}
        if a.calcnbprop:
            out["nearest_peak_portion"] = fitted.nearest_peak_portion()
        if a.out_pa:
            lines.write_partition(fitted.labels, a.out_pa, a.clusters, header=not a.pa_no_header)
        if a.out_dd:
            lines.write_statistics(fitted.stats, a.out_dd)
        if a.out_cb:
            fitted.centroids().write.parquet(a.out_cb)
    print(*(f"{k} {v}" for k, v in out.items()), sep="\n")
    return out


if __name__ == "__main__":
    main()
