"""Binary sources: float matrices, neighbour-id vectors, codebooks.

A file is one row of Spark's binary source; its records are cut with numpy in the
task that holds it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import CODEBOOK, FORMAT_VERSION, RULE, TRAINING_SET

#: Records handed on at a time.
RUN = 10_000
NODE = "idx long, name string, vector array<int>, freq int"


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_lshkit(spark: SparkSession, path: str) -> DataFrame:
    """(id, features): three 32-bit integers (4, N, D), then N * D 32-bit floats."""

    def run(batches):
        for b in batches:
            for content in b.content:
                size, n, d = np.frombuffer(content, "<i4", 3)
                if size != 4 or len(content) < 12 + 4 * n * d:
                    raise ValueError("no matrix of 32-bit floats")
                x = np.frombuffer(content, "<f4", n * d, 12).reshape(n, d)
                for at in range(0, n, RUN):
                    yield pd.DataFrame({"id": np.arange(at, min(n, at + RUN)), "features": list(x[at : at + RUN].astype(float))})

    return _contents(spark, path).mapInPandas(run, "id long, features array<double>")


def write_lshkit(df: DataFrame, path: str, value_col: str = "features", id_col: str = "id") -> None:
    """Streams the vectors, in id order, into one local file."""
    n, d = df.agg(F.count("*"), F.max(F.size(value_col))).first()
    with open(path, "wb") as f:
        f.write(np.array([4, n, d or 0], "<i4").tobytes())
        for r in df.select(id_col, value_col).orderBy(id_col).toLocalIterator():
            f.write(np.array(r[1], "<f4").tobytes())


def read_ivec(spark: SparkSession, path: str) -> DataFrame:
    """(src, rank, dst): rows of 32-bit integers K + 1, id, K ids."""

    def run(batches):
        for b in batches:
            for content in b.content:
                x = np.frombuffer(content, "<i4")
                x = x.reshape(-1, x[0] + 1) if len(x) else x.reshape(0, 2)
                k = x.shape[1] - 2
                if len(x) and (x[:, 0] != x[0, 0]).any():
                    raise ValueError("rows of unlike length")
                for at in range(0, len(x), RUN):
                    part = x[at : at + RUN]
                    yield pd.DataFrame({"src": np.repeat(part[:, 1], k), "rank": np.tile(np.arange(1, k + 1), len(part)), "dst": part[:, 2:].ravel()})

    return _contents(spark, path).mapInPandas(run, "src long, rank int, dst long")


def write_ivec(edges: DataFrame, path: str) -> None:
    """Streams the neighbour lists, in source order, into one local file."""
    near = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("e")).select("src", F.transform("e", lambda x: x["dst"]).alias("ids"))
    k = near.agg(F.min(F.size("ids"))).first()[0] or 0
    with open(path, "wb") as f:
        for r in near.orderBy("src").toLocalIterator():
            f.write(np.array([k + 1, r.src, *r.ids[:k]], "<i4").tobytes())


def integers(content: bytes, width: int, big: bool, signed: bool = False) -> np.ndarray:
    """Whole numbers of 1 to 4 bytes each."""
    raw = np.frombuffer(content, np.uint8).reshape(-1, width).astype(np.int64)
    if not big:
        raw = raw[:, ::-1]
    value = (raw << (8 * np.arange(width - 1, -1, -1))).sum(1)
    return np.where(value >= 1 << (8 * width - 1), value - (1 << (8 * width)), value) if signed else value


def parse_header(content: bytes) -> tuple[dict, int]:
    """A codebook's header and where its vectors begin."""
    end = re.search(rb"\n-+\n", content)
    lines = content[: end.start()].decode("latin-1").split("\n") if end else []
    number = re.search(r"\d", lines[0]) if lines else None
    if number is None or not lines[0].startswith((CODEBOOK, TRAINING_SET)):
        raise ValueError("no codebook or training set")
    version = int(number[0])
    if version > 2:
        raise ValueError(f"file version {version}")
    x = [int(v) for v in lines[1:9]]
    if version == 2:
        info = {"version": 2, "block_x": x[0], "block_y": x[1], "size": x[2], "total_freq": x[3], "bytes": x[4], "min": x[5], "max": x[6], "method": lines[9] if len(lines) > 9 else ""}
    else:
        info = {"version": version, "block_x": x[0], "block_y": x[1], "size": x[2], "total_freq": 0, "bytes": 1, "min": 0, "max": x[7], "method": lines[9] if len(lines) > 9 else ""}
    return info | {"dim": info["block_x"] * info["block_y"]}, end.end()


def parse_nodes(content: bytes):
    """(idx, name, vector, freq) of every vector."""
    info, at = parse_header(content)
    new, d, width = info["version"] == 2, info["dim"], info["bytes"]
    tail = 4 if new else 2
    for i in range(info["size"]):
        name = None
        if new:
            stop = content.index(b"\0", at)
            name, at = content[at:stop].decode("latin-1") or None, stop + 1
        vector = integers(content[at : at + d * width], width, big=new, signed=width == 4)
        at += d * width
        freq = int(integers(content[at : at + tail], tail, big=new, signed=tail == 4)[0])
        at += tail
        yield i, name, vector.astype(np.int32), freq


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, vector, freq) of a codebook or training set, versions 0 to 2."""

    def run(batches):
        for b in batches:
            for content in b.content:
                rows = []
                for row in parse_nodes(content):
                    rows.append(row)
                    if len(rows) == RUN:
                        yield pd.DataFrame(rows, columns=["idx", "name", "vector", "freq"])
                        rows = []
                yield pd.DataFrame(rows, columns=["idx", "name", "vector", "freq"])

    return _contents(spark, path).mapInPandas(run, NODE)


def write_codebook(nodes: DataFrame, path: str, training_set: bool = False, method: str = "", width: int | None = None) -> None:
    """Streams a version 2 file, in idx order, into one local file."""
    s = nodes.agg(F.count("*"), F.max(F.size("vector")), F.sum("freq"), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    n, d, total, low, high = (v or 0 for v in s)
    width = width or (1 if 0 <= low and high < 1 << 8 else 2 if 0 <= low and high < 1 << 16 else 4)
    head = [f"{TRAINING_SET if training_set else CODEBOOK} {FORMAT_VERSION}", d, 1, n, total, width, low, high, 0, *([method] if method else []), RULE]
    with open(path, "wb") as f:
        f.write("".join(f"{x}\n" for x in head).encode("latin-1"))
        for r in nodes.select("idx", "name", "vector", "freq").orderBy("idx").toLocalIterator():
            f.write((r.name or "").encode("latin-1") + b"\0")
            f.write(b"".join(int(x).to_bytes(width, "big", signed=x < 0) for x in r.vector))
            f.write(int(r.freq).to_bytes(4, "big"))


def bits(content: bytes) -> np.ndarray:
    """The bits of a byte string, most significant first."""
    return np.unpackbits(np.frombuffer(content, np.uint8))


def bit_value(some: np.ndarray) -> int:
    """A value whose least significant bit comes first."""
    return int((some.astype(np.int64) << np.arange(len(some))).sum())
