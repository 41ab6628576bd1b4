"""Token ids in flat binary files with 64-bit document offsets.

Layout of a folder: ``part-NNNNN.bin`` holds the ids of a range of documents in
ascending id order as unsigned 16- or 32-bit little-endian integers (the smaller
that fits the vocabulary); ``part-NNNNN.idx`` holds n + 1 signed 64-bit offsets
into it, counted in ids; ``part-NNNNN.ids`` holds n document ids (64 bits);
``manifest.json`` lists the parts with their bases, which are prefix sums of the
parts' totals.  Readers map the files into memory and touch only what they use.

A part is written under a name of its own attempt and renamed when complete, so
lost and repeated tasks leave nothing but equal files.

Edge cases: null and empty texts hold the end id alone; rows with equal ids stand
side by side in text order; null ids come first and are stored as the smallest
64-bit integer; very long texts are encoded whole, with one text's ids in memory;
an empty table gives a manifest without parts; other columns are not written.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

NO_ID = -(1 << 63)
BLOCK = 1 << 20


def _replace(folder: str, name: str, data_parts) -> None:
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        for part in data_parts:
            f.write(part)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, f"{folder}/{name}")


def _folder(uri: str) -> str:
    path = common.local_path(uri)
    if path is None:
        raise ValueError(f"token files are mapped into memory and need a mounted folder, not {uri}")
    os.makedirs(path, exist_ok=True)
    return path


def write_token_files(docs: DataFrame, uri: str, end_id: int = 2, path: str | None = None) -> list[dict]:
    """Encodes, appends the end id, writes the files, returns the manifest's parts."""
    path = path or bpe.default_path()

    def run(batches):
        from pyspark import TaskContext

        encoder = bpe.WordEncoder.at(path)
        kind = np.dtype("<u2") if max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        folder, part = _folder(uri), f"part-{TaskContext.get().partitionId():05d}"
        temp = f"{folder}/.{part}.bin.{uuid.uuid4().hex}"
        sizes, ids = [], []
        end = np.array([end_id], "<u4").tobytes()
        with open(temp, "wb") as f:
            for b in batches:
                texts = [x or "" for x in b.column("text").to_pylist()]
                ids += [NO_ID if x is None else x for x in b.column("doc_id").to_pylist()]
                at = 0
                while at < len(texts):
                    to, size = at, 0
                    while to < len(texts) and size < BLOCK:
                        size += len(texts[to])
                        to += 1
                    found = encoder.encode(texts[at:to])
                    sizes += [len(x) // 4 + 1 for x in found]
                    f.write(np.frombuffer(end.join(found) + end, "<u4").astype(kind).tobytes())
                    at = to
            f.flush()
            os.fsync(f.fileno())
        if not ids:
            os.remove(temp)
            return
        os.replace(temp, f"{folder}/{part}.bin")
        _replace(folder, f"{part}.idx", [np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes()])
        _replace(folder, f"{part}.ids", [np.array(ids, "<i8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(ids)], pa.int64()), pa.array([int(sum(sizes))], pa.int64()), pa.array([kind.itemsize], pa.int32())], names=["part", "docs", "ids", "width"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(common.in_arrow(ordered, run, "part string, docs long, ids long, width int", "bpe").collect(), key=lambda r: r["part"])
    manifest, base, doc_base = [], 0, 0
    for r in parts:  # a row for each partition
        manifest.append(r.asDict() | {"base": base, "doc_base": doc_base})
        base, doc_base = base + r["ids"], doc_base + r["docs"]
    folder = _folder(uri)
    _replace(folder, "manifest.json", [json.dumps({"parts": manifest, "end_id": end_id}).encode()])
    return manifest


class TokenFiles:
    """Random access to the documents of a folder."""

    def __init__(self, uri: str):
        self.folder = common.local_path(uri)
        with open(f"{self.folder}/manifest.json") as f:
            self.parts = json.load(f)["parts"]

    def part(self, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets and document ids of a part, mapped."""
        kinds = (("bin", f"<u{p['width']}"), ("idx", "<i8"), ("ids", "<i8"))
        return tuple(np.memmap(f"{self.folder}/{p['part']}.{name}", kind, "r") for name, kind in kinds)

    def __len__(self) -> int:
        return sum(p["docs"] for p in self.parts)

    def __getitem__(self, i: int) -> tuple[int, np.ndarray]:
        """Document id and ids of the i-th document."""
        p = max((p for p in self.parts if p["doc_base"] <= i), key=lambda p: p["doc_base"])
        ids, offsets, docs = self.part(p)
        j = i - p["doc_base"]
        return int(docs[j]), np.asarray(ids[offsets[j] : offsets[j + 1]])


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = TokenFiles(uri)

    def run(batches):
        for b in batches:
            for p in b.to_pylist():
                ids, offsets, docs = files.part(p)
                for at in range(0, len(docs), 5000):
                    to = min(at + 5000, len(docs))
                    places = np.asarray(offsets[at : to + 1])
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(places[:-1].tolist(), places[1:].tolist())]
                    names = np.asarray(docs[at:to])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, mask=names == NO_ID), pa.array(places[:-1] + p["base"]), pa.array(np.diff(places)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "part string, docs long, ids long, width int, base long, doc_base long"
    parts = spark.createDataFrame(files.parts, schema).repartition(max(1, len(files.parts)))
    return common.in_arrow(parts, run, "doc_id long, start long, n_tokens long, ids_crc32 long", "bpe")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = common.Scratch(spark, "op9").path("tokens")
    write_token_files(common.table(spark, sf_dir, "documents"), uri)
    return read_token_files(spark, uri)
