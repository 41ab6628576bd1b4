"""Benchmark decontamination with SimHash windows and multi-index Hamming search.

Items and documents become lower-cased words (runs of letters and digits); both
are compared by weighted shingles of five words, where a shingle weighs as much
as its words are long.  Every window of a document that has as many words as an
item gets a SimHash of its weighted shingles.  Fingerprints of items are indexed
by blocks of bits: two fingerprints within ``RADIUS`` differ by at most RADIUS //
BLOCKS bits in some block, so probing each block with all values that near finds
every item within the radius.  Candidates are verified by the exact weighted
overlap of window and item: the weight of the item's shingles that the window holds,
as a share of the item's weight, so that a changed word costs its shingles once.

Windows without a shingle of any item have similarity 0; a lookup of shingle
hashes leaves them out before any fingerprint is taken, and loses nothing.

Items travel to the tasks in slices of at most ``SLICE`` items, a pass each, so
what is sent to executors is bounded for benchmarks of any size.

Edge cases: items and documents without words match nothing; an item or window of
fewer than five words is one shingle; items that repeat match each; ties between
windows go to the earliest; null document ids and null item ids are carried;
documents are read whole; an empty documents or benchmark table gives no matches;
other columns play no part in a match, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops, common

SIMILARITY = 0.8
#: Bits that fingerprints may differ by, and the blocks of the index.
RADIUS, BLOCKS = 24, 8
#: Window-item pairs looked at in one go, and windows fingerprinted in one go.
CELLS, RUN = 1 << 22, 1 << 14
#: Items sent to the executors at a time.
SLICE = 5_000


def features(words: bytesops.Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the shingles of words a .. b."""
    hashes = bytesops.shingle_hashes(words.hash[a:b])
    length = (words.end - words.start)[a:b]
    size = min(bytesops.SHINGLE, len(length))
    sums = np.concatenate(([0], np.cumsum(length)))
    return hashes, (sums[size:] - sums[: len(sums) - size])[: len(hashes)].astype(np.int64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) of -1 and 1: the bits of each hash."""
    bits = np.unpackbits(bytesops.mix(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int64) * 2 - 1


def window_fingerprints(hashes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles, by differences of prefix sums."""
    sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(signs(hashes) * weights[:, None], axis=0)))
    total = sums[size:] - sums[:-size]
    return np.packbits(total > 0, axis=1).reshape(-1).view(np.uint64)


def weighted_overlap(window: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the item's weight that the window holds, shingles counted as often as they occur."""
    names, where = np.unique(np.concatenate((window[0], item[0])), return_inverse=True)
    x, y = (np.bincount(w, v, len(names)) for w, v in ((where[: len(window[0])], window[1]), (where[len(window[0]) :], item[1])))
    total = y.sum()
    return float(np.minimum(x, y).sum() / total) if total else 0.0


class HammingIndex:
    """Items of one size by blocks of fingerprint bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        bytes_ = prints.view(np.uint8).reshape(-1, blocks)
        near = [0]
        for r in range(1, radius // blocks + 1):
            near += [sum(1 << x for x in c) for c in combinations(range(64 // blocks), r)]
        near = np.array(near, np.uint8)
        #: table[block][value] marks the items that have a value that near in the block
        self.table = np.zeros((blocks, 256, len(prints)), bool)
        for k in range(blocks):
            for i, value in enumerate(bytes_[:, k]):
                self.table[k, value ^ near, i] = True

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius; windows in runs of bounded size."""
        run = max(1, CELLS // max(1, len(self.prints)))
        found = [self._search(prints[at : at + run], at) for at in range(0, len(prints), run)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 3

    def _search(self, prints: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = prints.view(np.uint8).reshape(len(prints), -1)
        maybe = self.table[0, parts[:, 0]].copy()
        for k in range(1, parts.shape[1]):
            maybe |= self.table[k, parts[:, k]]
        window, item = np.nonzero(maybe)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64)
        ok = distance <= self.radius
        return window[ok] + base, item[ok], distance[ok]


class Benchmark:
    """A slice of items: shingles, fingerprints by size, and the lookup of shingles."""

    def __init__(self, ids: list, texts: list[bytes]):
        words = bytesops.Words(texts, bytesops.SYMBOLS)
        self.items: dict[int, list[tuple]] = {}
        shingles = []
        for i, name in enumerate(ids):
            h, w = features(words, words.first[i], words.first[i + 1])
            if len(h):
                count = int(words.first[i + 1] - words.first[i])
                self.items.setdefault(count, []).append((name, h, w))
                shingles.append(h)
        self.shingles = np.unique(np.concatenate(shingles)) if shingles else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        # shorter items are one shingle of fewer than five words, which no five-word shingle equals
        self.short = sorted(n for n in self.items if n < bytesops.SHINGLE)
        #: sizes of the items that hold a shingle
        self.sizes_of: dict[int, set[int]] = {}
        for n, items in self.items.items():
            for _, h, _ in items:
                for x in h.tolist():
                    self.sizes_of.setdefault(x, set()).add(n)
        self.index = {n: HammingIndex(np.concatenate([window_fingerprints(h, w, len(h)) for _, h, w in items])) for n, items in self.items.items()}

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are an item's shingle."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at
        h = hashes[at]
        near = np.minimum(np.searchsorted(self.shingles, h), len(self.shingles) - 1)
        return at[self.shingles[near] == h]

    def match_size(self, n: int, words: bytesops.Words, a: int, b: int, places: np.ndarray) -> list[tuple]:
        """(item, first word, distance, similarity) of windows of n words around hits in words a .. b."""
        size = max(1, n - bytesops.SHINGLE + 1)
        if b - a < n:
            n_here = b - a  # a text shorter than the item is a window of its own
            size = max(1, n_here - bytesops.SHINGLE + 1)
        best: dict[int, tuple] = {}
        at = 0
        while at < len(places):  # stretches of hits whose windows overlap
            to = at
            while to + 1 < len(places) and places[to + 1] - places[to] < 2 * size:
                to += 1
            low, high = max(0, places[at] - size + 1), min(b - a - bytesops.SHINGLE + 1 if b - a >= bytesops.SHINGLE else 1, places[to] + size)
            for first in range(low, max(low + 1, high - size + 1), RUN):  # windows of a stretch, a run at a time
                last = min(high, first + RUN + size - 1)
                h, w = features(words, a + first, min(b, a + last + bytesops.SHINGLE - 1))
                if len(h) < size:
                    continue
                for window, item, distance in zip(*self.index[n].search(window_fingerprints(h, w, size))):
                    name, ih, iw = self.items[n][item]
                    similarity = weighted_overlap((h[window : window + size], w[window : window + size]), (ih, iw))
                    key = (-similarity, first + window)
                    if similarity >= SIMILARITY and (item not in best or key < best[item][0]):
                        best[item] = (key, int(distance))
            at = to + 1
        return [(self.items[n][item][0], int(key[1]), n, distance, -key[0]) for item, (key, distance) in sorted(best.items())]

    def match(self, texts: list[bytes]) -> list[tuple]:
        """(text, item_id, first word, words, distance, similarity) over whole texts."""
        found = []
        if not len(self.shingles):
            return found
        for x, y in bytesops.blocks(texts):
            words = bytesops.Words(texts[x:y], bytesops.SYMBOLS)
            # shingles of the whole block; those that cross a border between texts are dropped below
            hashes = bytesops.shingle_hashes(words.hash) if len(words.hash) >= bytesops.SHINGLE else np.empty(0, np.uint64)
            hit = self.hits(hashes)
            hit = hit[words.doc[hit] == words.doc[hit + bytesops.SHINGLE - 1]] if len(hit) else hit
            for d in np.unique(words.doc[hit]).tolist():
                a, b = words.first[d], words.first[d + 1]
                places = hit[(hit >= a) & (hit < b)]
                by_size: dict[int, list[int]] = {}
                for p in places.tolist():
                    for n in self.sizes_of[int(hashes[p])]:
                        by_size.setdefault(n, []).append(p - a)
                for n, at in sorted(by_size.items()):
                    found += [(x + d, *m) for m in self.match_size(n, words, a, b, np.array(at))]
            for n in self.short:
                found += [(x + d, *m) for d, m in self.match_short(n, words)]
        return found

    def match_short(self, n: int, words: bytesops.Words):
        """Windows of fewer than five words are one shingle: equal or not."""
        total = np.full(max(0, len(words.hash) - n + 1), n, np.uint64)
        for j in range(n):
            total += words.hash[j : j + len(total)] * bytesops._ROLL[j]
        hashes = bytesops.mix(total)
        for name, h, _ in self.items[n]:
            same = np.flatnonzero(hashes == h[0])
            same = same[words.doc[same] == words.doc[same + n - 1]]
            docs, first = np.unique(words.doc[same], return_index=True)
            for d, k in zip(docs.tolist(), first.tolist()):
                yield d, (name, int(same[k] - words.first[d]), n, 0, 1.0)


def slices(benchmark: DataFrame):
    """The items, at most SLICE of them in the driver at a time."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n = max(1, -(-items.count() // SLICE))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield Benchmark([r[0] for r in rows], [r[1].encode() for r in rows])


MATCHES = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item with a window that matches: the best one."""

    def matches(part: Benchmark):
        def run(batches):
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[m[0]], *m[1:]) for m in part.match(bytesops.texts_of(b.column("text")))]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(),) * 4 + (pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

        return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, MATCHES, "decontaminate")

    out = None
    for part in slices(benchmark):
        found = matches(part)
        out = found if out is None else out.unionByName(found)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a match; all columns."""

    def clean(part: Benchmark):
        def run(batches):
            for b in batches:
                hit = {m[0] for m in part.match(bytesops.texts_of(b.column("text")))}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        return run

    for part in slices(benchmark):
        docs = common.in_arrow(docs, clean(part), docs.schema, "decontaminate")
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
