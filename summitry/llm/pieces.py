"""N-best piece segmentation of whole texts, and its decoding.

The pieces and scores of a SentencePiece model span a lattice over a text (blanks
are U+2581, one is put in front; a character that no piece is gets an arc of its
own and becomes its UTF-8 byte pieces).  Forward Viterbi gives every place the
score of its best prefix; these scores are exact heuristics for an A-star search
from the end of the text backwards, which yields segmentations in order of score.
The forward pass keeps the second best prefix too, so that the search runs only
where an alternative can be among the N best.

No piece holds a blank after another character, nor two neighbours that no piece
has side by side, so a lattice is a chain of small ones.  They are searched one by
one and remembered; the N best of the chain follow exactly from the N - 1
cheapest single deviations (``combine``).

The score of a segmentation is the sum of its pieces' scores.  For a BPE model
these are merge ranks, so its best segmentation is the one of the commonest
pieces, which need not be the one that merging gives.  Equal scores: fewer
deviations from the best segmentation first, then earlier ones; inside a unit in
the order of the search.

Edge cases: null and empty texts have one segmentation without pieces; texts with
fewer than N segmentations return fewer; U+2581 in a text decodes as a blank;
very long texts are searched whole, unit by unit; repeated rows and null ids are
kept; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from array import array
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

N_BEST = 3
#: Words and units that a worker remembers before it starts afresh, and their longest text.
#: A million words take about 0.4 GB; fewer only cost time.
WORDS, UNITS, LONGEST = 100_000, 60_000, 48
BLANK = "▁"
#: Added to the least score for a character that no piece is.
UNKNOWN = -10
_NEVER = -(1 << 62)

_open: dict[tuple, "Lattice"] = common.remembered({})
_words = re.compile(r"▁*[^▁]+|▁+").findall


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def best_paths(arcs: list[list[tuple[int, int, object]]], n: int) -> list[tuple[int, tuple]]:
    """The n best (score, labels) through a lattice; ``arcs[end]`` lists (start, score, label).

    Places are in order, and every one can be reached from the first.
    """
    size = len(arcs) - 1
    prefix = [0] * (size + 1)
    for end in range(1, size + 1):
        prefix[end] = max([prefix[start] + score for start, score, _ in arcs[end]])
    # equal estimates: the newest first, so that the search runs on to the start
    heap = [(-prefix[size], 0, size, 0, None)]
    found: list[tuple[int, tuple]] = []
    count = 0
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, _, place, tail, path = pop(heap)
        while place and len(arcs[place]) == 1:  # no choice here
            place, score, label = arcs[place][0]
            tail, path = tail + score, (label, path)
        if not place:
            labels = []
            while path is not None:
                label, path = path
                labels.append(label)
            found.append((tail, tuple(labels)))
            if len(found) == n:
                break
            continue
        for start, score, label in arcs[place]:
            count -= 1
            push(heap, (-(tail + score + prefix[start]), count, start, tail + score, (label, path)))
    return found


class Lattice:
    """A model's pieces, with remembered units."""

    def __init__(self, path: str, n: int, most_words: int = WORDS, most_units: int = UNITS):
        import sentencepiece

        self.most_words, self.most_units = most_words, most_units

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size, self.n = sp.get_piece_size(), n
        self.vocabulary: dict[str, tuple[int, int]] = {}
        self.bytes: dict[int, int] = {}
        surfaces = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surfaces.append(b"")
            else:
                self.vocabulary[piece] = (i, round(sp.get_score(i)))
                surfaces.append(piece.replace(BLANK, " ").encode())
        self.unknown_id = sp.unk_id()
        self.unknown_score = min(s for _, s in self.vocabulary.values()) + UNKNOWN
        #: pieces by their characters: each leads to (score or None, id, what may follow)
        self.trie: dict = {}
        for piece, (i, score) in sorted(self.vocabulary.items()):
            node = self.trie
            for k, c in enumerate(piece, 1):
                was = node.get(c, (None, None, {}))
                if k == len(piece):
                    was = (score, i, was[2])
                node[c] = was
                node = was[2]
        self.single = {p for p in self.vocabulary if len(p) == 1}
        self.neighbours = {p[k : k + 2] for p in self.vocabulary for k in range(len(p) - 1)}
        if any(BLANK in p.lstrip(BLANK) for p in self.vocabulary):
            raise ValueError("pieces with a blank inside would cross the words of a text")
        self.lengths = np.array([len(s) for s in surfaces])
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.pool = np.frombuffer(b"".join(surfaces), np.uint8)
        self.units: dict[str, tuple] = {}
        self.words: dict[str, tuple] = {}
        self.rest: dict[str, list] = {}

    @staticmethod
    def at(*key) -> "Lattice":
        """The worker's own lattice of (path, n, most words, most units)."""
        if key not in _open:
            _open[key] = Lattice(*key)
            # remembered units are many small tuples without cycles: full collections would only walk them
            gc.set_threshold(100_000, 50, 1000)
        return _open[key]

    def ids_of(self, labels) -> array:
        """Piece ids of labels; a character without a piece becomes its bytes' pieces."""
        ids = array("i")
        for label in labels:
            if isinstance(label, str):
                ids.extend([self.bytes.get(b, self.unknown_id) for b in label.encode("utf-8", "replace")])
            else:
                ids.append(label)
        return ids

    def unit(self, text: str) -> tuple:
        """(score, ids, loss of the second best, text) of a unit; no second best: loss -1.

        Forward Viterbi with the two best prefixes of every place.
        """
        size, root = len(text), self.trie
        first, second = [_NEVER] * (size + 1), [_NEVER] * (size + 1)
        start_of: list = [0] * (size + 1)
        label_of: list = [None] * (size + 1)
        first[0], strange = 0, False
        for i, c in enumerate(text):
            one, two, nodes, end = first[i], second[i], root, i
            if c not in self.single:
                strange = True
                self._reach(first, second, start_of, label_of, i, one + self.unknown_score, two + self.unknown_score, c)
            while True:
                step = nodes.get(c)
                if step is None:
                    break
                score, piece, nodes = step
                end += 1
                if score is not None:
                    value, held = one + score, first[end]
                    if value > held:
                        other = two + score
                        second[end] = held if held > other else other
                        first[end], start_of[end], label_of[end] = value, i, piece
                    elif value > second[end]:
                        second[end] = value
                if end == size:
                    break
                c = text[end]
        labels, place = [], size
        while place:
            labels.append(label_of[place])
            place = start_of[place]
        labels.reverse()
        loss = first[size] - second[size]
        ids = self.ids_of(labels) if strange else array("i", labels)
        return first[size], ids.tobytes(), loss if loss < -_NEVER // 2 else -1, text

    @staticmethod
    def _reach(first, second, start_of, label_of, i: int, value: int, other: int, label: str) -> None:
        """The arc of a character that no piece is."""
        end = i + 1
        if value > first[end]:
            second[end] = max(first[end], other)
            first[end], start_of[end], label_of[end] = value, i, label
        elif value > second[end]:
            second[end] = value

    def others(self, unit: tuple) -> list[tuple[int, bytes]]:
        """(loss, ids) of a unit's second best segmentation and on, by A-star search."""
        text = unit[3]
        known = self.rest.get(text)
        if known is None:
            size = len(text)
            arcs: list[list] = [[] for _ in range(size + 1)]
            for i in range(size):
                nodes, end = self.trie, i
                if text[i] not in self.single:
                    arcs[i + 1].append((i, self.unknown_score, text[i]))
                while end < size and text[end] in nodes:
                    score, piece, nodes = nodes[text[end]]
                    end += 1
                    if score is not None:
                        arcs[end].append((i, score, piece))
            ways = [(score, self.ids_of(labels).tobytes()) for score, labels in best_paths(arcs, self.n)]
            if unit[1] in (ids for _, ids in ways):
                ways = [w for w in ways if w[1] != unit[1]]
            else:  # all n are as good as the best and none is it
                ways = ways[: self.n - 1]
            known = [(unit[0] - score, ids) for score, ids in ways]
            if size <= LONGEST:
                self.rest[text] = known
        return known

    def word(self, text: str) -> tuple:
        """The units of a word: it is cut where no piece has the two characters side by side."""
        near = self.neighbours
        cuts = [0, *[i for i, pair in enumerate(map(str.__add__, text, text[1:]), 1) if pair not in near], len(text)]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            part = text[a:b]
            unit = self.units.get(part)
            if unit is None:
                unit = self.unit(part)
                if len(part) <= LONGEST:
                    self.units[part] = unit
            found.append(unit)
        return tuple(found)

    def chain(self, text: str) -> list[tuple]:
        """The units of a whole text."""
        if not text:
            return []
        if len(self.units) > self.most_units or len(self.words) > self.most_words:
            self.units.clear()
            self.words.clear()
            self.rest.clear()
        words, out = self.words, []
        for w in _words(BLANK + text.replace(" ", BLANK)):
            units = words.get(w)
            if units is None:
                units = self.word(w)
                if len(w) <= LONGEST:
                    words[w] = units
            out += units
        return out

    def encode(self, text: str) -> list[tuple[int, bytes]]:
        """The n best (score, ids) of a text."""
        chain = self.chain(text)
        ids = [u[1] for u in chain]
        best = sum([u[0] for u in chain])
        found = []
        for loss, changes in combine(chain, self.n, self.others):
            parts = ids
            if changes:
                parts = list(ids)
                for place, rank in changes:
                    parts[place] = self.others(chain[place])[rank][1]
            found.append((best - loss, b"".join(parts)))
        return found

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of a segmentation."""
        ids = np.frombuffer(ids, "<i4") if isinstance(ids, bytes) else np.asarray(ids)
        if not len(ids):
            return ""
        lengths = self.lengths[ids]
        starts = np.cumsum(lengths) - lengths
        raw = self.pool[np.repeat(self.offsets[ids] - starts, lengths) + np.arange(int(lengths.sum()))].tobytes()
        return raw[1:].decode("utf-8", "replace")


def combine(chain: list[tuple], n: int, others) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The n best choices along a chain as (loss, ((place, rank), ...)).

    A choice among the n best uses none but the n - 1 least single deviations:
    each of its deviations alone loses no more and is one change, so it comes first.
    """
    losses = np.array([u[2] for u in chain], np.int64)
    open_ = np.flatnonzero(losses >= 0)
    if len(open_) > n - 1:
        least = np.partition(losses[open_], n - 2)[n - 2]
        under = open_[losses[open_] < least]
        open_ = np.sort(np.concatenate((under, open_[losses[open_] == least][: n - 1 - len(under)])))
    singles = sorted((loss, int(p), r) for p in open_ for r, (loss, _) in enumerate(others(chain[p])))[: n - 1]
    choices = [(0, 0, ())]
    for k in range(1, n):
        for some in combinations(singles, k):
            if len({p for _, p, _ in some}) == k:
                choices.append((sum(s[0] for s in some), k, tuple(sorted((p, r) for _, p, r in some))))
    return [(loss, changes) for loss, _, changes in sorted(choices)[:n]]


def segmentations(docs: DataFrame, n: int = N_BEST, path: str | None = None) -> DataFrame:
    """doc_id, rank, score, ids of the n best segmentations of every text."""
    path = path or default_path()

    def run(batches):
        lattice = Lattice.at(path, n)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = [(i, r, s, ids) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for r, (s, ids) in enumerate(lattice.encode(t or ""), 1)]
                flat = np.frombuffer(b"".join(r[3] for r in rows), "<i4")
                offsets = np.concatenate(([0], np.cumsum([len(r[3]) // 4 for r in rows]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=["doc_id", "rank", "score", "ids"],
                )

    return common.in_arrow(docs.select("doc_id", "text"), run, "doc_id long, rank int, score long, ids array<int>", "pieces")


def digests(docs: DataFrame, n: int = N_BEST, path: str | None = None, words: int = WORDS, units: int = UNITS) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_crc32 and whether the ids decode to the text."""
    path = path or default_path()

    def run(batches):
        lattice = Lattice.at(path, n, words, units)
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t = t or ""
                for r, (s, ids) in enumerate(lattice.encode(t), 1):
                    rows.append((i, r, s, len(ids) // 4, zlib.crc32(ids), lattice.decode(ids) == t))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decodes"])

    return common.in_arrow(docs.select("doc_id", "text"), run, "doc_id long, rank int, score long, n_pieces long, ids_crc32 long, decodes boolean", "pieces")


def op3_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alone in its workers, with room for more words."""
    return digests(common.table(spark, sf_dir, "documents"), words=800_000, units=500_000)
