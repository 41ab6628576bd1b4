"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting draws a bounded sample of labelled rows (``PER_CLASS`` for each label).
All their words whose rates differ between the labels beyond chance take part; a
word's weight is its TF-IDF, with document frequencies over all documents, times
its chi-square, so that words which tell the labels apart decide what is near.  The
examples' unit vectors go into an inverted index whose postings lie in blocks with
their largest weight.

Scoring finds a text's ``NEIGHBOURS`` nearest examples exactly: blocks are opened
in order of their upper bound until no unopened one can matter.  The neighbours
vote by cosine; votes count by the size of the class behind the sample, and a
prior of the examples without any such word shrinks them, which keeps scores near
the frequency of label 1.  Neighbours are the evidence of a score.

Edge cases: null and empty texts, and texts without such a word, get the base rate
of such examples; without labels, or with one label only, every score is the share
of label 1 (0 without rows); a row labelled twice counts as toxic if one label says
so; equal cosines go to the earlier example; labels without a document have no
effect; repeated rows are scored each; very long texts are read whole; an empty
table gives no rows; other columns play no part in a score, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops, common

#: The training sample: a bound of all that reaches the driver.
PER_CLASS = 3000
#: Chi-square that one word in ten exceeds by chance.
LEAST_CHI2 = 2.706
NEIGHBOURS, BLOCK = 25, 64
THRESHOLD = 0.3


def class_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of the sampled rows, and the classes' full sizes."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    parts = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), sizes


def word_counts(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, word, n) of texts; words are 64-bit hashes."""

    def run(batches):
        for b in batches:
            ids, toxic, words, counts = [], [], [], []
            texts = bytesops.texts_of(b.column("text"))
            for i, t in enumerate(texts):
                found, n = np.unique(bytesops.Words([t], bytesops.SYMBOLS).hash, return_counts=True)
                ids.append(np.full(len(found), b.column("doc_id")[i].as_py()))
                toxic.append(np.full(len(found), b.column("toxic")[i].as_py(), np.int32))
                words.append(found.view(np.int64))
                counts.append(n.astype(np.int64))
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, toxic, words, counts)], names=["doc_id", "toxic", "word", "n"])

    return common.in_arrow(sample.select("doc_id", "toxic", "text"), run, "doc_id long, toxic int, word long, n long", "toxicity")


def marked_words(counts: DataFrame, n0: int, n1: int) -> dict[int, float]:
    """Words of the sample whose rates differ between the labels, with their chi-square."""
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(float(n1)) - a, F.lit(float(n0)) - b
    chi2 = (n0 + n1) * F.pow(a * d - b * c, 2) / F.greatest(F.lit(1e-9), (a + b) * (c + d) * n1 * n0)
    table = counts.groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    return {r["word"]: r["chi2"] for r in table.select("word", chi2.alias("chi2")).where(F.col("chi2") >= LEAST_CHI2).collect()}  # words of 2 * PER_CLASS texts at most


class Vocabulary:
    """Finds the marked words of a block of texts."""

    def __init__(self, words: list[int]):
        self.words = np.sort(np.array(words, np.int64).view(np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: bytesops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the marked words in a block."""
        at = np.flatnonzero(self.maybe[(words.hash >> np.uint64(44)).astype(np.int64)])
        h = words.hash[at]
        term = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        hit = self.words[term] == h if len(self.words) else np.zeros(len(h), bool)
        key, n = np.unique(words.doc[at][hit] * max(1, len(self.words)) + term[hit], return_counts=True)
        return key // max(1, len(self.words)), key % max(1, len(self.words)), n


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each marked word occurs, and the number of documents."""

    def run(batches):
        total, rows = np.zeros(len(vocabulary.words), np.int64), 0
        for b in batches:
            texts = bytesops.texts_of(b.column("text"))
            rows += len(texts)
            for x, y in bytesops.blocks(texts):
                _, term, _ = vocabulary.find(bytesops.Words(texts[x:y], bytesops.SYMBOLS))
                total += np.bincount(term, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], seen))), pa.array(np.concatenate(([rows], total[seen])))], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in common.in_arrow(docs.select("text"), run, "term long, n long", "toxicity").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(t, 0) for t in range(len(vocabulary.words))], float), sums.get(-1, 0)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(start - np.cumsum(size) + size, size), of


class BlockMaxIndex:
    """Postings of example vectors by term and block, with the largest weight of each such list."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = BLOCK):
        # examples with the same heaviest term lie together, so that bounds are tight
        lead = lambda v: max(v.items(), key=lambda x: (x[1], -x[0])) if v else (-1, 0.0)
        order = sorted(range(len(vectors)), key=lambda i: (lead(vectors[i])[0], -lead(vectors[i])[1], i))
        self.block, self.n_blocks, self.names = block, -(-len(vectors) // block), np.array(order, int)
        entries = sorted((t, place, w) for place, i in enumerate(order) for t, w in vectors[i].items())
        term = np.array([e[0] for e in entries], int)
        self.place, self.weight = np.array([e[1] for e in entries], int), np.array([e[2] for e in entries], float)
        #: lists of one term in one block: its block, where its postings start, its largest weight
        key = term * max(1, self.n_blocks) + self.place // block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.list_block = self.place[first] // block
        self.list_start = np.append(first, len(entries))
        self.list_max = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        #: the lists of each term
        self.of_term = np.searchsorted(term[first], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[list[tuple[float, int]], int]:
        """The k largest positive inner products as (value, example), and the blocks opened."""
        lists, of = _ranges(self.of_term[terms], self.of_term[terms + 1])
        weight, block = weights[of], self.list_block[lists]
        bounds = np.bincount(block, weight * self.list_max[lists], self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(self.n_blocks, int)
        rank[order] = np.arange(self.n_blocks)
        turn = rank[block]
        best: list[tuple[float, int]] = []
        opened, step = 0, 2
        while opened < self.n_blocks:
            bound = bounds[order[opened]]
            if bound <= 0 or len(best) == k and bound < best[-1][0] - 1e-9:
                break
            # blocks are opened a few at a time, the more the longer it takes
            now = (turn >= opened) & (turn < opened + step)
            at, which = _ranges(self.list_start[lists[now]], self.list_start[lists[now] + 1])
            score = np.bincount(self.place[at], weight[now][which] * self.weight[at], self.n_blocks * self.block)
            hit = np.flatnonzero(score > (best[-1][0] - 1e-9 if len(best) == k else 0))
            if len(hit) > k:  # the k best of these, and what ties with the last
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k] - 1e-9]
            best = sorted([*best, *zip(np.round(score[hit], 9).tolist(), self.names[hit].tolist())], key=lambda x: (-x[0], x[1]))[:k]
            opened, step = min(self.n_blocks, opened + step), 2 * step
        return best, opened


class Model:
    """Vocabulary, weights, index and votes; small enough to travel with the tasks."""

    def __init__(self, words: dict[int, float], frequencies=None, rows: int = 0, examples=(), base: float = 0.0, weights=(1.0, 1.0)):
        self.vocabulary = Vocabulary(list(words))
        idf = np.log((rows + 1) / (np.asarray(frequencies if frequencies is not None else [], float) + 1)) + 1
        self.worth = idf * np.array([words[w] for w in self.vocabulary.words.view(np.int64).tolist()]) if len(idf) else idf
        vectors = []
        for _, _, terms in examples:
            at = np.array(sorted(terms), int)
            vectors.append(dict(zip(at.tolist(), self.vector(at, np.array([terms[t] for t in at.tolist()])).tolist())))
        self.ids, self.toxic = [e[0] for e in examples], np.array([e[1] for e in examples], float)
        self.vote = np.where(self.toxic > 0, weights[1], weights[0])
        self.index = BlockMaxIndex(vectors, len(words)) if examples else None
        self.base = base

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.worth[terms]
        return v / np.sqrt((v * v).sum())

    def judge(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[float, int]]]:
        """Score and neighbours of a text with these words."""
        if not len(terms) or self.index is None:
            return self.base, []
        near, _ = self.index.search(terms, self.vector(terms, counts), NEIGHBOURS)
        if not near:
            return self.base, []
        who = [i for _, i in near]
        votes = np.array([s for s, _ in near]) * self.vote[who]
        prior = float(np.min(self.vote, initial=1.0))
        return min(1.0, max(0.0, (float((votes * self.toxic[who]).sum()) + prior * self.base) / (float(votes.sum()) + prior))), near

    def scores(self, texts: list[bytes]) -> tuple[list[float], list[int | None], list[float | None]]:
        """Score, nearest example and its cosine of each text."""
        judged = [(self.base, [])] * len(texts)
        if len(self.vocabulary.words):
            known: dict[bytes, tuple] = {}  # copies within a batch
            for a, b in bytesops.blocks(texts):
                doc, term, count = self.vocabulary.find(bytesops.Words(texts[a:b], bytesops.SYMBOLS))
                at = np.searchsorted(doc, np.arange(b - a + 1))
                for d in range(b - a):
                    t, n = term[at[d] : at[d + 1]], count[at[d] : at[d + 1]]
                    key = t.tobytes() + n.tobytes()
                    if key not in known:
                        known[key] = self.judge(t, n)
                    judged[a + d] = known[key]
        return [s for s, _ in judged], [self.ids[n[0][1]] if n else None for _, n in judged], [n[0][0] if n else None for _, n in judged]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    scratch = common.Scratch(docs.sparkSession, "toxicity")
    sample, sizes = class_sample(docs, labels, per_class)
    total = sum(sizes.values())
    if len(sizes) < 2:
        return Model({}, base=sizes.get(1, 0) / total if total else 0.0)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 * per_class rows at most
    counts = scratch.save(word_counts(texts), "counts")
    shares = {r["toxic"]: r["n"] for r in counts.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    words = marked_words(counts, n0, n1) if n0 and n1 else {}
    if not words:
        return Model({}, base=sizes[1] / total)
    vocabulary = Vocabulary(list(words))
    place = {int(w): i for i, w in enumerate(vocabulary.words.view(np.int64))}
    examples: dict[int, tuple[int, dict]] = {}
    # the sample's rows as columns; repeated rows of an id are one example
    rows = counts.groupBy("doc_id", "toxic", "word").agg(F.max("n").alias("n")).toArrow()
    telling = pc.is_in(rows["word"], pa.array(vocabulary.words.view(np.int64)))
    for r in rows.filter(telling).to_batches(max_chunksize=10_000):
        for i, t, w, n in zip(*(r.column(c).to_pylist() for c in ("doc_id", "toxic", "word", "n"))):
            examples.setdefault(i, (t, {}))[1][place[w]] = n
    marked = sorted((i, t, v) for i, (t, v) in examples.items())
    weights = (sizes[0] / n0, sizes[1] / n1)
    bare = [max(0, n - sum(1 for _, t, _ in marked if t == c)) * weights[c] for c, n in ((0, n0), (1, n1))]
    frequencies, n_docs = document_frequencies(docs, vocabulary)
    return Model(words, frequencies, n_docs, marked, bare[1] / max(1.0, sum(bare)), weights)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; then the nearest example and its cosine."""

    def run(batches):
        for b in batches:
            s, near, cosine = model.scores(bytesops.texts_of(b.column("text")))
            flags = [int(x >= threshold) for x in s]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array(flags, pa.int32()), pa.array(near, pa.int64()), pa.array(cosine, pa.float64())],
                names=["doc_id", "held_out", "score", "predicted", "nearest_id", "nearest_cosine"],
            )

    schema = "doc_id long, held_out boolean, score double, predicted int, nearest_id long, nearest_cosine double"
    return common.in_arrow(docs.select("doc_id", common.held_out().alias("held_out"), "text"), run, schema, "toxicity")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows that are not predicted toxic; all columns."""

    def run(batches):
        for b in batches:
            s, _, _ = model.scores(bytesops.texts_of(b.column("text")))
            yield b.filter(pa.array([x < threshold for x in s], pa.bool_()))

    return common.in_arrow(docs, run, docs.schema, "toxicity")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
