"""Distances as column expressions, by name, and as numpy kernels for blocks.

Every distance is a built-in expression over two columns; dense vectors have a
block kernel as well, which the blocked operators use.  A callable may stand for a
distance anywhere: it gets two pandas Series of values and returns one of floats.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ngrams


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def minkowski(p: float = 1.0) -> Callable[[Column, Column], Column]:
    """Sum of |x - y|^p, without the root."""
    return lambda a, b: _sum(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))


def l05(a: Column, b: Column) -> Column:
    return minkowski(0.5)(a, b)


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; null where a vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return 1 - dot(a, b) / F.when(norms > 0, norms)


def floor_l2(a: Column, b: Column) -> Column:
    return F.floor(l2(a, b))


def entropy(a: Column, b: Column) -> Column:
    """-sum log2 of the probability of agreement; values are probabilities scaled by 10^6.

    The probability of a component under (x, y) is x / 10^6 where y is set, else its
    complement, no less than 0.001.
    """

    def one(x: Column, y: Column) -> Column:
        p = F.when(y > 0, x / 1e6).otherwise(1 - x / 1e6)
        return -F.log2(F.greatest(p, F.lit(0.001)))

    return _sum(_pairs(a, b, one))


def _mismatch(weight: int) -> Callable[[Column, Column], Column]:
    def distance(a: Column, b: Column) -> Column:
        differ = _sum(_pairs(a, b, lambda x, y: F.when((x > 0) != (y > 0), 1.0).otherwise(0.0)))
        both = _sum(_pairs(a, b, lambda x, y: F.when((x > 0) & (y > 0), 1.0).otherwise(0.0)))
        total = differ + weight * both
        return F.when(total > 0, F.round(1e6 * differ / total)).otherwise(0.0)

    return distance


#: Of 0/1 vectors, scaled by 10^6 and rounded.
binary_jaccard = _mismatch(1)
binary_dice = _mismatch(2)


def levenshtein(a: Column, b: Column) -> Column:
    """Unit-cost edit distance over characters."""
    return F.levenshtein(a, b).cast("double")


def set_dice(a: Column, b: Column) -> Column:
    """1 - 2 |A n B| / (|A| + |B|) of arrays taken as sets; two empty ones are 1 apart."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    size = F.size(x) + F.size(y)
    return F.when(size > 0, 1 - 2 * F.size(F.array_intersect(x, y)) / size).otherwise(1.0)


VECTOR = {"l2": l2, "l1": l1, "cos": cosine, "mnkw": minkowski(1.0), "l05": l05, "l2sq": squared_l2, "l2floor": floor_l2, "entropy": entropy, "bjaccard": binary_jaccard, "bdice": binary_dice}
STRING = {"lev": levenshtein, "dice": ngrams.string_dice}
SET = {"set": set_dice}
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {**VECTOR, **STRING, **SET}


def get(name: str, p: float | None = None) -> Callable[[Column, Column], Column]:
    """The expression of a distance; ``mnkw`` takes its power p."""
    if name == "mnkw":
        return minkowski(1.0 if p is None else p)
    if name not in REGISTRY:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def of_error(error: str) -> str:
    """The distance that an error function is measured with."""
    known = {"mse": "l2sq", "sc": "entropy", "jaccard": "bjaccard", "dice": "bdice"}
    if error not in known:
        raise ValueError(f"unknown error function {error!r}")
    return known[error]


def block_kernel(name: str, p: float | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """(queries, rows) -> matrix of distances, or None where only the expression exists."""
    if name == "l2":

        def kernel(a, b):
            square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
            return np.sqrt(np.maximum(square, 0))

        return kernel
    if name == "cos":
        return lambda a, b: 1 - (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None])
    if name in ("l1", "mnkw", "l05"):
        power = {"l1": 1.0, "l05": 0.5}.get(name, 1.0 if p is None else p)
        return lambda a, b: np.stack([(np.abs(b - x) ** power).sum(1) for x in a]) if len(a) else np.empty((0, len(b)))
    return None


def pair_kernel(name: str, p: float | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of paired rows without the cancellation of the block form."""
    if name == "l2":
        return lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))
    if name == "cos":
        return lambda a, b: 1 - (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    power = {"l1": 1.0, "l05": 0.5}.get(name, 1.0 if p is None else p)
    return lambda a, b: (np.abs(a - b) ** power).sum(-1)


def ordered_kernel(name: str, p: float | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of paired rows, added up in the order of the expression, so that the last digits agree."""
    total = lambda t: np.cumsum(t, axis=-1)[..., -1] if t.shape[-1] else np.zeros(t.shape[:-1])
    if name == "l2":
        return lambda a, b: np.sqrt(total((a - b) * (a - b)))
    if name == "cos":
        return lambda a, b: 1 - total(a * b) / np.sqrt(total(a * a) * total(b * b))
    power = {"l1": 1.0, "l05": 0.5}.get(name, 1.0 if p is None else p)
    return lambda a, b: total(np.abs(a - b) if power == 1 else np.abs(a - b) ** power)


def reach(name: str, bound: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far block distances may be rounded up from real ones of at most ``bound``, one for each row of a."""
    eps = 16 * (a.shape[1] + 8) * 2.0**-52
    if name == "l2":
        return np.sqrt(bound**2 + eps * ((a * a).sum(1) + (b * b).sum(1).max(initial=0)))
    return bound + eps * (4 if name == "cos" else bound)


def _edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Unit-cost edit distances of all pairs; the table of all pairs goes forward a row at a time."""
    m = max(map(len, b), default=0)
    right = np.zeros((len(b), m), np.int64)
    for i, x in enumerate(b):
        right[i, : len(x)] = [ord(c) for c in x]
    sizes, out = np.array([len(x) for x in b]), np.empty((len(a), len(b)))
    steps = np.arange(m + 1)
    for i, x in enumerate(a):
        row = np.broadcast_to(steps, (len(b), m + 1)).astype(np.int64)
        for j, c in enumerate(x, 1):
            free = np.empty_like(row)
            free[:, 0] = j
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (right != ord(c)), out=free[:, 1:])
            # insertions: the least of what stands to the left plus the way from there
            row = np.minimum.accumulate(free - steps, axis=1) + steps
        out[i] = row[np.arange(len(b)), sizes] if len(b) else 0
    return out


def _grams(text: str, n: int) -> Counter:
    return Counter(text[i : i + n] for i in range(len(text) - n + 1))


def _gram_distance(x: Counter, y: Counter) -> float:
    size = x.total() + y.total()
    return 1 - 2 * (x & y).total() / size if size else 1.0


def values_kernel(distance: str | Callable, p: float | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(values, values) -> matrix of any distance, for neighbour graphs that try few pairs.

    Values are rows of a matrix for vectors and objects otherwise; the last digits may
    differ from the expression's.
    """
    if callable(distance):

        def own(a, b):
            right = pd.Series(list(b))
            return np.stack([np.asarray(distance(pd.Series([x] * len(right)), right), float) for x in a]) if len(a) else np.empty((0, len(b)))

        return own
    known = block_kernel(distance, p)
    if known is not None:
        return known
    rows = lambda f: lambda a, b: np.stack([f(x, b) for x in a]) if len(a) else np.empty((0, len(b)))
    if distance in ("l2sq", "l2floor"):
        squares = rows(lambda x, b: ((b - x) ** 2).sum(1))
        return squares if distance == "l2sq" else lambda a, b: np.floor(np.sqrt(squares(a, b)))
    if distance == "entropy":
        return rows(lambda x, b: -np.log2(np.maximum(np.where(b > 0, x / 1e6, 1 - x / 1e6), 0.001)).sum(1))
    if distance in ("bjaccard", "bdice"):
        weight = 1 if distance == "bjaccard" else 2

        def mismatch(x, b):
            differ, both = ((x > 0) != (b > 0)).sum(1), ((x > 0) & (b > 0)).sum(1)
            total = differ + weight * both
            return np.where(total > 0, np.round(1e6 * differ / np.maximum(total, 1)), 0.0)

        return rows(mismatch)
    if distance == "lev":
        return lambda a, b: _edit_distances(list(a), list(b))
    if distance == "dice":

        def strings(a, b):
            left, right = ([(_grams(x, 3), _grams(x, 2)) for x in side] for side in (a, b))
            return np.array([[0.9 * _gram_distance(x[0], y[0]) + 0.1 * _gram_distance(x[1], y[1]) for y in right] for x in left]).reshape(len(left), len(right))

        return strings
    if distance == "set":

        def sets(a, b):
            left, right = [set(x) for x in a], [set(x) for x in b]
            return np.array([[1 - 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0 for y in right] for x in left]).reshape(len(left), len(right))

        return sets
    raise ValueError(f"unknown distance {distance!r}")
