"""A page with a sample of every cluster's members."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import sample_per_group

SAMPLES = 20


def cluster_samples(texts: DataFrame, labels: DataFrame, k: int = SAMPLES, seed: int = 1) -> DataFrame:
    """(label, size, samples): at most k random members of each cluster."""
    both = texts.join(labels, "id")
    sizes = both.groupBy("label").agg(F.count("*").alias("size"))
    some = sample_per_group(both, k, "label", "id", seed).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("s"))
    return sizes.join(some, "label").select("label", "size", F.transform("s", lambda x: x["text"]).alias("samples"))


def first_lists(edges: DataFrame, n: int) -> DataFrame:
    """(src, near): the neighbours of the first n points, for a look at a graph."""
    first = edges.select("src").distinct().orderBy("src").limit(n)
    near = edges.join(F.broadcast(first), "src").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("e"))
    return near.select("src", F.concat_ws(" ", F.transform("e", lambda x: x["dst"].cast("string"))).alias("near"))


def page(samples: DataFrame) -> str:
    parts = []
    for r in samples.orderBy("label").toLocalIterator():
        items = " ".join(f"<li>{html.escape(t or '')}</li>" for t in r.samples)
        parts.append(f"<hr/><b>Cluster {r.label} (size={r.size})</b>, {len(r.samples)} samples <ul>{items}</ul>")
    return "<html><head></head><body>\n" + "\n".join(parts) + "\n</body></html>\n"
