"""Labels for points that arrive after a model was fitted.

A new point takes the label of its nearest cluster centroid; the codebook of
centroids has a row for each cluster, so the stream needs no state, and only ids and
labels of a batch are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.quantize import nearest_code
from ..plans.cut import cut
from ..plans.model import Model


def label_batch(batch: DataFrame, model: Model, id_col: str = "id", value_col: str = "value") -> DataFrame:
    """(id, code, error) of a batch."""
    book = model.centroids().select("code", "vector")
    return nearest_code(batch.select(batch[id_col].alias("id"), batch[value_col].alias("vector")), book)


def label_stream(stream: DataFrame, model: Model, path: str, checkpoint: str, id_col: str = "id", value_col: str = "value"):
    """Starts a query that appends every batch's labels to a parquet table."""
    book = cut(model.centroids().select("code", "vector"))

    def write(batch: DataFrame, number: int) -> None:
        found = nearest_code(batch.select(batch[id_col].alias("id"), batch[value_col].alias("vector")), book)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again writes the same rows

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
