"""Labelling a stream of points with a fitted model: map-only, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from shoal.plans.base import ClusterModel


def label_stream(points: DataFrame, model: ClusterModel) -> DataFrame:
    """(point_id, label, dist) of a streaming table (point_id, features)."""
    return model.predict(points)


def write_labels(points: DataFrame, model: ClusterModel, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of labels as Parquet files; start it with ``start()``."""
    out = label_stream(points, model).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint)
