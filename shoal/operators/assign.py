"""Labels by the nearest representative: one narrow pass over all points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions import vec
from shoal.operators import kernel
from shoal.runtime import ship

#: Representative coordinates up to which the comparison is generated as code; beyond, it runs in numpy.
INLINE = 400
#: Representatives are parameters of a model: clusters times c. More than this is no model.
MOST_REPS = 200_000


def collect_reps(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(label, rep) rows of a model as arrays."""
    rows = reps.select("label", "rep").orderBy("label", "rep").limit(MOST_REPS + 1).collect()
    if len(rows) > MOST_REPS:
        raise ValueError(f"over {MOST_REPS} representatives")
    return np.array([r["rep"] for r in rows], dtype=float), np.array([r["label"] for r in rows], dtype=np.int64)


def nearest_rep(points: DataFrame, reps: np.ndarray, labels: np.ndarray, metric: str = "euclidean", keep: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, *keep, label, dist): the label of the nearest representative, ties to the smaller label.

    Works on a streaming table too. Without representatives every label is 0.
    """
    if not len(reps):
        return points.select("point_id", *keep, F.lit(0).alias("label"), F.lit(None).cast("double").alias("dist"))
    d = reps.shape[1]
    if metric == "euclidean" and d <= vec.UNROLL and reps.size <= INLINE:
        options = [
            F.struct(sum(((F.col("features")[i] - float(r[i])) * (F.col("features")[i] - float(r[i])) for i in range(d)), F.lit(0.0)).alias("s"), F.lit(int(l)).alias("label"))
            for r, l in zip(reps, labels, strict=True)
        ]
        best = F.least(*options) if len(options) > 1 else options[0]
        return points.select("point_id", *keep, best.alias("b")).select("point_id", *keep, F.col("b.label").cast("int").alias("label"), F.sqrt("b.s").alias("dist"))
    ship(points.sparkSession)
    shared = (reps, labels)
    rows = points.select("point_id", *keep, F.col("features").alias("compared"))
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            label, dist = kernel.nearest_rep(x, *shared, metric) if batch.num_rows else (np.empty(0, np.int64), np.empty(0))
            cols = [batch.column(i) for i in range(len(kept))] + [pa.array(label.astype(np.int32)), pa.array(dist)]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "label", "dist"])

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "label int", "dist double"]))
