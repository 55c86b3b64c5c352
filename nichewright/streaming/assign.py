"""Assignment of arriving cells to stored references: stateless, so a stream and a table take the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nichewright.operators.assignment import landmark_candidates


def nearest_reference(arriving: DataFrame, reference: DataFrame) -> DataFrame:
    """(row_idx, landmark, distance) of (row_idx, z), batch or streaming, by the squared Euclidean distance to a bounded reference."""
    near = landmark_candidates(arriving, reference, 1)
    return near.select(F.col("i").alias("row_idx"), F.col("j").alias("landmark"), "distance")


def assign_stream(arriving: DataFrame, reference: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the assignments of a stream to a Parquet table; the checkpoint makes each cell's row appear once."""
    return nearest_reference(arriving, reference).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
