"""Risk scores for rows that keep arriving: scoring is a stateless map, so it needs no state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hazardline.operators.forest import Forests


def score_stream(rows: DataFrame, forests: Forests, key: str = "ID", features: str = "features", out: str = "risk_score") -> DataFrame:
    return rows.select(key, forests.score_column(features).alias(out))


def write_score_stream(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scores of everything available now as parquet, then stop; rerunning picks up new input only."""
    writer = scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
