"""Incremental views over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from subweave.operators.clean import symmetric


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Clean directed edges of a stream: both directions, no loops, each once. State grows with the graph."""
    return symmetric(edges).where("src <> dst").dropDuplicates(["src", "dst"])


def degrees(edges: DataFrame) -> DataFrame:
    """Running count of edges by source, for update or complete output; repeated edges count again."""
    return symmetric(edges).where("src <> dst").groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def append_to(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the clean edges of a stream to a table that batch queries match patterns on."""
    return distinct_edges(edges).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
