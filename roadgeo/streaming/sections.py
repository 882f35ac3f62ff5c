"""Feeds of sections: an extension beyond batch use; each micro-batch is normalised and kept by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleaning as K
from ..sources.sinks import write_table


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New CSV files below a folder as they come, normalised."""
    return K.normalized(spark.readStream.schema(schema).option("header", True).csv(path))


def keep(sections: DataFrame, path: str, checkpoint: str, by: str = "FSystem") -> StreamingQuery:
    """Append each micro-batch to a table; runs over what is there, then ends."""
    return sections.writeStream.foreachBatch(lambda df, _: write_table(df, path, by=by, mode="append")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
