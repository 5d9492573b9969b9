"""Run a stream to the end of its available input into a durable Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowloom.session import scratch_path


def stream_table(spark: SparkSession, directory: str, file_name: str, schema) -> DataFrame:
    """A growing table of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(directory)


def late_rows(query: StreamingQuery) -> int:
    """Rows of the query's recent batches that came behind the watermark and were dropped."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def drain(stream: DataFrame, target: str | None = None, checkpoint: str | None = None,
          trigger: dict | None = None, late: list[int] | None = None) -> DataFrame:
    """Append all output the available input yields to ``target`` and return it as a table.

    The number of dropped late rows is appended to ``late``.
    """
    spark = stream.sparkSession
    target = target or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    if late is not None:
        late.append(late_rows(query))
    return spark.read.schema(stream.schema).parquet(target)
