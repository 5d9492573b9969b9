"""Frame and flow files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from flowloom.operators.columns import assert_unique_header, quoted, rename_features, select_features
from flowloom.schemas import CAPTURED_FRAMES, flow_schema
from flowloom.sources.grown import stream_lines


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Captured frames from Parquet (a file stream if ``streaming``), empty ones skipped; for capture files see ``captures``.

    ``capture_no`` tells captures apart that number frames alike; files without it are one capture, 0.
    """
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(CAPTURED_FRAMES).parquet(path).filter(F.length("raw") > 0)
    return rows.withColumn("capture_no", F.coalesce("capture_no", F.lit(0)))


def _header_of(spark: SparkSession, path: str) -> list[str]:
    # a header read touches the first line of one file only
    return assert_unique_header(spark.read.option("header", True).csv(path).columns)


def _in_file_order(header: list[str], style: str) -> T.StructType:
    """The typed columns of ``style`` in the order of a file's header; a lacking column is an error."""
    types = {f.name: f for f in flow_schema(style)}
    lacking = [n for n in types if n not in header]
    if lacking:
        raise ValueError(f"columns missing in the file: {lacking}")
    return T.StructType([types.get(n, T.StructField(n, T.StringType())) for n in header])


def read_flow_csv(spark: SparkSession, path: str, style: str | None = None) -> DataFrame:
    """A flow CSV with every cell as text, or the typed columns of a named header style.

    Columns are found by name, in whatever order the files have them; files of one path whose headers
    differ from each other are an error. Bytes that are no UTF-8 are left out. A row with cells lacking, too many or not of their
    column's type is an error; ``split_flow_csv`` sets such rows aside.
    """
    header = _header_of(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header]) if style is None else _in_file_order(header, style)
    rows = (spark.read.option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").option("mode", "FAILFAST")
            .option("columnPruning", False).schema(schema).csv(path))
    wanted = header if style is None else flow_schema(style).fieldNames()
    texts = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    return rows.select(*[(F.replace(quoted(n), F.lit("\ufffd"), F.lit("")) if n in texts else quoted(n)).alias(n) for n in wanted])


def judge_flow_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Adds to CSV lines (``line``) the columns of ``schema`` as ``flow`` and, for lines that aren't rows of it, ``reason``:

    ``cell_count`` (cells lacking or too many) or ``cell_type`` (a cell that its column can't hold).
    """
    marked = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    flow = F.from_csv("line", _ddl(marked), {"columnNameOfCorruptRecord": "_line", "mode": "PERMISSIVE"})
    cells = F.length(F.regexp_replace(F.regexp_replace("line", '"[^"]*"', ""), "[^,]", "")) + 1
    rows = lines.withColumn("flow", flow)
    return rows.withColumn("reason", F.when(F.col("flow").isNotNull() & F.col("flow._line").isNull(), F.lit(None).cast("string"))
                           .when(cells != len(schema), "cell_count").otherwise("cell_type"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _flow_columns(judged: DataFrame, names: list[str]) -> DataFrame:
    return judged.filter("reason IS NULL").select(*[F.col("flow").getField(n).alias(n) for n in names])


def split_flow_csv(spark: SparkSession, path: str, style: str = "short") -> tuple[DataFrame, DataFrame]:
    """The typed rows of flow CSV files, and the lines that are none: ``path``, ``line``, ``reason`` (see ``judge_flow_lines``)."""
    header = _header_of(spark, path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    judged = judge_flow_lines(lines.filter(~F.col("line").isin(",".join(header), "")), _in_file_order(header, style))
    return _flow_columns(judged, flow_schema(style).fieldNames()), judged.filter("reason IS NOT NULL").select("path", "line", "reason")


def stream_flow_lines(spark: SparkSession, directory: str, style: str = "short", header: list[str] | None = None) -> DataFrame:
    """Judged lines of flow CSV files as they are written (see ``judge_flow_lines``), headers left out.

    Files may grow, and be recreated under their names (see ``grown``). A file's columns must stand in the order of ``header``, by
    default the style's own: another header line is an error.
    """
    names = header or flow_schema(style).fieldNames()
    lines = stream_lines(spark, directory)
    other = F.raise_error(F.concat(F.lit("another header in "), F.col("path")))
    is_header = F.when(F.col("at") > 0, False).when(F.col("line") == ",".join(names), True).otherwise(other.cast("boolean"))
    return judge_flow_lines(lines.filter(~is_header & (F.col("line") != "")), _in_file_order(names, style))


def stream_flow_csv(spark: SparkSession, directory: str, style: str = "short", header: list[str] | None = None) -> DataFrame:
    """Rows of flow CSV files as they are written; lines that are no rows are left to ``stream_flow_lines``."""
    return _flow_columns(stream_flow_lines(spark, directory, style, header), flow_schema(style).fieldNames())


def write_flow_csv(flows: DataFrame, path: str, header_style: str = "short") -> None:
    """Export the 88 columns with a header, replacing ``path``; no flows give a header-only file."""
    table = select_features(flows, header_style)
    table.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def rename_flow_csv(spark: SparkSession, source: str, target: str, style: str = "cic2017") -> None:
    """Rewrite a flow CSV under other header names; rows are unchanged."""
    table = rename_features(read_flow_csv(spark, source), style)
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(target)


def stream_flows_csv(flows: DataFrame, path: str, checkpoint: str, header_style: str = "short",
                     every: str = "5 seconds") -> DataStreamWriter:
    """Continuous CSV append of a flow stream, by default each 5 seconds; start the returned writer.

    ``.trigger(...)`` on the writer chooses another rhythm, such as ``availableNow=True``.
    """
    return (select_features(flows, header_style).writeStream.outputMode("append").format("csv").trigger(processingTime=every)
            .option("header", True).option("path", path).option("checkpointLocation", checkpoint))
