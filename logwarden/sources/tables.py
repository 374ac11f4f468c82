"""Typed sinks and sources for parsed events, labels, incidents and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import schema

_LABEL_FORMAT = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}


def write_parsed(parsed: DataFrame, path: str, file_format: str = "parquet") -> None:
    options = {"header": True} if file_format == "csv" else {}
    parsed.write.mode("overwrite").format(file_format).options(**options).save(path)


def read_parsed(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema.parsed_schema()).format(file_format)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def labels_of(numbered_events: DataFrame) -> DataFrame:
    """The label table: labelled rows only, by their line in the ordered output."""
    kept = [c for c in ("seed", "condition") if c in numbered_events.columns]
    return numbered_events.filter(F.col("scenario").isNotNull()).select(
        *kept, "line_number", F.col("ts").alias("timestamp"), "user", "scenario",
        F.col("instance").cast("int").alias("instance"), "description",
    )


def write_labels(labels: DataFrame, path: str) -> None:
    ordered = labels.select("line_number", "timestamp", "user", "scenario", "instance", "description")
    writer = ordered.orderBy("line_number").write.mode("overwrite").options(**_LABEL_FORMAT)
    writer.csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.labels_schema()).options(**_LABEL_FORMAT).csv(path)


def write_incidents(records: DataFrame, path: str) -> None:
    """One JSON record per line."""
    records.write.mode("overwrite").json(path)


def read_incidents(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Incident records; ``array_file`` reads one JSON array, with the events inside each record, instead of lines."""
    fields = schema.incident_schema(nested=array_file)
    return spark.read.schema(fields).json(path, multiLine=array_file, mode="FAILFAST")


def write_incident_events(events: DataFrame, path: str) -> None:
    """One JSON record per event."""
    events.write.mode("overwrite").json(path)


def read_incident_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.incident_events_schema()).json(path, mode="FAILFAST")


def write_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
