"""Scoring of applications as they arrive.

Scoring has no state: every row is scored alone, so a stream gives the same
rows as a batch over the same files.
"""

from pyspark.sql import DataFrame, SparkSession

from riskspark.operators.scoring import score_applicants
from riskspark.sources.loans import parse_applicants


def read_applications(spark: SparkSession, path: str, schema, fmt="parquet", max_files=None) -> DataFrame:
    """Stream of files with raw applications."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_json_applications(spark: SparkSession, path: str, max_files=None, id_field=None) -> DataFrame:
    """Stream of text files with one JSON applicant per line; `id_field` is kept beside it."""
    lines = read_applications(spark, path, "value string", "text", max_files)
    return parse_applicants(lines, "value", id_field=id_field)


def start_scoring(applications: DataFrame, score, out: str, checkpoint: str, available_now=True):
    """Start writing score(applications) as parquet; exactly once per file.

    `score` maps a frame to a frame, for batch and stream alike. With
    available_now the query ends when all present files are done.
    """
    writer = (
        score(applications).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_model_scoring(applications: DataFrame, model, out: str, checkpoint: str, threshold=None, available_now=True):
    """Score a stream of applications with a stored model."""
    return start_scoring(applications, lambda df: score_applicants(df, model, threshold), out, checkpoint, available_now)
