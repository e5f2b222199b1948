"""The record filters on a stream of JSON lines.

The filters are stateless row expressions, so the batch functions are used as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordlab.operators import quality
from recordlab.plans.curate import quality_stages
from recordlab.sources.records import parse_documents, project_records


def read_record_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines that appear below ``path``."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def filter_stream(
    lines: DataFrame, threshold: float = quality.MIN_RATIO, min_age: int = quality.MIN_AGE
) -> DataFrame:
    records = project_records(parse_documents(lines).where(F.col("doc").isNotNull()))
    return quality_stages(records, threshold, min_age)[1]


def start_filter(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything available and stop; restarting continues from the checkpoint."""
    return (
        filter_stream(lines)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
