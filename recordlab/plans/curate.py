"""From JSON records to a text corpus and a wide table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlab.operators import quality
from recordlab.operators.narrative import narrative
from recordlab.operators.wide import wide_table
from recordlab.session import stored
from recordlab.sources import records as rec
from recordlab.sources import tables as io


def quality_stages(records: DataFrame, threshold: float = quality.MIN_RATIO, min_age: int = quality.MIN_AGE) -> tuple[DataFrame, DataFrame]:
    """``(statistics, kept)``: statistics of records that passed the first two filters, and the
    records that also pass ratio and age. All row expressions, valid on a stream as well."""
    stats = quality.valid_stats(quality.drop_all_marker(quality.keep_nonempty(records)))
    return stats, quality.filter_quality(stats, threshold, min_age)


def curate(
    spark: SparkSession,
    dirs: Mapping[str, str],
    labels: Mapping[str, int],
    threshold: float = quality.MIN_RATIO,
    min_age: int = quality.MIN_AGE,
    per_line: bool = False,
    out: str | None = None,
    compression: str = "none",
) -> dict[str, DataFrame]:
    """``records, statistics, corpus, wide, rejects``; written below ``out`` when given.

    The records are parsed once: statistics, corpus and wide table branch from the stored
    statistics rows. Rejects read the inputs again when they are asked for. ``compression`` is for the
    files of text below ``out`` (records, statistics, corpus), which may take many times the size of
    the same rows in columns; readers see no difference.
    """
    documents = rec.read_documents(spark, dirs, labels, per_line)
    readable = rec.project_records(documents.where(F.col("doc").isNotNull()))
    stats = stored(quality_stages(readable, threshold, min_age)[0], "records")
    kept = quality.filter_quality(stats, threshold, min_age)
    result = {
        "records": kept,
        "statistics": stats.select("source", "rec_id", "file_name", *io.STATISTICS_COLUMNS),
        "corpus": narrative(kept, "label"),
        "wide": wide_table(kept),
        "rejects": rec.rejects(documents),
    }
    if out:
        io.write_records(kept, f"{out}/records", compression)
        io.write_statistics(result["statistics"], f"{out}/statistics", io.STATISTICS_COLUMNS, compression)
        io.write_corpus(result["corpus"], f"{out}/corpus", compression=compression)
        io.write_wide(result["wide"], f"{out}/wide")
    return result
