"""What rewrites read and wrote."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class RewriteFigures:
    partition: str
    files_in: int
    files_out: int
    bytes_in: int
    bytes_out: int
    duration_ms: int


def frame(spark: SparkSession, metrics: Sequence[RewriteFigures]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(m).values()) for m in metrics], "partition string, files_in long, files_out long, bytes_in long, bytes_out long, duration_ms long")


def totals(metrics: DataFrame) -> DataFrame:
    """One row for a whole run."""
    return metrics.agg(F.count("*").alias("partitions"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files_in", "files_out", "bytes_in", "bytes_out")))
