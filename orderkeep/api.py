"""The Python API: functions over a table's address and a class that holds one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from orderkeep.config import SortConfig, nulls_first
from orderkeep.operators import rewriter, validator
from orderkeep.plans.metrics import RewriteFigures


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("orderkeep").getOrCreate()


def compact(table_uri: str, sort_columns: Sequence[str], target_file_size_bytes: int | None = None, predicate: str | None = None, concurrency: int | None = None, dry_run: bool | None = None, repartition_by_sort_key: bool | None = None, nulls: str = "first", spark: SparkSession | None = None, commit_per_partition: bool = False) -> list[RewriteFigures]:
    """Sort the partitions that aren't in order, or with repartition_by_sort_key the whole table. Errors are RuntimeErrors.

    By default one job and one commit rewrite all of them; with commit_per_partition each has its own, `concurrency` at once."""
    cfg = SortConfig(tuple(sort_columns), target_file_size_bytes, predicate, 8 if concurrency is None else concurrency, bool(dry_run), bool(repartition_by_sort_key), nulls_first(nulls), commit_per_partition)
    try:
        return rewriter.compact(spark or session(), table_uri, cfg)
    except Exception as e:
        raise RuntimeError(str(e)) from e


def validate(table_uri: str, sort_columns: Sequence[str], nulls: str = "first", spark: SparkSession | None = None) -> dict:
    """The report of a table's order: checked_files, boundary_violations, details_sample. Errors are RuntimeErrors."""
    first = nulls_first(nulls)
    try:
        return validator.validate(spark or session(), table_uri, list(sort_columns), first).as_dict()
    except Exception as e:
        raise RuntimeError(str(e)) from e


# Fixed value: how a table out of order is told.
VIOLATIONS = "Ordering violations: {found} (sample: {sample})"


class SortOptimizer:
    """Compacts and validates one table."""

    def __init__(self, table_uri: str, spark: SparkSession | None = None):
        self.table_uri, self.spark = table_uri, spark

    def compact(self, sort_columns: Sequence[str], target_file_size_bytes: int | None = None, predicate: str | None = None, concurrency: int = 8, dry_run: bool = False, repartition_by_sort_key: bool = False, nulls: str = "first", commit_per_partition: bool = False) -> None:
        compact(self.table_uri, sort_columns, target_file_size_bytes, predicate, concurrency, dry_run, repartition_by_sort_key, nulls, self.spark, commit_per_partition)

    def validate(self, sort_columns: Sequence[str], nulls: str = "first") -> None:
        """Raise a RuntimeError if the table isn't in order."""
        found = validate(self.table_uri, sort_columns, nulls, self.spark)
        if found["boundary_violations"]:
            raise RuntimeError(VIOLATIONS.format(found=found["boundary_violations"], sample=found["details_sample"]))
