"""Counting ordering violations, inside files and between them.

Inside a file the key of each row is compared with that of the row before. Files are cut into chunks of rows, each a
window of its own, and the chunks' edges are compared in a small second step, so that a large file does not end up in
one task. Between files the greatest key of a file is compared with the least of the next, files ordered by their least
key, then greatest, then path; that step sees a row for each file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderkeep.functions.keys import check_columns, column, key_value
from orderkeep.sources.reader import FILE, ROW, few, file_ids, scan, stats_by_file
from orderkeep.sources.tablelog import Snapshot, open_table

#: Types whose least and greatest values Spark updates in place.
PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Rows of a file that one window covers.
CHUNK_ROWS = 1 << 16
# How violations are told.
INSIDE, BETWEEN, LEFT_OUT = "monotonicity violation within file: ", ("boundary violation: ", " max > ", " min"), ("... plus ", " more violations")
#: A report shows so many violations; of more, one less and how many were left out.
SAMPLE = 20


@dataclass
class ValidationReport:
    checked_files: int = 0
    boundary_violations: int = 0
    details_sample: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {"checked_files": self.checked_files, "boundary_violations": self.boundary_violations, "details_sample": list(self.details_sample)}


def file_stats(rows: DataFrame, key: Column, file: str = FILE, row: str = ROW, by: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(*by, file, n, inversions, mn, mx) for each file of rows that say their file and their number in it.

    inversions: rows whose key is less than that of the row before. One shuffle, of keys; by: columns constant in a file."""
    group = [*by, "file", "__chunk"]
    keyed = rows.select(*by, F.col(file).alias("file"), F.col(row).alias("__row"), key.alias("__key")).withColumn("__chunk", F.floor(F.col("__row") / chunk_rows))
    before = F.lag("__key").over(Window.partitionBy(*group).orderBy("__row"))
    chunks = keyed.withColumn("__down", before > F.col("__key")).groupBy(*group).agg(F.count("*").alias("n"), F.count_if("__down").alias("down"), F.min("__key").alias("mn"), F.max("__key").alias("mx"), F.min_by("__key", "__row").alias("first"), F.max_by("__key", "__row").alias("last"))
    edge = F.lag("last").over(Window.partitionBy(*by, "file").orderBy("__chunk")) > F.col("first")
    return chunks.withColumn("__edge", edge).groupBy(*by, "file").agg(F.sum("n").alias("n"), (F.sum("down") + F.count_if("__edge")).alias("inversions"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def boundaries(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """stats with the file before each in key order (within by) and whether its greatest key exceeds this file's least.

    Only neighbours are compared: whether any boundary is bad is the same as with a running greatest key, the count not."""
    order = Window.partitionBy(*by).orderBy("mn", "mx", "file")
    both = stats.withColumns({"before": F.lag("file").over(order), "__mx": F.lag("mx").over(order)})
    return both.withColumn("bad", F.coalesce(F.col("__mx") > F.col("mn"), F.lit(False))).drop("__mx")


def violations(stats: DataFrame) -> DataFrame:
    """(kind, file, detail): a row for each file out of order inside (kind 0) and for each bad boundary (kind 1)."""
    inner = stats.filter("inversions > 0").select(F.lit(0).alias("kind"), "file", F.concat(F.lit(INSIDE), "file").alias("detail"))
    between = boundaries(stats).filter("bad").select(F.lit(1).alias("kind"), "file", F.concat(F.lit(BETWEEN[0]), "before", F.lit(BETWEEN[1]), "file", F.lit(BETWEEN[2])).alias("detail"))
    return inner.unionByName(between)


def sampled(found: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(position, detail): the details in order; of more than `most`, one less and a line that says how many were left out."""
    # a row for each violating file at most; ranks come from the ordered head
    total = found.agg(F.count("*").alias("total"))
    head = found.orderBy("kind", "file", "detail").limit(most)
    numbered = head.select(F.row_number().over(Window.orderBy("kind", "file", "detail")).alias("position"), "detail")
    text = F.when((F.col("total") > most) & (F.col("position") == most), F.concat(F.lit(LEFT_OUT[0]), (F.col("total") - most + 1).cast("string"), F.lit(LEFT_OUT[1]))).otherwise(F.col("detail"))
    return numbered.crossJoin(F.broadcast(total)).select(F.col("position").cast("long").alias("position"), text.alias("detail"))  # total is one row


def report(stats: DataFrame) -> DataFrame:
    """(checked_files, boundary_violations), one row; violations are files out of order inside plus bad boundaries."""
    marked = boundaries(stats)
    return marked.agg(F.count("*").alias("checked_files"), (F.count_if(F.col("inversions") > 0) + F.count_if("bad")).alias("boundary_violations"))


def snapshot_stats(spark: SparkSession, snapshot: Snapshot, keys: Sequence[str], nulls_first: bool = True) -> DataFrame:
    """file_stats() of a table's files, with their partition as `part`; a row's file is a number until the end."""
    ids, files = file_ids(spark, snapshot)
    rows = scan(spark, snapshot, keys).withColumn("__id", ids)
    stats = file_stats(rows, key_value(keys, nulls_first), file="__id")
    return stats.withColumnRenamed("file", "__id").join(few(files.select("__id", F.col("path").alias("file"), "part"), len(snapshot.files)), "__id").drop("__id")


def overlapping(spark: SparkSession, snapshot: Snapshot, keys: Sequence[str], nulls_first: bool = True) -> DataFrame:
    """Stats of a table's files as snapshot_stats() has them, but by the first key alone that isn't constant in a partition,
    and without what lies inside files (inversions 0). A bad boundary by that key is one by all keys; none proves nothing.

    Rows are counted where they are read, with no shuffle or sort of them."""
    key = next((k for k in keys if k not in snapshot.partition_columns), keys[0])
    rows = scan(spark, snapshot, [key])
    if isinstance(snapshot.schema[key].dataType, PLAIN):  # by Spark's faster aggregation; NULLs are then no bounds, wherever they stand
        bounds = rows.groupBy(FILE).agg(F.count("*").alias("n"), F.min(column(key)).alias("mn"), F.max(column(key)).alias("mx"))
    else:
        bounds = stats_by_file(rows, [key], nulls_first).withColumnRenamed("file", FILE)
    ids, files = file_ids(spark, snapshot)
    named = bounds.withColumn("__id", ids).join(few(files.select("__id", F.col("path").alias("file"), "part"), len(snapshot.files)), "__id")
    return named.withColumn("inversions", F.lit(0)).drop("__id", FILE)


def validate_snapshot(spark: SparkSession, snapshot: Snapshot, keys: Sequence[str], nulls_first: bool = True) -> ValidationReport:
    if not keys or not snapshot.files:
        return ValidationReport()
    check_columns(keys, snapshot.schema)
    stats = snapshot_stats(spark, snapshot, keys, nulls_first).persist()  # a row for each file
    try:
        counts = report(stats).first()
        details = [r.detail for r in sampled(violations(stats)).orderBy("position").collect()] if counts["boundary_violations"] else []
    finally:
        stats.unpersist()
    return ValidationReport(counts["checked_files"], counts["boundary_violations"], details)


def validate(spark: SparkSession, table_uri: str, sort_columns: Sequence[str], nulls_first: bool = True) -> ValidationReport:
    """Whether a table's files, as one sequence, are in order. A missing table is an error; empty files don't count."""
    return validate_snapshot(spark, open_table(spark, table_uri), sort_columns, nulls_first)
