"""Reading a table's files: one scan with the log's schema and partition values, with each row's place."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderkeep.functions.keys import column, key_value
from orderkeep.functions.predicates import column_predicate
from orderkeep.sources.tablelog import DataFile, Snapshot

#: A row's file (a path) and its number in the file.
FILE, ROW = "__file", "__row"
#: Up to so many files' partition values are broadcast; more are joined by a shuffle.
MAX_SMALL = 100_000
#: Up to so many partitions are read by a scan of each, their values as literals; of more, rows are joined with their files.
MAX_PARTS = 32
#: Up to so many files are read in key order by a scan of each; beyond, the rows are sorted.
MAX_UNION = 300


def plain_path(path: Column) -> Column:
    """A file's path decoded and without a local scheme, to compare paths of different writing."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def file_ids(spark: SparkSession, snapshot: Snapshot) -> tuple[Column, DataFrame]:
    """(the id of a row's file, from FILE; a table (__id, path, values array in the order of sorted partition columns, group)).

    Ids are hashes of file names where these differ, else of whole paths, so that rows carry a number and not a path.
    group: the partition as JSON."""
    paths = [snapshot.path(f) for f in snapshot.files]
    names = [os.path.basename(p) for p in paths]
    plain = len(set(names)) == len(names) and all(re.fullmatch(r"[A-Za-z0-9._-]+", n) for n in names)
    keys = names if plain else [spark_plain(p) for p in paths]
    own = F.substring_index(F.col(FILE), "/", -1) if plain else plain_path(F.col(FILE))
    rows = [(k, p, [v for _, v in f.partition], json.dumps(f.partition)) for k, p, f in zip(keys, paths, snapshot.files, strict=True)]
    table = spark.createDataFrame(rows, "k string, path string, vs array<string>, part string")
    return F.xxhash64(own), table.select(F.xxhash64("k").alias("__id"), "path", "vs", "part")


def few(df: DataFrame, files: int) -> DataFrame:
    """A table of a row for each file, to be broadcast while files are few."""
    return F.broadcast(df) if files <= MAX_SMALL else df


def scan(spark: SparkSession, snapshot: Snapshot, columns: Sequence[str] | None = None, places: bool = True) -> DataFrame:
    """The snapshot's rows: columns (all by default), and with places FILE and ROW. Only those columns are read."""
    wanted = list(snapshot.schema.fieldNames() if columns is None else columns)
    stored = T.StructType([f for f in snapshot.schema.fields if f.name not in snapshot.partition_columns])
    partition = [c for c in wanted if c in snapshot.partition_columns]
    if not snapshot.files:
        shape = T.StructType([*(snapshot.schema[c] for c in wanted), *([T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())] if places else [])])
        return spark.createDataFrame([], shape)
    own = [column(c) for c in wanted if c not in snapshot.partition_columns]
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]

    def stored_rows(files: Iterable[DataFile]) -> DataFrame:
        # a path below the table may look like a partition's: no value is taken from it
        return spark.read.schema(stored).option("recursiveFileLookup", "true").option("__globPaths__", "false").parquet(*(snapshot.path(f) for f in files))

    if not partition:
        return stored_rows(snapshot.files).select(*own, *(place if places else []))
    parts: dict[tuple, list[DataFile]] = {}
    for f in snapshot.files:
        parts.setdefault(f.partition, []).append(f)
    if len(parts) <= MAX_PARTS:

        def one(values: dict[str, str | None], files: list[DataFile]) -> DataFrame:
            told = [F.lit(values.get(c)).cast(snapshot.schema[c].dataType).alias(c) if c in partition else column(c) for c in wanted]
            return stored_rows(files).select(*told, *(place if places else []))

        return reduce(DataFrame.unionAll, [one(dict(values), files) for values, files in parts.items()])
    rows = stored_rows(snapshot.files)
    ids, files = file_ids(spark, snapshot)
    names = sorted(snapshot.partition_columns)
    typed = [F.get("vs", F.lit(names.index(c))).cast(snapshot.schema[c].dataType).alias(c) for c in partition]
    joined = rows.select(*own, *place).withColumn("__id", ids).join(few(files.select("__id", *typed), len(snapshot.files)), "__id")
    return joined.select(*map(column, wanted), *([FILE, ROW] if places else []))


def read_partition(spark: SparkSession, snapshot: Snapshot, partition: Sequence[tuple[str, str | None]], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of one partition, by its (column, value) pairs as the log has them: its files are found exactly, and rows
    are held against the values as the columns' types read them."""
    wanted = tuple(sorted(partition))
    part = snapshot.restrict(f for f in snapshot.files if f.partition == wanted)
    rows = scan(spark, part, places=False).filter(column_predicate(wanted, snapshot.schema))
    return rows if columns is None else rows.select(*map(column, columns))


def stats_by_file(rows: DataFrame, keys: Sequence[str], nulls_first: bool = True) -> DataFrame:
    """(file, n, mn, mx): of rows with FILE and ROW each file's number of rows and least and greatest key."""
    key = key_value(keys, nulls_first)
    # the empty list makes Spark aggregate by hashing: of structs alone it takes minima by a sort of all rows
    n = (F.count("*") + F.size(F.collect_list(F.lit(None).cast("int")))).alias("n")
    return rows.groupBy(F.col(FILE).alias("file")).agg(n, F.min(key).alias("mn"), F.max(key).alias("mx"))


def read_ordered(spark: SparkSession, snapshot: Snapshot, keys: Sequence[str], nulls_first: bool = True) -> DataFrame:
    """The table's rows in key order.

    If the files are in order and few, scans in the order of their least keys, end to end, give it without a sort; else
    the rows are sorted."""
    from orderkeep.functions.keys import sort_by
    from orderkeep.operators.validator import validate_snapshot

    whole = snapshot.schema.fieldNames()
    if not snapshot.files:
        return scan(spark, snapshot, whole, places=False)
    if len(snapshot.files) > MAX_UNION or validate_snapshot(spark, snapshot, keys, nulls_first).boundary_violations:
        return scan(spark, snapshot, whole, places=False).orderBy(*sort_by(keys, nulls_first))
    order = stats_by_file(scan(spark, snapshot, keys), keys, nulls_first).orderBy("mn", "mx", "file").select(plain_path(F.col("file"))).collect()
    place = {r[0]: i for i, r in enumerate(order)}
    plain = {f: spark_plain(snapshot.path(f)) for f in snapshot.files}
    files = sorted((f for f in snapshot.files if plain[f] in place), key=lambda f: place[plain[f]])
    if not files:
        return scan(spark, snapshot, whole, places=False)
    return reduce(DataFrame.unionAll, [scan(spark, snapshot.restrict([f]), whole, places=False) for f in files])


def spark_plain(path: str) -> str:
    """plain_path() of a path that isn't percent-encoded."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:/") else path


def positions(rows: DataFrame, keys: Sequence[str], nulls_first: bool = True) -> DataFrame:
    """rows with `position`, from 1: a row's place in the physical layout, files taken in key order. No sort of rows, no shuffle
    of them: what is broadcast has a row for each file, as the driver's own list has."""
    from pyspark.sql import Window

    stats = stats_by_file(rows, keys, nulls_first)
    order = Window.orderBy("mn", "mx", "file")
    begins = stats.select(F.col("file").alias("__f"), (F.sum("n").over(order) - F.col("n")).alias("__begin"))  # a row for each file
    return rows.join(F.broadcast(begins), F.col(FILE) == F.col("__f")).withColumn("position", F.col("__begin") + F.col(ROW) + 1).drop("__f", "__begin")
