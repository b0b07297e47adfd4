"""Rewriting partitions, or a whole table, in sorted order.

One range partitioning deals the rows to tasks by partition columns and keys, so that a large partition is spread over
many tasks and files' key ranges don't overlap; each task sorts what it got with the partition columns first, as the
writer would otherwise sort again by them and lose the order. New files enter the table by a commit, which also removes
those they replace; a run that fails leaves the table as it was.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from orderkeep.config import SortConfig
from orderkeep.functions.keys import MissingColumns, check_columns, sort_by
from orderkeep.functions.predicates import sql_predicate
from orderkeep.plans.metrics import RewriteFigures
from orderkeep.plans.planner import UnsortedPart, Todo, group_key, plan
from orderkeep.sources.reader import scan
from orderkeep.sources.tablelog import DataFile, Snapshot, commit, open_table, write_files

log = logging.getLogger("orderkeep")
#: Bytes of input for each task of a rewrite, where no file size is asked for.
TASK_BYTES = 32 << 20


def sorted_rows(rows: DataFrame, keys: Sequence[str], nulls_first: bool, partition_columns: Sequence[str], tasks: int, partitions_first: bool = True) -> DataFrame:
    """rows dealt by ranges and sorted in each task, partition columns first. partitions_first: ranges are of partition
    columns and keys; else of keys alone, and a partition's files may come from any task."""
    keys_only = sort_by(keys, nulls_first)
    within = [*sort_by([c for c in partition_columns]), *keys_only]
    return rows.repartitionByRange(max(1, tasks), *(within if partitions_first else keys_only)).sortWithinPartitions(*within)


def _tasks(spark: SparkSession, files: Sequence[DataFile], target: int | None) -> tuple[int, int]:
    """(tasks, bytes in). Where files are small, a task writes many of them, one after the other, cut by their rows."""
    size = sum(f.size for f in files)
    whole = -(-size // TASK_BYTES)
    return max(1, min(-(-size // target), max(whole, spark.sparkContext.defaultParallelism)) if target else whole), size


def _rows_per_file(rows: int, size: int, target: int | None) -> int:
    return max(1, int(rows * target / size)) if target and size and rows else 0


def rewrite(spark: SparkSession, snapshot: Snapshot, groups: Sequence[UnsortedPart], cfg: SortConfig) -> list[DataFile]:
    """New files with the groups' rows in order; not yet in the table."""
    part = snapshot.restrict([f for g in groups for f in g.files])
    tasks, size = _tasks(spark, part.files, cfg.target_file_size_bytes)
    rows = scan(spark, part, places=False)
    count = sum(g.rows_in for g in groups) or (rows.count() if cfg.target_file_size_bytes else 0)
    ordered = sorted_rows(rows, cfg.sort_columns, cfg.nulls_first, snapshot.partition_columns, tasks)
    return write_files(spark, snapshot.uri, ordered, snapshot.partition_columns, _rows_per_file(count, size, cfg.target_file_size_bytes))


def _measured(group: UnsortedPart, new: Sequence[DataFile], ms: int) -> RewriteFigures:
    own = [f for f in new if group.partition is None or f.partition == group.partition]
    return RewriteFigures(group_key(group.partition), len(group.files), len(own), group.estimated_bytes, sum(f.size for f in own), ms)


def _publish(spark: SparkSession, snapshot: Snapshot, groups: Sequence[UnsortedPart], cfg: SortConfig) -> list[RewriteFigures]:
    began = time.monotonic()
    new = rewrite(spark, snapshot, groups, cfg)
    types = {f.name: f.dataType.typeName() for f in snapshot.schema.fields}
    named = " OR ".join(f"({sql_predicate(g.partition, types)})" for g in groups if g.partition) or "TRUE"
    version = commit(spark, snapshot, new, [f for g in groups for f in g.files], "WRITE", {"mode": "Overwrite", "predicate": named}, False)
    ms = int(1000 * (time.monotonic() - began))
    out = [_measured(g, new, ms) for g in groups]
    for m in out:
        log.info("rewrote partition %s in version %d: files %d -> %d, bytes %d -> %d, %d ms", m.partition, version, m.files_in, m.files_out, m.bytes_in, m.bytes_out, m.duration_ms)
    return out


def compact_partitions(spark: SparkSession, snapshot: Snapshot, todo: Todo, cfg: SortConfig) -> list[RewriteFigures]:
    """Rewrite a plan's partitions: by one job and commit, or, if asked for, each by its own, cfg.concurrency at once.

    In the second case all run to their end before the first error is raised; what was committed stays."""
    if not todo.groups:
        return []
    if not cfg.commit_per_partition:
        return _publish(spark, snapshot, todo.groups, cfg)
    with ThreadPoolExecutor(max(1, cfg.concurrency)) as pool:
        runs = [pool.submit(_publish, spark, snapshot, [g], cfg) for g in todo.groups]
    return [m for r in runs for m in r.result()]


def overwrite_sorted(spark: SparkSession, snapshot: Snapshot, cfg: SortConfig) -> list[RewriteFigures]:
    """Rewrite the whole table in key order, in one commit.

    Of a partitioned table each range of keys has a file for each partition in it; the table as a whole is in order where
    the key begins with the partition columns."""
    began = time.monotonic()
    check_columns(cfg.sort_columns, snapshot.schema)
    rows = scan(spark, snapshot, places=False)
    tasks, size = _tasks(spark, snapshot.files, cfg.target_file_size_bytes)
    one = [c for c in snapshot.schema.fieldNames() if c not in snapshot.partition_columns][:1]
    limit = _rows_per_file(scan(spark, snapshot, one, places=False).count(), size, cfg.target_file_size_bytes) if cfg.target_file_size_bytes else 0
    ordered = sorted_rows(rows, cfg.sort_columns, cfg.nulls_first, snapshot.partition_columns, tasks, partitions_first=False)
    new = write_files(spark, snapshot.uri, ordered, snapshot.partition_columns, limit)
    commit(spark, snapshot, new, snapshot.files, "WRITE", {"mode": "Overwrite"}, False)
    m = RewriteFigures("*", len(snapshot.files), len(new), size, sum(f.size for f in new), int(1000 * (time.monotonic() - began)))
    log.info("rewrote the table: files %d -> %d, bytes %d -> %d, %d ms", m.files_in, m.files_out, m.bytes_in, m.bytes_out, m.duration_ms)
    return [m]


def compact(spark: SparkSession, table_uri: str, cfg: SortConfig) -> list[RewriteFigures]:
    """Bring a table's partitions, or all of it, into order. A dry run plans only, and forgives that nothing
    could be planned, unless columns are missing."""
    if cfg.predicate:
        log.warning("predicate is reserved and not applied: %s", cfg.predicate)
    if cfg.repartition_by_sort_key:
        log.warning("the whole table will be rewritten in the order of %s", list(cfg.sort_columns))
        if cfg.dry_run or not cfg.sort_columns:
            return []
        return overwrite_sorted(spark, open_table(spark, table_uri), cfg)
    began = time.monotonic()
    try:
        snapshot = open_table(spark, table_uri)
        todo = plan(spark, snapshot, cfg.sort_columns, cfg.nulls_first)
    except Exception as e:
        if not cfg.dry_run or isinstance(e, MissingColumns):
            raise
        log.warning("nothing could be planned: %s", e)
        return []
    for g in todo.groups:
        log.info("to be rewritten: %s, %d files, %d bytes", group_key(g.partition), len(g.files), g.estimated_bytes)
    if cfg.dry_run:
        return []
    out = compact_partitions(spark, snapshot, todo, cfg)
    _summary(out, began)
    return out


def _summary(figures: Sequence[RewriteFigures], began: float) -> None:
    """One line for a whole run."""
    total = {c: sum(getattr(m, c) for m in figures) for c in ("files_in", "files_out", "bytes_in", "bytes_out")}
    log.info("rewrote %d partitions: files %d -> %d, bytes %d -> %d, %d ms", len(figures), *total.values(), int(1000 * (time.monotonic() - began)))
