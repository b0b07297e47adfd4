"""Which partitions need a rewrite: those not proven to be in order."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.functions.keys import check_columns
from orderkeep.operators.validator import boundaries, overlapping, snapshot_stats
from orderkeep.sources.tablelog import DataFile, Snapshot

log = logging.getLogger("orderkeep")
WHOLE_TABLE = "(whole table)"


@dataclass
class UnsortedPart:
    """partition: sorted (column, value), None for an unpartitioned table."""

    partition: tuple[tuple[str, str | None], ...] | None
    files: list[DataFile] = field(default_factory=list)
    rows_in: int = 0

    @property
    def input_files(self) -> list[str]:
        return [f.path for f in self.files]

    @property
    def estimated_bytes(self) -> int:
        return sum(f.size for f in self.files)


@dataclass
class Todo:
    table_uri: str
    groups: list[UnsortedPart] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(group_key(g.partition), g.input_files, g.rows_in, g.estimated_bytes) for g in self.groups]
        return spark.createDataFrame(rows, "partition string, input_files array<string>, rows_in long, estimated_bytes long")


def group_key(partition: Sequence[tuple[str, str | None]] | None) -> str:
    """A partition as text. NULL, the empty text and the text null differ."""
    if partition is None:
        return WHOLE_TABLE
    return "/".join(k if v is None else f"{k}={v}" for k, v in partition)


def grouped(snapshot: Snapshot) -> dict[str, UnsortedPart]:
    """The active files by partition, in the order of the partitions' text."""
    out: dict[str, UnsortedPart] = {}
    for f in snapshot.files:
        part = f.partition if snapshot.partition_columns else None
        out.setdefault(group_key(part), UnsortedPart(part)).files.append(f)
    return dict(sorted(out.items()))


def failing(stats: DataFrame, by: str) -> DataFrame:
    """(by, rows): of file stats the groups that have a file out of order inside or a bad boundary."""
    marked = boundaries(stats, [by])
    return marked.groupBy(by).agg(F.sum("n").alias("rows"), F.count_if((F.col("inversions") > 0) | F.col("bad")).alias("violations")).filter("violations > 0").select(by, "rows", "violations")


def plan(spark: SparkSession, snapshot: Snapshot, keys: Sequence[str], nulls_first: bool = True) -> Todo:
    """The partitions that aren't in order; the largest come first. One job finds those whose files overlap by their first
    key, another over all keys of the files of the rest finds the others.

    If the check fails on the data, every partition is taken for unordered; a cancelled job is an error."""
    out = Todo(snapshot.uri)
    if not keys:
        return out
    check_columns(keys, snapshot.schema)
    groups = grouped(snapshot)
    if not groups:
        return out
    try:
        # a partition's files have the same text for it
        names = {json.dumps(g.files[0].partition): k for k, g in groups.items()} if snapshot.partition_columns else {WHOLE_TABLE: WHOLE_TABLE}
        bad: dict[str, int] = {}
        for check, least in ((overlapping, 2), (snapshot_stats, 1)):  # what files' bounds prove needs no look at the rows' order
            rest = snapshot.restrict([f for k, g in groups.items() if k not in bad and len(g.files) >= least for f in g.files])
            if not rest.files:
                continue
            stats = check(spark, rest, keys, nulls_first)
            if not snapshot.partition_columns:
                stats = stats.withColumn("part", F.lit(WHOLE_TABLE))
            bad |= {names[r["part"]]: r["rows"] for r in failing(stats, "part").collect()}  # a row for each partition at most
    except Exception as e:  # not proven to be in order
        if "cancelled" in str(e).lower() or spark.sparkContext._jsc.sc().isStopped():
            raise
        log.error("the order of %s could not be checked, all partitions count as unordered: %s", snapshot.uri, e)
        bad = dict.fromkeys(groups, 0)
    for k in bad:
        groups[k].rows_in = bad[k]
    out.groups = sorted((groups[k] for k in groups if k in bad), key=lambda g: -g.estimated_bytes)
    return out
