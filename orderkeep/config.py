"""What a caller can set for one compaction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


def nulls_first(nulls: str) -> bool:
    """Whether `nulls`, "first" or "last", puts NULLs first."""
    if nulls not in ("first", "last"):
        raise ValueError(f"nulls must be 'first' or 'last', not '{nulls}'")
    return nulls == "first"


@dataclass(frozen=True)
class SortConfig:
    """sort_columns: the key, all ascending. target_file_size_bytes: advisory; None or 0 leaves the size to the ranges.
    predicate: reserved, accepted and not applied. concurrency: commits of several partitions at once, where each
    partition has a commit of its own. dry_run: plan only. repartition_by_sort_key: rewrite the whole table in order.
    nulls_first: where NULLs go. commit_per_partition: a commit for each partition instead of one for all."""

    sort_columns: Sequence[str] = ()
    target_file_size_bytes: int | None = None
    predicate: str | None = None
    concurrency: int = 8
    dry_run: bool = False
    repartition_by_sort_key: bool = False
    nulls_first: bool = True
    commit_per_partition: bool = False
