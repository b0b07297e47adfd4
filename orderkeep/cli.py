"""The command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Sequence

from orderkeep.config import SortConfig, nulls_first

# What the commands print.
REPORT = "Validated files: {files} | boundary_violations: {found}"
FOUND = "Ordering violations found: {found}"
DONE = {
    "dry": "Dry run completed: planned rewrites; see logs for details.",
    "strict": "Success: full-table sorted overwrite completed.",
    "default": "Success: partition-aware compaction + sort completed.",
}


#: Levels of the log; trace is as debug, off says nothing.
LEVELS = {"off": logging.CRITICAL + 10, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": logging.DEBUG}


def level(name: str) -> int:
    """A level by its name, in any case; unknown names are errors."""
    found = LEVELS.get({"warning": "warn"}.get(name.lower(), name.lower()))
    if found is None:
        raise ValueError(f"no log level {name!r}; there are {list(LEVELS)}")
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orderkeep", description="Audit and enforce the order of a table.")
    p.add_argument("--table", required=True, help="the table's address")
    p.add_argument("--sort-columns", default="", help="the key, as a,b")
    p.add_argument("--target-file-size-bytes", type=int, help="advisory size of a file")
    p.add_argument("--predicate", help="reserved")
    p.add_argument("--concurrency", type=int, default=8, help="partitions at once, with --commit-per-partition")
    p.add_argument("--commit-per-partition", action="store_true", help="a commit for each partition instead of one for all")
    p.add_argument("--dry-run", action="store_true", help="plan only")
    p.add_argument("--validate-only", action="store_true", help="report only; fails on violations")
    p.add_argument("--repartition-by-sort-key", action="store_true", help="rewrite the whole table")
    p.add_argument("--log-level", help=f"over the environment's level: {', '.join(LEVELS)}")
    p.add_argument("--nulls", choices=["first", "last"], default="first")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from orderkeep.api import session
    from orderkeep.operators import rewriter, validator

    try:
        logging.basicConfig(level=level(a.log_level or os.environ.get("LOG_LEVEL") or "info"), stream=sys.stderr)
        keys, first = tuple(c for c in a.sort_columns.split(",") if c), nulls_first(a.nulls)
        if a.validate_only:
            found = validator.validate(session(), a.table, keys, first)
            print(REPORT.format(files=found.checked_files, found=found.boundary_violations))
            if found.details_sample:
                print("Sample:")
                for line in found.details_sample:
                    print(f"- {line}")
            if found.boundary_violations:
                raise RuntimeError(FOUND.format(found=found.boundary_violations))
            return 0
        rewriter.compact(session(), a.table, SortConfig(keys, a.target_file_size_bytes, a.predicate, a.concurrency, a.dry_run, a.repartition_by_sort_key, first, a.commit_per_partition))
        print(DONE["dry" if a.dry_run else "strict" if a.repartition_by_sort_key else "default"])
        return 0
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
