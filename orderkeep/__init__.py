"""orderkeep: audits and enforces the global order of transactional Parquet tables, on PySpark."""

from orderkeep.api import SortOptimizer, compact, validate
from orderkeep.config import SortConfig

__all__ = ["SortConfig", "SortOptimizer", "compact", "validate"]
