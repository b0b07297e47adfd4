"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderkeep.llm import parts
from orderkeep.llm.bpe import op1_bpe
from orderkeep.llm.fingerprints import op2_fingerprints
from orderkeep.llm.licenses import op10_licenses
from orderkeep.llm.mixing import OP4_SQL, op4_mixing
from orderkeep.llm.ngram_join import OP6_SQL, op6_ngram_join
from orderkeep.llm.quality_model import op9_quality
from orderkeep.llm.quality_rules import OP8_SQL, op8_rules
from orderkeep.llm.sharding import op3_sharding
from orderkeep.llm.token_files import op7_token_files
from orderkeep.llm.warc import OP5_SQL, op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_fingerprints": op2_fingerprints, "op3_sharding": op3_sharding, "op4_mixing": op4_mixing, "op5_warc": op5_warc, "op6_ngram_join": op6_ngram_join, "op7_token_files": op7_token_files, "op8_rules": op8_rules, "op9_quality": op9_quality, "op10_licenses": op10_licenses, **parts.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op5_warc": OP5_SQL, "op6_ngram_join": OP6_SQL, "op8_rules": OP8_SQL, **parts.SQL}
