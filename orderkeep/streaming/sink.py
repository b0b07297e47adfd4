"""A stream's micro-batches as sorted files of a table.

Each micro-batch is sorted like a rewrite and enters the table by one commit that also records the stream's name and the
batch's number, so that a batch that Spark repeats after a failure is not written twice. Files of different batches may
overlap; a later compaction brings the partition into order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orderkeep.functions.keys import check_columns, column
from orderkeep.operators.rewriter import sorted_rows
from orderkeep.sources import tablelog


def append_batch(batch: DataFrame, number: int, uri: str, stream: str, sort_columns: Sequence[str], nulls_first: bool = True, tasks: int = 1) -> bool:
    """Append a micro-batch unless the table has it; whether it was written."""
    spark = batch.sparkSession
    snapshot = tablelog.open_table(spark, uri)
    check_columns(sort_columns, snapshot.schema)
    if snapshot.applications.get(stream, -1) >= number:
        return False
    rows = batch.select(*map(column, snapshot.schema.fieldNames()))
    files = tablelog.write_files(spark, snapshot.uri, sorted_rows(rows, sort_columns, nulls_first, snapshot.partition_columns, tasks), snapshot.partition_columns)
    tablelog.commit(spark, snapshot, files, [], "STREAMING UPDATE", {"outputMode": "Append"}, True, (stream, number))
    return True


def append_stream(stream: DataFrame, uri: str, name: str, checkpoint: str, sort_columns: Sequence[str], nulls_first: bool = True, tasks: int = 1, **trigger) -> StreamingQuery:
    """Start a query that appends a stream to a table. trigger: as writeStream.trigger takes it, availableNow by default."""
    put = lambda batch, number: append_batch(batch, number, uri, name, sort_columns, nulls_first, tasks)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
