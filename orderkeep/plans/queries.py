"""The driver's queries over the given tables, and SQL with the same rows.

A "virtual file" is a computed file id with a row number inside it, so that SQL can follow; queries that write a table
give the place that each row got in it as a column.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderkeep.config import SortConfig
from orderkeep.functions import predicates
from orderkeep.functions.keys import key_value
from orderkeep.operators import rewriter, validator
from orderkeep.plans.metrics import frame, totals
from orderkeep.plans.planner import Todo, grouped, plan
from orderkeep.sources import reader, tablelog
from orderkeep.sources.reader import FILE, ROW
from orderkeep.session import own_folder
from orderkeep.session import remove as remove_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns with FILE and ROW."""
    return _read(spark, sf_dir, name).select(*columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def _new_table(spark: SparkSession, df: DataFrame, partition_by: tuple[str, ...] = (), rows_per_file: int = 0) -> tablelog.Snapshot:
    return tablelog.create(spark, f"{own_folder(spark, 'table')}/t", df, partition_by, rows_per_file)


def _virtual(df: DataFrame, file: str, row: str) -> DataFrame:
    return df.withColumns({FILE: F.expr(file), ROW: F.expr(row)})


# --- validation ---------------------------------------------------------------------------------------------------


@query("""
SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE p1 > k1 OR (p1 = k1 AND p2 > k2))::BIGINT AS inversions FROM (
  SELECT l_orderkey AS k1, l_linenumber AS k2, lag(l_orderkey) OVER w AS p1, lag(l_linenumber) OVER w AS p2
  FROM (SELECT *, row_number() OVER () AS r FROM lineitem) WINDOW w AS (ORDER BY r))""")
def validate_intra_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored lineitem whose key is less than that of the row before."""
    rows = _placed(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return validator.file_stats(rows, key_value(["l_orderkey", "l_linenumber"])).agg(F.sum("n").alias("n"), F.sum("inversions").alias("inversions"))


@query("""
SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE p > k)::BIGINT AS inversions FROM (
  SELECT o_orderkey AS k, lag(o_orderkey) OVER (ORDER BY r) AS p FROM (SELECT *, row_number() OVER () AS r FROM orders))""")
def validate_intra_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir, "orders", "o_orderkey")
    return validator.file_stats(rows, key_value(["o_orderkey"])).agg(F.sum("n").alias("n"), F.sum("inversions").alias("inversions"))


@query("""
SELECT event_type AS file, count(*)::BIGINT AS n,
  first(user_id ORDER BY user_id, event_id)::BIGINT AS mn_user, first(event_id ORDER BY user_id, event_id)::BIGINT AS mn_event,
  last(user_id ORDER BY user_id, event_id)::BIGINT AS mx_user, last(event_id ORDER BY user_id, event_id)::BIGINT AS mx_event
FROM events GROUP BY event_type""")
def file_minmax_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest key tuple of each virtual file."""
    rows = _virtual(_read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "event_type", "event_id")
    stats = reader.stats_by_file(rows, ["user_id", "event_id"])
    return stats.select("file", "n", F.col("mn.c0").alias("mn_user"), F.col("mn.c1").alias("mn_event"), F.col("mx.c0").alias("mx_user"), F.col("mx.c1").alias("mx_event"))


_PARTS_SQL = """
WITH rows AS (SELECT (l_orderkey // 1000)::BIGINT AS file, l_orderkey AS k1, l_partkey AS k2, l_suppkey % 7 AS k0, l_linenumber AS ln, l_suppkey AS sk,
                     row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS i FROM lineitem),
pre AS (SELECT *, lag(k2) OVER (PARTITION BY file ORDER BY i) AS p FROM rows),
stats AS (SELECT file, count(*)::BIGINT AS n, count(*) FILTER (WHERE p > k2)::BIGINT AS inversions, min(k2) AS mn, max(k2) AS mx FROM pre GROUP BY file),
bound AS (SELECT *, lag(mx) OVER (ORDER BY mn, mx, file) AS pmx, lag(file) OVER (ORDER BY mn, mx, file) AS before FROM stats)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats of lineitem's virtual files (runs of order keys) by part key."""
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").withColumn("f", F.floor(F.col("l_orderkey") / 1000))
    order = Window.partitionBy("f").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = df.select(F.col("f").alias(FILE), (F.row_number().over(order) - 1).cast("long").alias(ROW), "l_partkey")
    return validator.file_stats(rows, key_value(["l_partkey"]), chunk_rows=1000)


@query(_PARTS_SQL + "SELECT file, n, inversions, mn, mx FROM stats")
def file_stats_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats of virtual files whose rows are cut into several chunks each."""
    return _parts(spark, sf_dir).select("file", "n", "inversions", F.col("mn.c0").alias("mn"), F.col("mx.c0").alias("mx"))


@query(_PARTS_SQL + "SELECT before, file FROM bound WHERE pmx > mn")
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validator.boundaries(_parts(spark, sf_dir)).filter("bad").select("before", "file")


@query(_PARTS_SQL + "SELECT count(*)::BIGINT AS checked_files, (count(*) FILTER (WHERE inversions > 0) + count(*) FILTER (WHERE pmx > mn))::BIGINT AS boundary_violations FROM bound")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validator.report(_parts(spark, sf_dir))


_SAMPLE_SQL = _PARTS_SQL + """,
found AS (SELECT 0 AS kind, lpad(file::VARCHAR, 9, '0') AS f, 'monotonicity violation within file: ' || lpad(file::VARCHAR, 9, '0') AS detail FROM stats WHERE inversions > 0
  UNION ALL SELECT 1, lpad(file::VARCHAR, 9, '0'), 'boundary violation: ' || lpad(before::VARCHAR, 9, '0') || ' max > ' || lpad(file::VARCHAR, 9, '0') || ' min' FROM bound WHERE pmx > mn),
num AS (SELECT row_number() OVER (ORDER BY kind, f, detail) AS position, detail, count(*) OVER () AS total FROM found)
SELECT position, CASE WHEN total > 20 AND position = 20 THEN '... plus ' || (total - 19) || ' more violations' ELSE detail END AS detail FROM num WHERE position <= 20"""


@query(_SAMPLE_SQL)
def violation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first violations of a report, 20 lines at most (a report's own limit)."""
    named = _parts(spark, sf_dir).withColumn("file", F.lpad(F.col("file").cast("string"), 9, "0"))
    return validator.sampled(validator.violations(named))


@query("""
WITH r AS (SELECT c_mktsegment AS file, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer),
p AS (SELECT *, lag(k) OVER (PARTITION BY file ORDER BY i) AS pk, lag(1) OVER (PARTITION BY file ORDER BY i) AS has FROM r)
SELECT file, count(*)::BIGINT AS n, count(*) FILTER (WHERE has = 1 AND ((pk IS NULL AND k IS NOT NULL) OR pk > k))::BIGINT AS inversions_last,
  count(*) FILTER (WHERE has = 1 AND ((pk IS NOT NULL AND k IS NULL) OR pk > k))::BIGINT AS inversions_first FROM p GROUP BY file""")
def validate_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inversions of a key with NULLs, under both of their places."""
    df = _read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("k"))
    rows = _virtual(df, "c_mktsegment", "c_custkey")
    first, last = (validator.file_stats(rows, key_value(["k"], x)).select("file", "n", F.col("inversions").alias(f"inversions_{'first' if x else 'last'}")) for x in (True, False))
    return first.join(last.drop("n"), "file")


# --- sorted writes ------------------------------------------------------------------------------------------------


def _rewritten(spark: SparkSession, df: DataFrame, keys: tuple[str, ...], partition_by: tuple[str, ...] = (), **cfg) -> tablelog.Snapshot:
    made = _new_table(spark, df, partition_by)
    rewriter.compact(spark, made.uri, SortConfig(keys, **cfg))
    return tablelog.open_table(spark, made.uri)


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def global_sort_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders rewritten as a whole: each row's place in the files."""
    keys = ("o_orderdate", "o_orderkey")
    done = _rewritten(spark, _read(spark, sf_dir, "orders"), keys, repartition_by_sort_key=True, target_file_size_bytes=200_000)
    return reader.positions(reader.scan(spark, done, list(keys)), list(keys)).select(*keys, "position")


@query("SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS position FROM orders")
def partition_sort_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by status, each partition rewritten: each row's place in its partition's files."""
    keys = ("o_totalprice", "o_orderkey")
    done = _rewritten(spark, _read(spark, sf_dir, "orders"), keys, ("o_orderstatus",), target_file_size_bytes=100_000)
    rows = reader.scan(spark, done, ["o_orderstatus", *keys])
    placed = reader.positions(rows, ["o_orderstatus", *keys])
    begins = placed.groupBy("o_orderstatus").agg(F.min("position").alias("begin"))
    return placed.join(F.broadcast(begins), "o_orderstatus").select("o_orderstatus", "o_orderkey", (F.col("position") - F.col("begin") + 1).alias("position"))


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("nat"))


_NULLS_SQL = """SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END NULLS {0},
  CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END NULLS {0}, c_custkey) AS position FROM customer"""


@query(_NULLS_SQL.format("FIRST"))
def nulls_first_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["seg", "nat", "c_custkey"]
    done = _rewritten(spark, _with_nulls(spark, sf_dir), tuple(keys), target_file_size_bytes=4000)
    return reader.positions(reader.scan(spark, done, keys), keys).select("c_custkey", "position")


@query(_NULLS_SQL.format("LAST"))
def nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["seg", "nat", "c_custkey"]
    done = _rewritten(spark, _with_nulls(spark, sf_dir), tuple(keys), nulls_first=False, repartition_by_sort_key=True, target_file_size_bytes=4000)
    return reader.positions(reader.scan(spark, done, keys), keys, False).select("c_custkey", "position")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderdate, o_orderkey) AS position FROM orders")
def strict_on_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table rewritten as a whole, the partition column leading the key."""
    keys = ["o_orderstatus", "o_orderdate", "o_orderkey"]
    done = _rewritten(spark, _read(spark, sf_dir, "orders"), tuple(keys), ("o_orderstatus",), repartition_by_sort_key=True)
    return reader.positions(reader.scan(spark, done, keys), keys).select("o_orderkey", "position")


@query("SELECT count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS orderkeys, sum((l_quantity * 100)::BIGINT)::BIGINT AS quantity, sum((l_extendedprice * 100)::BIGINT)::BIGINT AS price FROM lineitem")
def rewrite_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _rewritten(spark, _read(spark, sf_dir, "lineitem"), ("l_shipdate", "l_orderkey"), ("l_returnflag",))
    whole = lambda c: F.sum(F.rint(F.col(c) * 100).cast("long"))  # noqa: E731 halves go to the even number, as the SQL's cast has it
    return reader.scan(spark, done, places=False).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orderkeys"), whole("l_quantity").alias("quantity"), whole("l_extendedprice").alias("price"))


@query("SELECT 0::BIGINT AS groups, 0::BIGINT AS violations, 1::BIGINT AS version")
def idempotent_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second compaction finds nothing to do, and validation nothing to complain of."""
    keys = ("o_orderstatus", "o_custkey", "o_orderkey")
    done = _rewritten(spark, _read(spark, sf_dir, "orders"), keys, ("o_orderstatus",))
    todo = plan(spark, done, keys)
    rewriter.compact_partitions(spark, done, todo, SortConfig(keys))
    found = validator.validate_snapshot(spark, done, keys)
    return spark.createDataFrame([(len(todo.groups), found.boundary_violations, tablelog.open_table(spark, done.uri).version)], "groups long, violations long, version long")


@query("""
SELECT t.target, (SELECT count(*) FROM orders)::BIGINT AS rows, 0::BIGINT AS violations, TRUE AS fits, TRUE AS several
FROM (VALUES (0::BIGINT), (200000), (50000)) t(target)""")
def size_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites by the size asked for: all files lie below one and a half times of it, and are several where it is small."""
    out = []
    for target in (0, 200_000, 50_000):
        done = _rewritten(spark, _read(spark, sf_dir, "orders"), ("o_totalprice", "o_orderkey"), target_file_size_bytes=target)
        found = validator.validate_snapshot(spark, done, ["o_totalprice", "o_orderkey"])
        sizes = [f.size for f in done.files]
        fits = not target or max(sizes) <= 1.5 * target
        several = not target or sum(sizes) <= target or len(sizes) >= sum(sizes) / (1.5 * target)
        out.append((target, reader.scan(spark, done, ["o_orderkey"], places=False).count(), found.boundary_violations, fits, several))
    return spark.createDataFrame(out, "target long, rows long, violations long, fits boolean, several boolean")


@query("SELECT 3::BIGINT AS partitions, 3::BIGINT AS files_in, (SELECT count(*) FROM orders)::BIGINT AS rows")
def rewrite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run's metrics."""
    made = tablelog.create(spark, f"{own_folder(spark, 'table')}/t", _read(spark, sf_dir, "orders"), ("o_orderstatus",), one_file_each=True)
    got = rewriter.compact(spark, made.uri, SortConfig(("o_totalprice", "o_orderkey"), commit_per_partition=True))
    rows = reader.scan(spark, tablelog.open_table(spark, made.uri), ["o_orderkey"], places=False).agg(F.count("*").alias("rows"))
    return totals(frame(spark, got)).select("partitions", "files_in").crossJoin(F.broadcast(rows))  # one row each


@query("SELECT n, m FROM (SELECT o_orderkey AS n, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS m FROM orders)")
def ordered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read back in key order without a sort; the place of each row as the reader yields it."""
    keys = ["o_totalprice", "o_orderkey"]
    done = _rewritten(spark, _read(spark, sf_dir, "orders"), tuple(keys), target_file_size_bytes=150_000)
    rows = reader.read_ordered(spark, done, keys)
    # rank of (partition, row in it) is the order in which the rows come
    told = rows.select(F.col("o_orderkey").alias("n"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    sizes = told.groupBy("p").agg(F.count("*").alias("c"))
    begins = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("begin"))
    return told.join(begins, "p").select("n", (F.col("begin") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("m"))


# --- planning -----------------------------------------------------------------------------------------------------

_PLAN_SQL = """
WITH r AS (SELECT o_orderpriority AS part, o_custkey % 4 AS file, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey + 1000000000 * (o_custkey % 4) ELSE o_custkey END AS k, o_orderkey AS i FROM orders),
p AS (SELECT *, lag(k) OVER (PARTITION BY part, file ORDER BY i) AS pk FROM r),
s AS (SELECT part, file, count(*) AS n, count(*) FILTER (WHERE pk > k) AS inv, min(k) AS mn, max(k) AS mx FROM p GROUP BY part, file),
b AS (SELECT *, lag(mx) OVER (PARTITION BY part ORDER BY mn, mx, file) AS pmx FROM s),
g AS (SELECT part, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE inv > 0 OR pmx > mn)::BIGINT AS violations FROM b GROUP BY part HAVING count(*) FILTER (WHERE inv > 0 OR pmx > mn) > 0)"""


def _prioritised(spark: SparkSession, sf_dir: str) -> tablelog.Snapshot:
    """orders as a table by priority of four files each, in the order of order keys; one priority is in the order of k."""
    key = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderkey") + 1_000_000_000 * (F.col("o_custkey") % 4)).otherwise(F.col("o_custkey"))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), (F.col("o_custkey") % 4).cast("int").alias("file"), key.alias("k"), F.col("o_orderkey").alias("i"))
    dealt = rows.repartitionById(4, F.col("file")).sortWithinPartitions("part", "i")
    return _new_table(spark, dealt.drop("file"), ("part",))


@query(_PLAN_SQL + "SELECT part, rows, (SELECT count(DISTINCT file) FROM r WHERE r.part = g.part)::BIGINT AS files FROM g")
def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions that a compaction of the table would rewrite, with their rows and files."""
    made = _prioritised(spark, sf_dir)
    todo = plan(spark, made, ["k"]).frame(spark)
    return todo.select(F.substring_index("partition", "part=", -1).alias("part"), F.col("rows_in").alias("rows"), F.size("input_files").cast("long").alias("files"))


@query(_PLAN_SQL + "SELECT r.part, r.i FROM r WHERE r.part IN (SELECT part FROM g)")
def semi_join_rewrite_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the files that it would rewrite."""
    made = _prioritised(spark, sf_dir)
    files = [f for g in plan(spark, made, ["k"]).groups for f in g.files]
    return reader.scan(spark, made.restrict(files), ["part", "i"], places=False)


_ACTIONS_SQL = """
WITH a AS (SELECT o_custkey % 500 AS path, o_orderkey AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS kind, (o_totalprice * 100)::BIGINT AS size FROM orders),
live AS (SELECT path, version, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS n FROM a) WHERE n = 1 AND kind = 'add')"""


def _logged(spark: SparkSession, sf_dir: str) -> tablelog.Snapshot:
    """A table whose log adds and removes made-up files, an action for each order, in 40 versions; as the engine opens it."""
    path, version = (F.col("o_custkey") % 500).cast("string").alias("path"), F.col("o_orderkey")
    values = F.create_map(F.lit("part"), (F.col("o_custkey") % 500 % 10).cast("string"), F.lit("version"), version.cast("string")).alias("partitionValues")
    add = F.struct(F.struct(path, values, F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), F.lit(True).alias("dataChange")).alias("add"))
    remove = F.struct(F.struct(path, F.lit(True).alias("dataChange")).alias("remove"))
    orders = _read(spark, sf_dir, "orders").repartitionByRange(40, "o_orderkey").sortWithinPartitions("o_orderkey")
    store = tablelog.Store(spark, f"{own_folder(spark, 'table')}/t")
    orders.select(F.when(version % 3 == 0, F.to_json(remove)).otherwise(F.to_json(add)).alias("value")).write.text(f"{store.uri}/written")
    schema = {"type": "struct", "fields": [{"name": n, "type": "long", "nullable": True, "metadata": {}} for n in ("part", "version", "x")]}
    head = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "m", "format": {"provider": "parquet", "options": {}}, "schemaString": json.dumps(schema), "partitionColumns": ["part", "version"], "configuration": {}}}]
    store.put_if_absent(f"{tablelog.LOG}/{0:020d}.json", "".join(json.dumps(a) + "\n" for a in head))
    for k, name in enumerate((n for n in store.names("written") if n.startswith("part-")), 1):  # Spark's names follow the ranges
        store.move_if_absent(f"written/{name}", f"{tablelog.LOG}/{k:020d}.json")
    opened = tablelog.open_table(spark, store.uri)
    remove_folder(spark, store.uri)  # its files are made up: nothing is read from there any more
    return opened


@query(_ACTIONS_SQL + "SELECT * FROM live")
def log_snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a log of adds and removes leaves."""
    adds = tablelog.adds_frame(spark, _logged(spark, sf_dir))
    return adds.select(F.col("path").cast("long").alias("path"), F.col("partition")["version"].cast("long").alias("version"), "size")


@query(_ACTIONS_SQL + "SELECT path % 10 AS part, list(path ORDER BY path)::VARCHAR AS files, sum(size)::BIGINT AS bytes FROM live GROUP BY path % 10")
def files_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active files grouped by partition, with their bytes."""
    opened = _logged(spark, sf_dir)
    files = tuple(replace(f, partition=tuple(x for x in f.partition if x[0] == "part")) for f in opened.files)
    groups = grouped(replace(opened, partition_columns=("part",), files=files))
    told = Todo(opened.uri, list(groups.values())).frame(spark)
    return told.select(F.substring_index("partition", "=", -1).cast("long").alias("part"), F.array_sort(F.transform("input_files", lambda x: x.cast("long"))).cast("string").alias("files"), F.col("estimated_bytes").alias("bytes"))


# --- predicates ---------------------------------------------------------------------------------------------------


@query("""
SELECT 'int' AS kind, count(*)::BIGINT AS n FROM customer WHERE c_nationkey = 7 UNION ALL
SELECT 'string', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL
SELECT 'long', count(*) FROM orders WHERE o_custkey = 42 UNION ALL
SELECT 'double', count(*) FROM lineitem WHERE l_quantity = 10 AND l_returnflag = 'R' UNION ALL
SELECT 'none', count(*) FROM orders""")
def partition_filter_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the text of partition predicates picks, for each type."""

    def count(kind: str, name: str, *values: tuple[str, str]) -> DataFrame:
        df = _read(spark, sf_dir, name)
        text = predicates.sql_predicate(values, {f.name: f.dataType.typeName() for f in df.schema.fields})
        return df.filter(F.expr(text.replace('"', "`"))).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))  # Spark quotes names by `

    out = count("int", "customer", ("c_nationkey", "7"))
    for more in (count("string", "orders", ("o_orderstatus", "F")), count("long", "orders", ("o_custkey", "42")), count("double", "lineitem", ("l_quantity", "10"), ("l_returnflag", "R")), count("none", "orders")):
        out = out.unionByName(more)
    return out


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0")
def partition_filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table's NULL partition."""
    made = _new_table(spark, _with_nulls(spark, sf_dir), ("seg",))
    return reader.read_partition(spark, made, (("seg", None),)).select("c_custkey")


_RENDER_SQL = """
WITH v AS (SELECT DISTINCT p_brand AS raw FROM part UNION SELECT DISTINCT p_size::VARCHAR FROM part UNION SELECT * FROM (VALUES ('o''x'), ('"7"'), ('TRUE'), ('False'), ('1.50'), ('-3'), ('1.2.3'), (''))),
t AS (SELECT raw, trim(raw, '"') AS v FROM v),
q AS (SELECT *, '''' || replace(v, '''', '''''') || '''' AS quoted FROM t)
SELECT raw, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v ELSE quoted END AS as_int,
  CASE WHEN regexp_full_match(v, '[0-9.+-]*') THEN v ELSE quoted END AS as_decimal,
  CASE WHEN lower(v) IN ('true', 'false') THEN upper(v) ELSE quoted END AS as_bool,
  CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN v ELSE quoted END AS as_float, quoted AS as_text FROM q"""


@query(_RENDER_SQL)
def literal_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL literals of partition values under each kind of type."""
    part = _read(spark, sf_dir, "part")
    odd = spark.createDataFrame([(x,) for x in ("o'x", '"7"', "TRUE", "False", "1.50", "-3", "1.2.3", "")], "raw string")
    raw = part.select(F.col("p_brand").alias("raw")).union(part.select(F.col("p_size").cast("string"))).union(odd).distinct()
    kinds = {"int": "integer", "decimal": "decimal(10,2)", "bool": "boolean", "float": "double", "text": "string"}
    rows = [(r.raw, *(predicates.literal(r.raw, k) for k in kinds.values())) for r in raw.collect()]  # brands and sizes: some dozens
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ("raw", *(f"as_{k}" for k in kinds))))
