"""What keeps memory and time in bounds on large tables."""

import json
import os

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import orderkeep
from orderkeep.operators import rewriter
from orderkeep.plans import planner, queries
from orderkeep.sources import reader, tablelog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def to_driver(monkeypatch):
    """Rows that have come to the driver."""
    seen = [0]
    for name in ("collect", "toLocalIterator"):

        def told(self, *a, f=getattr(DataFrame, name), **kw):
            for r in (rows := list(f(self, *a, **kw))):
                seen[0] += 1
            return rows

        monkeypatch.setattr(DataFrame, name, told)
    return seen


def snapshot_of(s):
    return {f.path: (f.size, f.partition) for f in s.files}, s.version, s.applications, s.partition_columns, s.schema


def test_a_long_log_is_replayed_by_a_job(spark, tmp_path, monkeypatch, to_driver):
    """The driver gets the actions that count, and they leave what all of them do in their order."""
    uri, log = f"{tmp_path}/t", f"{tmp_path}/t/_delta_log"
    os.makedirs(log)
    shape = {"type": "struct", "fields": [{"name": c, "type": "string", "nullable": True, "metadata": {}} for c in ("a", "p")]}
    head = [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["timestampNtz"], "writerFeatures": ["timestampNtz"]}}, {"metaData": {"id": "m", "schemaString": json.dumps(shape), "partitionColumns": ["p"], "configuration": {"x": None}}}]
    for v in range(12):
        actions = head if v == 0 else [{"commitInfo": {"timestamp": v}}, {"txn": {"appId": f"app{v % 2}", "version": v}}]
        for i in range(300):  # a path is added and removed many times, in one version too
            path = f"f{i * 7 % 40}"
            actions.append({"remove": {"path": path}} if (i * i + v) % 3 == 0 else {"add": {"path": path, "partitionValues": {"p": [None, "", "null", "é x"][i % 4]}, "size": 1000 * v + i, "stats": "{}"}})
        with open(f"{log}/{v:020d}.json", "w", encoding="utf-8") as f:
            f.write("\n".join(json.dumps(a, ensure_ascii=False) for a in actions) + "\n\n")
    want = snapshot_of(tablelog.open_table(spark, uri))
    assert 0 < len(want[0]) < 40 and to_driver == [0]
    monkeypatch.setattr(tablelog, "DRIVER_LOG", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # several blocks of each file
    try:
        assert snapshot_of(tablelog.open_table(spark, uri)) == want
        assert to_driver[0] <= 40 + 2 + 2
        with open(f"{log}/{12:020d}.json", "w") as f:
            f.write('{"add": {"path": "f0", "partitionValues": {}, "size": 1, "deletionVector": {"storageType": "u"}}}\n{"remove": {"path": "f0"}}\n')
        with pytest.raises(ValueError, match="deletion vectors"):
            tablelog.open_table(spark, uri)
        with open(f"{log}/{12:020d}.json", "w") as f:
            f.write("no json")
        with pytest.raises(Exception, match="(?i)malformed"):
            tablelog.open_table(spark, uri)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name, job", [("log_snapshot_replay", True), ("log_snapshot_replay", False), ("files_by_partition", True)])
def test_a_log_is_not_gathered_in_the_driver(spark, monkeypatch, to_driver, name, job):
    if job:
        monkeypatch.setattr(tablelog, "DRIVER_LOG", 0)
    rows = queries.QUERIES[name](spark, SF)
    assert to_driver[0] < 500  # of 1,500 actions on 500 files at most
    assert rows.count()


def test_a_written_file_moves_into_place_once(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.moved.link./in", f"file://{tmp_path}")
    for uri in (f"{tmp_path}/a", "viewfs://moved/in/b"):
        store = tablelog.Store(spark, uri)
        for n in ("one", "two"):
            store.put_if_absent(f"w/{n}", n)
        store.put_if_absent("_delta_log/0.json", "zero")
        assert store.move_if_absent("w/one", "_delta_log/1.json") and not store.move_if_absent("w/two", "_delta_log/1.json")
        assert store.read("_delta_log/1.json") == "one" and store.sizes("_delta_log") == {"0.json": 4, "1.json": 3}
        assert store.names("w") == []


@pytest.mark.parametrize("strict", [False, True])
def test_a_task_writes_many_small_files(spark, tmp_path, monkeypatch, strict):
    uri, tasks, write = f"{tmp_path}/t", [], rewriter.write_files
    tablelog.create(spark, uri, spark.range(60_000).selectExpr("(id * 7919) % 60013 AS v", "hex(id) AS s").coalesce(1))

    def told(spark, uri, df, *a):
        tasks.append(df.rdd.getNumPartitions())
        return write(spark, uri, df, *a)

    monkeypatch.setattr(rewriter, "write_files", told)
    orderkeep.compact(uri, ["v"], target_file_size_bytes=10_000, repartition_by_sort_key=strict, spark=spark)
    files = tablelog.open_table(spark, uri).files
    assert tasks == [spark.sparkContext.defaultParallelism] and len(files) > 30
    assert max(f.size for f in files) <= 15_000
    orderkeep.validate(uri, ["v"], spark=spark)
    assert reader.scan(spark, tablelog.open_table(spark, uri), ["v"]).count() == 60_000


def test_the_driver_lists_files_by_folder(spark, tmp_path, monkeypatch):
    uri = f"{tmp_path}/t"
    store = tablelog.Store(spark, uri)
    spark.range(6).selectExpr("id", "id % 2 AS p", "if(id = 5, NULL, 'a b/=c') AS q").coalesce(1).write.partitionBy("p", "q").parquet(f"{uri}/d")
    for name in ("_SUCCESS.parquet", ".x.parquet", "y.txt"):
        store.put_if_absent(f"d/{name}", "")

    class Fs:  # listFiles() starts a process for each file on a local disk
        listFiles = None
        listStatus = staticmethod(store.fs.listStatus)

    monkeypatch.setattr(store, "fs", Fs)
    got = store.data_files("d", ["p", "q"])
    assert sorted((f.partition for f in got), key=str) == [(("p", "0"), ("q", "a b/=c")), (("p", "1"), ("q", "a b/=c")), (("p", "1"), ("q", None))]
    snapshot = tablelog.Snapshot(store.uri, 0, spark.range(1).schema, (), tuple(got))
    assert sorted(r.id for r in reader.scan(spark, snapshot, ["id"]).collect()) == list(range(6)) and all(f.size > 100 for f in got)


def test_a_file_for_each_partition_without_a_sort(spark, tmp_path, monkeypatch):
    names = ["1", "10", None, "null", "a b/c", "o'x"]
    df = spark.createDataFrame([(n, i % 2, k) for n in names for i, k in enumerate((3, 1, 2))], "`p.q` string, r int, value long").repartition(3)
    made = tablelog.create(spark, f"{tmp_path}/t", df, ["p.q", "r"], one_file_each=True)
    assert len(made.files) == 2 * len(names) == len({f.partition for f in made.files})
    key = lambda rows: sorted(map(str, rows))
    assert key(reader.scan(spark, made, places=False).collect()) == key(df.collect())
    with pytest.raises(ValueError, match="one_file_each"):
        tablelog.create(spark, f"{tmp_path}/u", df, one_file_each=True)
    plans, write = [], tablelog.write_files

    def told(spark, uri, df, partition_columns, *a):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), df.rdd.getNumPartitions(), partition_columns))
        return write(spark, uri, df, partition_columns, *a)

    monkeypatch.setattr(tablelog, "write_files", told)
    assert queries.QUERIES["rewrite_metrics"](spark, SF).first() == (3, 3, 1500)
    assert len(plans) == 3 and not [p for p, n, columns in plans if "Sort" in p or n != 1 or columns]  # the writer sorts by partition columns


def test_places_in_files_without_a_sort_of_rows(spark, tmp_path):
    made = tablelog.create(spark, f"{tmp_path}/t", spark.range(3000).selectExpr("id % 3 AS a", "id AS b", "'x' AS c").repartition(3, "a"))
    rows = reader.scan(spark, made, ["a", "b"])
    plan = reader.positions(rows, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "BroadcastHashJoin" in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan
    got = {(r.a, r.b): r.position for r in reader.positions(rows, ["a", "b"]).collect()}
    assert sorted(got.values()) == list(range(1, 3001)) and max(got[0, b] for b in range(0, 3000, 3)) == 1000
    assert {r.n for r in reader.stats_by_file(rows, ["a"]).collect()} <= {1000, 2000, 3000}


def test_a_rewrite_without_a_size_has_tasks_of_bounded_input(spark):
    files = [tablelog.DataFile(str(i), 100 << 20) for i in range(6)]
    assert rewriter._tasks(spark, files, None) == (19, 600 << 20)


@pytest.mark.parametrize("kind, values", [("int", ["1", "10", None]), ("string", ["1", "null", None, "a b/c", "o'x"]), ("date", ["2024-02-29", None]), ("decimal(10,2)", ["1.50", "-3.00"])])
def test_few_partitions_are_read_without_a_join(spark, tmp_path, monkeypatch, kind, values):
    df = spark.createDataFrame([(v, i % 2, i) for v in values for i in range(3)], "p string, q int, v int").withColumn("p", F.col("p").cast(kind))
    made = tablelog.create(spark, f"{tmp_path}/t", df.repartition(2), ["p", "q"])
    rows = lambda df: sorted(map(str, df.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = reader.scan(spark, made)
    assert rows(got.drop(reader.FILE, reader.ROW)) == rows(df) and "Join" not in plan(got)
    monkeypatch.setattr(reader, "MAX_PARTS", 1)
    joined = reader.scan(spark, made)
    assert rows(joined) == rows(got) and joined.dtypes == got.dtypes and "Join" in plan(joined)


@pytest.mark.parametrize("nulls_first", [True, False])
def test_bounds_prove_disorder_as_all_rows_do(spark, tmp_path, monkeypatch, nulls_first):
    """Partitions by how their two files lie to each other; the first key of a file is a list of values in its order."""
    files = {
        "apart": ([1, 2], [3, 4]), "touching": ([1, 3], [3, 4]), "over": ([1, 3], [2, 4]), "same": ([2, 2], [2, 2]), "held": ([1, 9], [3, 4]), "inside": ([2, 1], [3, 4]), "one": ([5, 6],), "one bad": ([6, 5],),
        "null before": ([None, 1], [2, 3]), "null after": ([1, 2], [3, None]), "null both": ([None, 1], [None, 2]), "all null": ([None, None], [1, 2]), "nan": ([1.0, float("nan")], [2.0, 3.0]), "zero": ([-0.0, 0.0], [-0.0, 0.0]),
    }
    rows = [(p, k, None if x is None else float(x), i) for p, both in files.items() for k, file in enumerate(both) for i, x in enumerate(file)]
    df = spark.createDataFrame(rows, "p string, k int, x double, i int").repartitionById(2, F.col("k")).sortWithinPartitions("p", "i")
    df = df.select("p", "x", F.col("x").cast("string").alias("s"), F.struct("x").alias("t"), "i")
    made = tablelog.create(spark, f"{tmp_path}/t", df, ["p"])
    assert len(made.files) == sum(map(len, files.values()))
    whole = tablelog.create(spark, f"{tmp_path}/w", df.drop("p"))
    seen, stats = [], planner.snapshot_stats

    def told(spark, snapshot, *a):
        seen.append({dict(f.partition).get("p") for f in snapshot.files})
        return stats(spark, snapshot, *a)

    monkeypatch.setattr(planner, "snapshot_stats", told)
    for keys in (["x"], ["s"], ["t"], ["p", "x"], ["x", "i"], ["p"]):
        want = {r["part"]: r["rows"] for r in planner.failing(stats(spark, made, keys, nulls_first), "part").collect()}
        got = planner.plan(spark, made, keys, nulls_first)
        assert {json.dumps(g.partition): g.rows_in for g in got.groups} == want, keys
        assert not {"over", "held"} & seen.pop() or keys == ["p"]
    assert [g.rows_in for g in planner.plan(spark, whole, ["x"], nulls_first).groups] == [len(rows)]
    assert not seen  # bounds alone prove it


def test_a_rewrite_of_overlapping_files_looks_at_no_row_s_neighbour(spark, monkeypatch):
    monkeypatch.setattr(planner, "snapshot_stats", None)
    plans, write = [], rewriter.write_files

    def told(spark, uri, df, *a):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(spark, uri, df, *a)

    monkeypatch.setattr(rewriter, "write_files", told)
    two = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(2)
    monkeypatch.setattr(queries, "_read", two)
    assert queries.QUERIES["rewrite_preserves_rows"](spark, SF).first().n > 5000
    assert len(plans) == 1 and "Join" not in plans[0]


def test_halves_of_a_cent_are_rounded_as_by_the_sql(spark, tmp_path):
    rows = [(1, q, p) for q, p in ((0.125, 0.375), (2.5, 1.005), (-0.125, 0.635), (None, 12345.67), (0.625, 1.125))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double").withColumns({"l_shipdate": F.lit("2024-01-01").cast("timestamp_ntz"), "l_returnflag": F.lit("A")})
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = duck.execute(queries.SQL["rewrite_preserves_rows"]).fetchone()
    assert tuple(queries.QUERIES["rewrite_preserves_rows"](spark, str(tmp_path)).first()) == want
