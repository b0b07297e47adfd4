import datetime
import decimal
import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import orderkeep
from orderkeep import SortOptimizer
from orderkeep.cli import main
from orderkeep.config import SortConfig
from orderkeep.functions import predicates as P
from orderkeep.operators import rewriter, validator
from orderkeep.operators.validator import ValidationReport
from orderkeep.plans import metrics
from orderkeep.plans.planner import plan
from orderkeep.sources import reader, tablelog

UNSORTED = [("B", "2021-02-02", 4), ("A", "2021-02-01", 1), ("B", "2021-01-01", 2), ("A", "2021-03-01", 3)]
SCHEMA = "objectId string, dateTime string, value long"
KEYS = ["objectId", "dateTime"]


@pytest.fixture
def make(spark, tmp_path):
    def make(rows, schema, partition_by=(), files=1, name="t", **kw):
        df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, schema)
        uri = f"{tmp_path}/{name}"
        tablelog.create(spark, uri, df.coalesce(1) if files == 1 else df, partition_by, **kw)
        return uri

    return make


def values(spark, uri, keys, column="value", first=True):
    return [r[column] for r in reader.read_ordered(spark, tablelog.open_table(spark, uri), keys, first).collect()]


@pytest.mark.parametrize("strict", [False, True])
def test_compact_then_validate(spark, make, strict):
    uri = make(UNSORTED, SCHEMA)
    t = SortOptimizer(uri, spark)
    with pytest.raises(RuntimeError, match="Ordering violations: 1"):
        t.validate(KEYS)
    t.compact(KEYS, repartition_by_sort_key=strict)
    t.validate(KEYS)
    assert values(spark, uri, KEYS) == [1, 3, 2, 4]
    assert tablelog.open_table(spark, uri).version == 1
    t.compact(KEYS)
    assert tablelog.open_table(spark, uri).version == 1  # nothing left to do


@pytest.mark.parametrize("nulls, want", [("first", [2, 4, 5, 1, 3]), ("last", [1, 5, 3, 2, 4])])
@pytest.mark.parametrize("strict", [False, True])
def test_nulls(spark, make, nulls, want, strict):
    uri = make([("A", "2021-02-01", 1), (None, "2021-01-01", 2), ("B", None, 3), (None, "2021-03-01", 4), ("A", None, 5)], SCHEMA)
    t = SortOptimizer(uri, spark)
    t.compact(KEYS, nulls=nulls, repartition_by_sort_key=strict, target_file_size_bytes=1)
    t.validate(KEYS, nulls=nulls)
    assert values(spark, uri, KEYS, first=nulls == "first") == want
    assert len(tablelog.open_table(spark, uri).files) > 1
    with pytest.raises(ValueError, match="nulls must be 'first' or 'last', not 'middle'"):
        t.compact(KEYS, nulls="middle")


def test_partitions_by_int_and_bool(spark, make):
    rows = [(1, True, "2021-01-01", 10), (1, False, "2021-01-02", 20), (2, True, "2021-01-01", 30), (2, False, "2021-01-02", 40), (2, False, "2021-01-01", 50)]
    uri = make(rows, "id long, flag boolean, ts string, val long", ["id", "flag"])
    t = SortOptimizer(uri, spark)
    (group,) = plan(spark, tablelog.open_table(spark, uri), ["id", "ts"]).groups
    assert group.partition == (("flag", "false"), ("id", "2")) and group.rows_in == 2
    t.compact(["id", "ts"], concurrency=2)
    after = tablelog.open_table(spark, uri)
    assert not plan(spark, after, ["id", "ts"]).groups and len(after.files) == 4
    assert sorted(r.val for r in reader.scan(spark, after).collect()) == [10, 20, 30, 40, 50]


def test_partition_column_in_the_key(spark, make):
    rows = [("B", "2021-02-02", 4), ("A", "2021-02-01", 1), ("B", "2021-01-01", 2), ("A", "2021-03-01", 3), ("B", "2021-02-03", 5), ("A", "2021-01-15", 0)]
    uri = make(rows, SCHEMA, ["objectId"])
    SortOptimizer(uri, spark).compact(KEYS, repartition_by_sort_key=True)
    SortOptimizer(uri, spark).validate(KEYS)
    assert values(spark, uri, KEYS) == [0, 1, 3, 2, 4, 5]


def test_odd_partition_values(spark, make):
    names = ["1", "10", None, "null", "a b/c", "o'x", "é%41+"]
    uri = make([(n, k) for n in names for k in (3, 1, 2)], "p string, value long", ["p"])
    snapshot = tablelog.open_table(spark, uri)
    todo = plan(spark, snapshot, ["value"])
    assert len(todo.groups) == len(names) == len({g.partition for g in todo.groups})
    (ten,) = [g for g in todo.groups if g.partition == (("p", "10"),)]
    rewriter.compact_partitions(spark, snapshot, type(todo)(todo.table_uri, [ten]), SortConfig(("value",)))
    left = {g.partition for g in plan(spark, tablelog.open_table(spark, uri), ["value"]).groups}
    assert left == {(("p", n),) for n in names if n != "10"}
    orderkeep.compact(uri, ["value"], spark=spark)
    done = tablelog.open_table(spark, uri)
    assert not plan(spark, done, ["value"]).groups
    got = [(r.p, r.value) for r in reader.scan(spark, done).collect()]
    assert sorted(map(str, got)) == sorted(str((n, k)) for n in names for k in (1, 2, 3))


def test_commit_per_partition(spark, make):
    uri = make([(i % 3, -i) for i in range(30)], "p int, value int", ["p"])
    got = rewriter.compact(spark, uri, SortConfig(("value",), commit_per_partition=True, concurrency=2))
    assert tablelog.open_table(spark, uri).version == 3 and len(got) == 3
    total = metrics.totals(metrics.frame(spark, got)).first()
    assert (total.partitions, total.files_in, total.files_out) == (3, 3, 3) and total.bytes_out > 0


def test_boundaries(spark, make):
    def table(name, *parts):
        uri = make([(x,) for x in parts[0]], "v int", name=name)
        for p in parts[1:]:
            tablelog.append(spark, uri, spark.createDataFrame([(x,) for x in p], "v int").coalesce(1))
        return orderkeep.validate(uri, ["v"], spark=spark)

    assert table("overlap", [1, 5], [3, 9])["boundary_violations"] == 1
    assert table("touch", [1, 3], [3, 3], [3, 9]) == {"checked_files": 3, "boundary_violations": 0, "details_sample": []}
    assert table("equal_least", [1, 5], [1, 1])["boundary_violations"] == 0
    many = table("many", *[[0, 9]] * 25)
    assert many["boundary_violations"] == 24 and len(many["details_sample"]) == 20 and many["details_sample"][-1] == "... plus 5 more violations"
    assert all(" max > " in x for x in many["details_sample"][:-1])


def test_chunks_of_a_file(spark):
    rows = spark.createDataFrame([("f", i, v) for i, v in enumerate([1, 2, 5, 4, 4, 7, 6, 6, 1])] + [("g", 0, 3)], "file string, row long, v int")
    for size in (1, 2, 3, 100):
        got = {r.file: (r.n, r.inversions, r.mn.c0, r.mx.c0) for r in validator.file_stats(rows, F.struct(F.col("v").alias("c0")), "file", "row", chunk_rows=size).collect()}
        assert got == {"f": (9, 3, 1, 7), "g": (1, 0, 3, 3)}


@pytest.mark.parametrize("kind, items", [("byte", [3, 1]), ("short", [3, 1]), ("date", [datetime.date(2021, 2, 1), datetime.date(2021, 1, 1)]), ("decimal(10,2)", [decimal.Decimal("9.5"), decimal.Decimal("10.5"), decimal.Decimal("2")]), ("binary", [b"b", b"a"]), ("array<int>", [[2], [1, 5]]), ("timestamp_ntz", [datetime.datetime(2021, 2, 1), datetime.datetime(2021, 1, 1)]), ("double", [float("nan"), float("inf"), -0.0, 0.0, float("-inf")])])
def test_types(spark, make, kind, items):
    uri = make([(x,) for x in items], f"v {kind}")
    t = SortOptimizer(uri, spark)
    with pytest.raises(RuntimeError):
        t.validate(["v"])
    t.compact(["v"])
    t.validate(["v"])


def test_refusals(spark, make, tmp_path):
    uri = make([({"a": 1}, 1)], "m map<string,int>, v int")
    with pytest.raises(RuntimeError, match="without order"):
        orderkeep.compact(uri, ["m"], spark=spark)
    with pytest.raises(RuntimeError, match=r"missing sort columns: \['V'\]. Valid fields: \['m', 'v'\]"):
        orderkeep.compact(uri, ["V"], dry_run=True, spark=spark)
    assert orderkeep.compact(f"{tmp_path}/none", KEYS, dry_run=True, spark=spark) == []
    for f in (lambda: orderkeep.compact(f"{tmp_path}/none", KEYS, spark=spark), lambda: orderkeep.validate(f"{tmp_path}/none", KEYS, spark=spark)):
        with pytest.raises(RuntimeError, match="open_table"):
            f()
    assert orderkeep.validate(uri, [], spark=spark) == ValidationReport().as_dict() and orderkeep.compact(uri, [], spark=spark) == []
    log = f"{uri}/_delta_log/{1:020d}.json"
    with open(log, "w") as f:
        f.write(json.dumps({"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": []}}))
    with pytest.raises(RuntimeError, match="deletionVectors"):
        orderkeep.validate(uri, ["v"], spark=spark)


def test_names(spark, make):
    uri = make([(2, 1, 7), (1, 2, 8)], "`a.b` int, objectId int, `x``y` int")
    for key in (["a.b"], ["objectId", "x`y"]):
        orderkeep.compact(uri, key, spark=spark)
        assert orderkeep.validate(uri, key, spark=spark)["boundary_violations"] == 0
    with pytest.raises(RuntimeError, match="missing sort columns"):
        orderkeep.compact(uri, ["objectid"], spark=spark)


def test_empty(spark, make):
    uri = make([], "v int", name="e")
    assert orderkeep.validate(uri, ["v"], spark=spark)["checked_files"] == 0
    for strict in (False, True):
        orderkeep.compact(uri, ["v"], repartition_by_sort_key=strict, spark=spark)
    assert reader.read_ordered(spark, tablelog.open_table(spark, uri), ["v"]).count() == 0


def test_conflicts(spark, make):
    uri = make([(2,), (1,)], "v int")
    old = tablelog.open_table(spark, uri)
    tablelog.append(spark, uri, spark.createDataFrame([(3,)], "v int"))
    todo = plan(spark, old, ["v"])
    rewriter.compact_partitions(spark, old, todo, SortConfig(("v",)))  # an append in between is no conflict
    now = tablelog.open_table(spark, uri)
    assert sorted(r.v for r in reader.scan(spark, now).collect()) == [1, 2, 3] and now.version == 2
    with pytest.raises(tablelog.CommitConflict):
        rewriter.compact_partitions(spark, old, todo, SortConfig(("v",)))
    lines = [json.loads(x) for x in open(f"{uri}/_delta_log/{2:020d}.json")]
    assert all(not a.get("add", a.get("remove", {})).get("dataChange", False) for a in lines)
    assert not [n for n in os.listdir(f"{uri}/_delta_log") if n.endswith(".tmp")]


def test_checkpoint(spark, make):
    uri = make([(2,), (1,)], "v int")
    actions = [json.loads(x) for x in open(f"{uri}/_delta_log/{0:020d}.json")]
    add = next(a["add"] for a in actions if "add" in a)
    meta = next(a["metaData"] for a in actions if "metaData" in a)
    schema = "protocol struct<minReaderVersion:int,minWriterVersion:int>, metaData struct<id:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>, add struct<path:string,partitionValues:map<string,string>,size:long>"
    rows = [((1, 2), None, None), (None, (meta["id"], meta["schemaString"], [], {}), None), (None, None, (add["path"], {}, add["size"]))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{uri}/tmp")
    part = next(f for f in os.listdir(f"{uri}/tmp") if f.endswith(".parquet"))
    os.rename(f"{uri}/tmp/{part}", f"{uri}/_delta_log/{0:020d}.checkpoint.parquet")
    os.remove(f"{uri}/_delta_log/{0:020d}.json")
    orderkeep.compact(uri, ["v"], spark=spark)
    assert values(spark, uri, ["v"], "v") == [1, 2]


def test_checkpoint_of_many_partitions(spark, tmp_path):
    """A checkpoint in two files with partition values, tombstones and an application, and versions after it."""
    log, uri = f"{tmp_path}/t/_delta_log", f"{tmp_path}/t"
    os.makedirs(log)
    shape = json.dumps({"type": "struct", "fields": [{"name": c, "type": "string", "nullable": True, "metadata": {}} for c in ("a", "p")]})
    schema = "protocol struct<minReaderVersion:int>, metaData struct<schemaString:string,partitionColumns:array<string>>, add struct<path:string,partitionValues:map<string,string>,size:long,stats:string>, remove struct<path:string>, txn struct<appId:string,version:long>"
    head = [((1,), None, None, None, None), (None, (shape, ["p"]), None, None, None), (None, None, None, ("gone",), None), (None, None, None, None, ("app", 7))]
    adds = [(None, None, (f"f{i}", {"p": [None, "", "null", "x"][i % 4]}, i, "{}"), None, None) for i in range(40)]
    for k, rows in enumerate((head + adds[:10], adds[10:])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/c{k}")
        part = next(f for f in os.listdir(f"{tmp_path}/c{k}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/c{k}/{part}", f"{log}/{5:020d}.checkpoint.{k + 1:010d}.{2:010d}.parquet")
    later = [{"remove": {"path": "f3"}}, {"add": {"path": "f40", "partitionValues": {"p": "x"}, "size": 40}}, {"txn": {"appId": "app", "version": 8}}]
    with open(f"{log}/{6:020d}.json", "w") as f:
        f.write("\n".join(map(json.dumps, later)))
    got = tablelog.open_table(spark, uri)
    assert got.version == 6 and got.applications == {"app": 8} and got.partition_columns == ("p",)
    assert {f.path: (f.size, f.partition) for f in got.files} == {f"f{i}": (i, (("p", [None, None, "null", "x"][i % 4] if i < 40 else "x"),)) for i in range(41) if i != 3}
    assert len({id(f.partition) for f in got.files}) == 3
    assert tablelog.open_table(spark, uri, 5).applications == {"app": 7}
    os.rename(f"{log}/{6:020d}.json", f"{log}/{7:020d}.json")
    with pytest.raises(ValueError, match="version 6 is missing"):
        tablelog.open_table(spark, uri)


def test_command_line(spark, make, capsys, tmp_path):
    uri = make(UNSORTED, SCHEMA)
    run = lambda *a: (main(["--table", uri, "--sort-columns", "objectId,dateTime", *a]), capsys.readouterr())
    code, text = run("--validate-only")
    assert code == 1 and text.out.startswith("Validated files: 1 | boundary_violations: 1\nSample:\n- monotonicity violation within file: ") and "Ordering violations found: 1" in text.err
    assert run("--dry-run")[1].out == "Dry run completed: planned rewrites; see logs for details.\n"
    assert run("--log-level", "warning")[1].out == "Success: partition-aware compaction + sort completed.\n"
    assert run("--repartition-by-sort-key", "--nulls", "last")[1].out == "Success: full-table sorted overwrite completed.\n"
    code, text = run("--validate-only", "--nulls", "last")
    assert code == 0 and text.out.startswith("Validated files: 1 | boundary_violations: 0")
    assert main(["--table", f"{tmp_path}/none", "--dry-run"]) == 0
    for level in ("off", "trace", "WARN"):
        assert run("--dry-run", "--log-level", level)[0] == 0
    code, text = run("--dry-run", "--log-level", "loud")
    assert code == 1 and "no log level 'loud'" in text.err
    assert run("--commit-per-partition", "--concurrency", "2")[0] == 0


def test_literals():
    types = {"id": "integer", "active": "boolean", "amount": "decimal(10,2)", "country": "string"}
    for name, value, want in [("id", "42", '"id" = 42'), ("active", "true", '"active" = TRUE'), ("amount", "1234.50", '"amount" = 1234.50'), ("country", "US", "\"country\" = 'US'"), ("code", "001", "\"code\" = '001'"), ("id", "x1", "\"id\" = 'x1'"), ("country", "o'x", "\"country\" = 'o''x'")]:
        assert P.sql_predicate([(name, value)], types) == want
    assert P.sql_predicate([("region", "NULL")], types, null_text=True) == '"region" IS NULL' == P.sql_predicate([("region", None)])
    assert P.sql_predicate([("region", "null")]) == "\"region\" = 'null'" and P.sql_predicate([]) == "TRUE"
    assert P.sql_predicate([("a", "1"), ("b", None)], {"a": "long"}) == '"a" = 1 AND "b" IS NULL'


def test_read_partition(spark, make):
    rows = [(1, "null"), (10, None), (2, "a b/c"), (3, None), (4, "x")]
    snapshot = tablelog.open_table(spark, make(rows, "v int, p string", ["p"]))
    for value in ("null", None, "a b/c", "x", "no such"):
        got = reader.read_partition(spark, snapshot, (("p", value),), ["v"]).collect()
        assert sorted(r.v for r in got) == sorted(v for v, p in rows if p == value)


def test_a_commit_names_all_partitions_that_it_rewrites(spark, make):
    uri = make([(i % 30, -i) for i in range(60)], "p int, value int", ["p"])
    orderkeep.compact(uri, ["value"], spark=spark)
    info = json.loads(open(f"{uri}/_delta_log/{1:020d}.json").readline())["commitInfo"]
    assert info["operationParameters"]["predicate"].count('"p" = ') == 30


def test_run_summary_and_concurrency(spark, make, caplog):
    uri = make([(i % 3, -i) for i in range(30)], "p int, value int", ["p"])
    with caplog.at_level("INFO", "orderkeep"):
        SortOptimizer(uri, spark).compact(["value"], concurrency=2, commit_per_partition=True)
    assert tablelog.open_table(spark, uri).version == 3
    assert [m for m in caplog.messages if m.startswith("rewrote 3 partitions: files 3 -> 3, bytes ")]


def test_dry_run_forgives_what_keeps_it_from_planning(spark, make):
    uri = make([(2,), (1,)], "v int")
    with open(f"{uri}/_delta_log/{1:020d}.json", "w") as f:
        f.write("no json")
    assert orderkeep.compact(uri, ["v"], dry_run=True, spark=spark) == []
    with pytest.raises(RuntimeError):
        orderkeep.compact(uri, ["v"], spark=spark)


@pytest.mark.parametrize("target", [30_000, 100_000])
def test_file_sizes_follow_the_target(spark, make, target):
    uri = make([(i * 7919 % 100_003, f"{i * 104729 % 999_983:x}") for i in range(60_000)], "v long, s string")
    orderkeep.compact(uri, ["v"], target_file_size_bytes=target, spark=spark)
    sizes = [f.size for f in tablelog.open_table(spark, uri).files]
    assert max(sizes) <= 1.5 * target and len(sizes) <= 3 * sum(sizes) / target


def test_commit_on_another_store(spark, tmp_path):
    """By a scheme that isn't the local one a version is renamed into place, whole, and never replaced."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    store = tablelog.Store(spark, "viewfs://own/in/t")
    assert not store.local
    assert store.put_if_absent("_delta_log/a.json", "one") and not store.put_if_absent("_delta_log/a.json", "two")
    assert store.read("_delta_log/a.json") == "one"
    assert [n for n in os.listdir(f"{tmp_path}/t/_delta_log") if n.endswith(".tmp")] == []
    made = tablelog.create(spark, "viewfs://own/in/u", spark.createDataFrame([(2,), (1,)], "v int").coalesce(1))
    orderkeep.compact(made.uri, ["v"], spark=spark)
    assert values(spark, made.uri, ["v"], "v") == [1, 2] and tablelog.open_table(spark, made.uri).version == 1


def test_column_predicates(spark):
    df = spark.createDataFrame([(1, True, "null"), (10, False, None), (1, None, "x")], "id int, flag boolean, s string")
    count = lambda *v: df.filter(P.column_predicate(v, df.schema)).count()
    assert (count(("id", "1")), count(("flag", None)), count(("s", "null")), count(("s", None)), count(("id", "zz")), count(), count(("id", "1"), ("flag", "true"))) == (2, 1, 1, 1, 0, 3, 1)


@pytest.mark.parametrize("kind, strategy", [("int", st.integers(-10, 10)), ("boolean", st.booleans()), ("double", st.floats(allow_nan=False, allow_infinity=False)), ("string", st.text(st.characters(codec="utf-8", exclude_characters="\x00"))), ("timestamp_ntz", st.datetimes(datetime.datetime(1950, 1, 1), datetime.datetime(2090, 1, 1)))])
def test_any_column(spark, tmp_path_factory, kind, strategy):
    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(strategy, min_size=1, max_size=5))
    def run(items):
        uri = f"{tmp_path_factory.mktemp('any')}/t"
        tablelog.create(spark, uri, spark.createDataFrame([(x,) for x in items], f"v {kind}").coalesce(1))
        assert (orderkeep.validate(uri, ["v"], spark=spark)["boundary_violations"] == 0) == (items == sorted(items))
        orderkeep.compact(uri, ["v"], spark=spark)
        assert values(spark, uri, ["v"], "v") == sorted(items)
        SortOptimizer(uri, spark).validate(["v"])

    run()
