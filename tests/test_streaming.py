import pytest

import orderkeep
from orderkeep.sources import reader, tablelog
from orderkeep.streaming.sink import append_batch, append_stream


def test_stream_into_table(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, -i, f"v{i}") for i in range(90)], "p int, k int, s string")
    df.repartition(6).write.parquet(f"{tmp_path}/in")
    uri = f"{tmp_path}/t"
    tablelog.create(spark, uri, df.limit(0), ["p"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    append_stream(stream, uri, "s1", f"{tmp_path}/ck", ["k"]).awaitTermination(120)
    now = tablelog.open_table(spark, uri)
    assert now.version == 3 and now.applications == {"s1": 2}
    assert sorted(r.k for r in reader.scan(spark, now).collect()) == sorted(r.k for r in df.collect())
    orderkeep.compact(uri, ["p", "k"], spark=spark)
    assert orderkeep.validate(uri, ["p", "k"], spark=spark)["boundary_violations"] == 0


def test_repeated_batch(spark, tmp_path):
    df = spark.createDataFrame([(2,), (1,)], "k int")
    uri = f"{tmp_path}/t"
    old = tablelog.create(spark, uri, df)
    assert append_batch(df, 0, uri, "s", ["k"]) and not append_batch(df, 0, uri, "s", ["k"]) and append_batch(df, 1, uri, "s", ["k"])
    assert reader.scan(spark, tablelog.open_table(spark, uri)).count() == 6
    with pytest.raises(tablelog.CommitConflict):
        tablelog.commit(spark, old, [], [], "STREAMING UPDATE", {}, True, ("s", 0))
