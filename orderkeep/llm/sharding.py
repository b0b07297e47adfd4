"""Sharding by balanced label propagation.

Documents of one group are linked with each other (through the group, so that a group of n has n links to keep, not
n * n). Linked documents begin in seeded shards, their first labels; no label holds room before it is won. In each round
a group asks for the shard with the most of its documents' labels that has room for all of it, and for any shard with
room if none of those has. Requests are admitted up to each shard's room, larger groups first, and all documents of an
admitted group move at once. Rounds end when nothing moves: then each group left is larger than the room of every shard,
so fewer than SHARDS are. These, and before all others the groups larger than a shard, are laid end to end over the
room, so that at most SHARDS - 1 cuts fall on each of both kinds. Documents without links then fill up the shards
exactly, so that counts are at most one apart (the law `rows`).

In each round a shard's room shrinks below two thirds or all its requests are met, so there are at most some
SHARDS * log(documents) rounds; each handles only the groups not yet placed.

Ranks come from prefix sums over BUCKETS seeded buckets and row numbers within them, so neither a shard nor a group
meets in a task; those of requests from prefix sums over CLASSES. The driver sees per-shard counts and fewer than
2 * SHARDS groups.

op3_sharding links equal texts, told by their 64-bit hash (two of n different texts share one with a chance near n * n /
2**65; they would be put together, which breaks no law). With such groups a label spreads within one round: a group is a
star, there is nothing to pass on to neighbours of neighbours; shard() takes any other grouping as well.

Defined results: a null text is empty, of size 1. Repeated rows are documents of one group. A null id is a seed like any
other. A very long text counts as one document, whatever its bytes (the law is of rows). An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderkeep.llm.common import table
from orderkeep.session import cut

SHARDS = 8
BUCKETS = 1024
#: Classes of requests: by the group's size as a power of two, and by so many hash classes of groups.
CLASSES = 64


def ranked(df: DataFrame, parts: Sequence[str], bucket: Column, order: Sequence[str], to: str, buckets: int) -> DataFrame:
    """df (checkpointed) with the rank of each row among those that agree in parts, from 0, by bucket and then order.

    The table of counts has a row for each part and bucket at most; parts is shards or nothing, so it is broadcast."""
    rows = df.withColumn("__bucket", bucket)
    by = [*parts, "__bucket"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    begins = cut(counts.select(*by, (F.sum("n").over(Window.partitionBy(*parts).orderBy("__bucket")) - F.col("n")).alias("__begin")))
    own = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.join(F.broadcast(begins), by).withColumn(to, F.col("__begin") + own).drop("__bucket", "__begin")


def _fill(df: DataFrame, room: Sequence[int], bucket: Column, buckets: int) -> DataFrame:
    """df (checkpointed) with each row's shard: by bucket, then group and seed, rows fill the room, the largest first."""
    turns = sorted(range(len(room)), key=lambda s: (-room[s], s))
    bounds = [sum(room[s] for s in turns[: k + 1]) for k in range(len(turns))]
    rows = ranked(df, [], bucket, ["group", "seed", "id"], "rank", buckets)
    turn = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= F.col("rank")))
    return rows.withColumn("shard", F.element_at(F.array(*map(F.lit, turns)), turn + 1)).drop("rank")


def _lay(df: DataFrame, room: Sequence[int], buckets: int) -> tuple[DataFrame, list[int]]:
    """The documents of df (checkpointed; fewer than SHARDS groups) end to end over the room, and the room that is left."""
    groups = [r[0] for r in df.select("group", "members").distinct().orderBy(F.desc("members"), "group").collect()]
    if not groups:
        return df.withColumn("shard", F.lit(None).cast("int")), list(room)
    at = F.array_position(F.array(*(F.lit(g).cast("long") for g in groups)), F.col("group")) - 1
    laid = cut(_fill(df, room, at * buckets + F.pmod("seed", F.lit(buckets)), buckets))
    load = {r[0]: r[1] for r in laid.groupBy("shard").count().collect()}
    return laid, [most - load.get(s, 0) for s, most in enumerate(room)]


def propagate(linked: DataFrame, quota: Sequence[int], rounds: int | None = None) -> DataFrame:
    """linked: (group, members, seed, shard, ...), checkpointed; the same with the shards after the last round, null for
    groups that no shard has room for. Rounds run until nothing moves unless their number is given."""
    shards, room, turn = len(quota), list(quota), 0
    near = lambda s: F.pmod(s + F.col("group"), F.lit(shards))  # noqa: E731  # for ties: each group prefers shards in an order of its own
    todo = cut(linked.groupBy("group", "members").agg(*(F.count_if(F.col("shard") == s).alias(f"n{s}") for s in range(shards))))
    placed = todo.limit(0).select("group", F.lit(0).alias("shard"))
    while rounds is None or turn < rounds:
        turn += 1
        votes = F.array(*(F.when(F.col("members") <= room[s], F.struct(F.col(f"n{s}").alias("n"), near(F.lit(s).cast("long")).alias("tie"), F.lit(s).alias("shard"))) for s in range(shards)))
        asked = todo.withColumn("to", F.array_max(votes)["shard"]).filter("to IS NOT NULL")  # room only shrinks
        asked = cut(asked.withColumn("class", (63 - F.floor(F.log2("members"))) * CLASSES + F.pmod(F.xxhash64("group"), F.lit(CLASSES))))
        # 64 * CLASSES * shards rows at most
        sums = asked.groupBy("to", "class").agg(F.sum("members").alias("n"))
        begins = cut(sums.select("to", "class", (F.sum("n").over(Window.partitionBy("to").orderBy("class")) - F.col("n")).alias("begin")))
        own = F.sum("members").over(Window.partitionBy("to", "class").orderBy(F.xxhash64("group", F.lit(1)), "group").rowsBetween(Window.unboundedPreceding, 0))
        fits = F.col("begin") + own <= F.element_at(F.array(*(F.lit(r).cast("long") for r in room)), F.col("to") + 1)
        asked = cut(asked.join(F.broadcast(begins), ["to", "class"]).withColumn("fits", fits).drop("begin", "class"))
        told = asked.groupBy("to", "fits").agg(F.sum("members")).collect()
        for s, moves, n in told:
            room[s] -= n if moves else 0
        placed = placed.unionByName(asked.filter("fits").select("group", F.col("to").alias("shard")))
        todo = asked.filter(~F.col("fits")).drop("to", "fits")
        if all(moves for _, moves, _ in told):  # nothing is left to move
            break
    return cut(linked.drop("shard").join(cut(placed), "group", "left"))


def shard(df: DataFrame, group: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot), a row for each of df's; rows of an equal group (a long) are linked."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = cut(df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group.alias("group")).withColumn("seed", F.xxhash64("id", "group")))
    n = docs.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    groups = cut(docs.groupBy("group").agg(F.count("*").alias("members")))
    docs = cut(docs.join(groups, "group"))
    large, room = _lay(docs.filter("members > 1").filter(F.col("members") > max(quota)), quota, buckets)
    begin = F.pmod(F.xxhash64("seed", F.lit("begin")), F.lit(shards)).cast("int")
    linked = propagate(docs.filter("members > 1").filter(F.col("members") <= max(quota)).withColumn("shard", begin), room)
    load = {r[0]: r[1] for r in linked.groupBy("shard").count().collect()}
    room = [most - load.get(s, 0) for s, most in enumerate(room)]
    left, room = _lay(linked.filter("shard IS NULL").drop("shard"), room, buckets)
    single = _fill(docs.filter("members = 1"), room, F.pmod("seed", F.lit(buckets)), buckets)
    whole = cut(large.unionByName(linked.filter("shard IS NOT NULL")).unionByName(left).unionByName(single))
    out = ranked(whole, ["shard"], F.pmod("seed", F.lit(buckets)), ["seed", "id"], "slot", buckets)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards, equal texts together as far as counts allow."""
    same = F.xxhash64(F.coalesce("text", F.lit("")))
    out = shard(table(spark, sf_dir, "documents"), same)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
