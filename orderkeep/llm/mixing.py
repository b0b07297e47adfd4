"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Sources get targets by weight, none above MAX_PASSES times its size; what exceeds is shared anew by weight. The mix is
dealt in equal blocks of words: seat by seat to the source with the highest quotient target / (2 * seats + 1), which
gives each source an integer quota of blocks for each shard of the mix (a shard is a run of seats; quotas are found for
all shards at once, from seats near each source's exact share on). A source's documents lie end to end in a seeded
order, cut into blocks; its seats take its blocks in a seeded permutation, pass after pass, MAX_PASSES times at most.
So a document's pieces, and the words that the mix takes of it, follow from its offset alone.

Offsets are prefix sums over BUCKETS seeded buckets of a source and within them, so no source meets in a task. The
sources' table (a row for each) is ordered in one task; it is joined by broadcast while it has MAX_SMALL rows at most.

Defined results: a null text has no words; a null source is one source, the last; sources of no words have target 0.
Rows that agree in id and size come in the order of a hash of their texts; repeated rows take places of their own. A very
long text is as many blocks as it takes. An empty table gives an empty result.
Other columns of the input are passed on where asked for, in a struct of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderkeep.llm.common import table
from orderkeep.session import cut, stored

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_PASSES = 2
SHARDS = 8
#: Words of a block; more where the corpus has over MAX_BLOCKS of that size.
BLOCK_WORDS, MAX_BLOCKS = 32, 1 << 30
BUCKETS = 1024
SEED = "mix"
MAX_SMALL = 20_000
# Primes next below 2**31, multipliers of the permutations.
PRIMES = (2147483647, 2147483629, 2147483587)


def seeded(*parts: Column | str) -> Column:
    """A number below 2**60 by the md5 of the parts, which SQL elsewhere can give as well."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_SMALL else df


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, passes: int = MAX_PASSES) -> DataFrame:
    """Of (source, source_size) also sid (its number by code points, null last, from 0), weight and target."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))) + 1)
    s = sizes.withColumn("sid", F.row_number().over(by) - 1).withColumn("weight", weight).withColumn("cap", passes * F.col("source_size"))
    # sources reach their caps in the order of cap / weight; the first that does not gives the level for it and all later ones
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    goal = F.sum("source_size").over(whole) * percent / 100
    s = s.withColumn("level", (goal - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("at", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(whole)["level"])
    return s.select("source", "source_size", "sid", "weight", F.coalesce(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def quotas(sources: DataFrame, seats: int, shards: int = SHARDS) -> DataFrame:
    """(sid, upto array): by each shard's end the blocks that the source has by then, by highest quotients over `seats` seats."""
    total = Window.partitionBy("shard")
    house = sources.filter("target > 0").select("sid", "target", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard"))
    house = house.withColumn("house", F.floor(F.col("shard") * F.lit(seats).cast("long") / shards))
    share = F.col("target") / F.sum("target").over(total)
    house = house.withColumns({"exact": F.floor(F.col("house") * share), "off": F.ceil(1.5 * F.count("*").over(total) * share) + 2})
    house = house.withColumn("low", F.greatest(F.col("exact") - F.col("off"), F.lit(0)))
    open_ = house.withColumn("left", F.col("house") - F.sum("low").over(total))
    seat = open_.select("*", F.explode(F.sequence("low", F.col("exact") + F.col("off"))).alias("seat"))
    best = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "sid", "seat")
    won = seat.withColumn("place", F.row_number().over(best))
    got = won.groupBy("sid", "shard").agg((F.first("low") + F.count_if(F.col("place") <= F.col("left"))).alias("upto"))
    return got.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("upto"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shards: int = SHARDS, keep: Sequence[str] = ()) -> DataFrame:
    """(id_col, size, source_size, target, taken, pieces), a row for each of df's. pieces: array of (pass, shard,
    first_word, words), what the mix takes of the document; taken: their words. keep: columns to pass on, in struct `row`."""
    key = seeded(id_col)
    rows = df.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), key.alias("__h"), *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.xxhash64(text_col).alias("__t")] if keep else []))
    rows = rows.withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))
    sums = cut(rows.groupBy("source", "__b").agg(F.sum("size").alias("words")))
    sources = cut(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    total = sources.agg(F.sum("source_size"), F.sum("target")).first()
    block = max(block_words, (total[0] or 0) // MAX_BLOCKS)
    quota = quotas(sources, round((total[1] or 0) / block), shards)
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), F.pmod("__p", F.lit(len(PRIMES))).cast("int") + 1)
    blocks = F.ceil(F.col("source_size") / block)
    plan = sources.join(quota, "sid", "left").withColumn("__p", seeded(F.lit("source"), F.col("sid")))
    plan = cut(plan.select("source", "source_size", "target", "sid", F.coalesce("upto", F.array_repeat(F.lit(0).cast("long"), shards)).alias("upto"), blocks.alias("blocks"), prime.cast("long").alias("mult"), F.when(blocks > 0, F.pmod("__p", blocks)).otherwise(0).alias("shift")))
    few = _small(plan)
    first = Window.partitionBy("sid").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.join(few.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("sid", "__b", F.coalesce(F.sum("words").over(first), F.lit(0)).alias("begin"))
    here = rows.join(few.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    within = Window.partitionBy("sid", "__b").orderBy("__h", "__id", "size", *(["__t"] if keep else [])).rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumn("__in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(begins, ["sid", "__b"])
    here = here.withColumn("__off", F.col("begin") + F.col("__in"))
    end = F.col("__off") + F.col("size")
    spot = lambda b: F.pmod(b * F.col("mult") + F.col("shift"), F.col("blocks"))
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("__off") / block), F.floor((end - 1) / block))).otherwise(F.array().cast("array<bigint>"))
    seats = F.element_at("upto", -1)

    def piece(b: Column, turn: int) -> Column:
        seat = spot(b) + turn * F.col("blocks")
        begin = F.greatest(b * block, F.col("__off"))
        words = F.least((b + 1) * block, end) - begin
        return F.when(seat < seats, F.struct(F.lit(turn).alias("pass"), F.size(F.filter("upto", lambda u: u <= seat)).alias("shard"), (begin - F.col("__off")).alias("first_word"), words.alias("words")))

    pieces = F.filter(F.flatten(F.transform(touched, lambda b: F.array(*(piece(b, k) for k in range(MAX_PASSES))))), lambda x: x.isNotNull())
    out = here.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "pieces", *(["row"] if keep else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS h FROM documents),
sz AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM sz),
w AS (SELECT *, [5, 2, 1][sid % 3 + 1] AS weight, 2 * source_size AS cap FROM n),
l AS (SELECT *, (sum(source_size) OVER () * 150.0::DOUBLE / 100 - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
lv AS (SELECT level AS lvl FROM l WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, sid LIMIT 1),
t AS (SELECT source, source_size, sid, least(cap::DOUBLE, (SELECT lvl FROM lv) * weight) AS target FROM l),
tot AS (SELECT sum(source_size) AS words, sum(target) AS target, greatest(32, (sum(source_size)::BIGINT >> 30)) AS block FROM t),
house AS (SELECT sid, target, target / sum(target) OVER () AS share, count(*) OVER () AS n, round((SELECT target / block FROM tot))::BIGINT AS house FROM t WHERE target > 0),
low AS (SELECT *, greatest(floor(house * share) - ceil(1.5 * n * share) - 2, 0)::BIGINT AS low, (floor(house * share) + ceil(1.5 * n * share) + 2)::BIGINT AS high FROM house),
lef AS (SELECT *, house - sum(low) OVER () AS lft FROM low),
seat AS (SELECT *, unnest(range(low, high + 1)) AS seat FROM lef),
won AS (SELECT *, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, sid, seat) AS place FROM seat),
q AS (SELECT sid, (first(low) + count(*) FILTER (WHERE place <= lft))::BIGINT AS seats FROM won GROUP BY sid),
p AS (SELECT t.*, coalesce(q.seats, 0) AS seats, ceil(source_size / (SELECT block FROM tot))::BIGINT AS blocks,
         ('0x' || substr(md5('mix:source:' || t.sid), 1, 15))::BIGINT AS ph FROM t LEFT JOIN q USING (sid)),
o AS (SELECT d.*, p.*, (SELECT block FROM tot) AS block,
         coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h % 1024, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT doc_id, row_number() OVER () AS r, size, source_size, target, off, block, blocks, seats,
         [2147483647, 2147483629, 2147483587][ph % 3 + 1]::BIGINT AS mult, CASE WHEN blocks > 0 THEN ph % blocks ELSE 0 END AS shift FROM o),
e AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(off // block, (off + size - 1) // block + 1) ELSE [NULL] END) AS k FROM b),
s AS (SELECT r, doc_id, size, source_size, target, CASE WHEN k IS NULL THEN 0 ELSE
         (least((k + 1) * block, off + size) - greatest(k * block, off)) * ((((k * mult + shift) % blocks) < seats)::INT + (((k * mult + shift) % blocks) + blocks < seats)::INT) END AS part FROM e)
SELECT doc_id, size, source_size, target, sum(part)::BIGINT AS taken FROM s GROUP BY r, doc_id, size, source_size, target
"""


def copies(mixed: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Rows of mix() (written, so that they are computed once) with `copies`: how often the whole document comes.

    That is taken / size, rounded down or up: of a source those documents are rounded up whose remainder plus a seeded draw
    is largest, as many as bring the source's words to what the mix takes of it. The sums that tell how many are those of
    BUCKETS classes of a source; of the class where the words are reached a seeded share is rounded up, so a source's words
    are off by part of such a class, a thousandth of the source, or by one document where classes hold one."""
    drawn = lambda name: (F.pmod(seeded(F.lit(name), id_col), F.lit(4096))) / 4096
    # the quotient in doubles, rounded to binary places, so that sums and comparisons are the same anywhere
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") * 65536) / 65536).otherwise(0.0)
    rows = mixed.withColumn("__times", times).withColumn("__base", F.floor("__times"))
    rows = rows.withColumn("__class", F.when(F.col("__times") > F.col("__base"), F.floor((F.col("__times") - F.col("__base") + drawn("copies")) * (BUCKETS // 2))))
    sums = cut(rows.groupBy(F.col(source_col).alias("__s"), "__class").agg(F.sum(F.when(F.col("__class").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("taken") - F.col("__base") * F.col("size")).alias("rest")))
    upper = Window.partitionBy("__s").orderBy(F.desc_nulls_last("__class")).rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.select("__s", "__class", "words", F.sum("rest").over(Window.partitionBy("__s")).alias("rest"), F.coalesce(F.sum("words").over(upper), F.lit(0)).alias("before")).filter("__class IS NOT NULL AND before < rest AND before + words >= rest")
    last = cut(reached.select("__s", F.col("__class").alias("__last"), ((F.col("rest") - F.col("before")) / F.col("words")).alias("__share")))
    got = rows.join(_small(last), F.col(source_col).eqNullSafe(F.col("__s")), "left")
    more = F.when(F.col("__class") > F.col("__last"), 1).when((F.col("__class") == F.col("__last")) & (drawn("more") < F.col("__share")), 1).otherwise(0)
    return got.withColumn("copies", (F.col("__base") + more).cast("long")).drop("__s", "__last", "__share", "__times", "__base", "__class")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, so that each source's words come near its target.

    Documents come whole: blocks that cut them, and shards, tell how much is taken only. Those without words go. Rows that
    share an id share its draws; extra columns are passed on."""
    mixed = stored(mix(docs, keep=docs.columns).select(F.col("row.doc_id").alias("__id"), F.col("row.source").alias("__source"), "row", "size", "taken"))
    taken = copies(mixed, "__id", "__source").filter("copies > 0").select("row", "copies")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("row")[c].alias(c) for c in docs.columns))
