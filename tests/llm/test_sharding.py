import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orderkeep.llm import sharding as S


@pytest.mark.parametrize("kind", ["mixed", "hot", "all"])
def test_laws(spark, kind):
    rng = random.Random(kind)
    texts = {"mixed": lambda i: rng.choice([f"only {i}", f"copy {rng.randint(0, 60)}"]), "hot": lambda i: rng.choice(["hot é", f"t{i}", f"u{i // 3}"]), "all": lambda i: "same"}[kind]
    rows = [(i, texts(i)) for i in range(701)] + [(1000, None), (1001, ""), (None, "x" * 100_000), (5, "five"), (5, "five")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, shard string").repartition(5)
    got = S.shard(df, F.xxhash64(F.coalesce("text", F.lit(""))), buckets=64).collect()
    key = lambda d, s, c: (d is None, d or 0, s, c)
    assert sorted(key(r.doc_id, r.size, r.text_crc32) for r in got) == sorted(key(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    count = Counter(r.shard for r in got)
    assert set(count) <= set(range(8)) and max(count.values()) - min(count.get(s, 0) for s in range(8)) <= 1
    slots = defaultdict(list)
    groups = defaultdict(Counter)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r.size][r.shard] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # a group is cut only where it must be, or where it was the last one admitted
    cut_up = [g for g in groups.values() if len(g) > 1]
    least = sum(-(-sum(g.values()) // max(count.values())) - 1 for g in groups.values())
    assert sum(len(g) - 1 for g in cut_up) <= least + 8, (cut_up, least)
    again = S.shard(df.repartition(3), F.xxhash64(F.coalesce("text", F.lit(""))), buckets=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rounds_by_brute_force(spark):
    """One round of votes against the same written out plainly, with room for all."""
    rng = random.Random(9)
    rows = [(rng.randint(0, 40), i, rng.randint(0, 7)) for i in range(300)]
    members = Counter(g for g, *_ in rows)
    df = spark.createDataFrame([(g, members[g], i, s) for g, i, s in rows], "group long, members long, seed long, shard int")
    got = {r.seed: r.shard for r in S.propagate(df, [10_000] * 8, rounds=1).collect()}
    votes = defaultdict(Counter)
    for g, _, s in rows:
        votes[g][s] += 1
    for g, i, _ in rows:
        assert got[i] == max((n, (s + g) % 8, s) for s, n in votes[g].items())[2]


@pytest.mark.parametrize("sizes", [(4, 4), (2, 9)])
def test_all_documents_have_copies(spark, sizes):
    """Without single documents to make room, fewer groups than shards are split."""
    rng = random.Random(5)
    rows = [(g, f"text {g}") for g in range(600) for _ in range(rng.randint(*sizes))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(5)
    got = S.shard(df, F.xxhash64("text"), buckets=64).collect()
    count, groups = Counter(r.shard for r in got), defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1
    assert sum(len(s) > 1 for s in groups.values()) < 8


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.shard(df, F.xxhash64("text")).count() == 0


def test_query(spark):
    """op3's laws over a whole table: counts at most one apart, gapless slots, equal texts apart only where they must be."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = S.op3_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()} and len(got) == len(docs)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None)
        slots[r.shard].append(r.slot)
        groups[docs[r.doc_id]].add(r.shard)
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sum(len(s) > 1 for s in groups.values()) < 8
