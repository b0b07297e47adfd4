"""The pipeline's rows against a plain version of each stage."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_ngram_join import brute as brute_groups
from test_quality_rules import brute as brute_counts
from test_quality_rules import brute_kept

import corpus_pipeline as C
from orderkeep.llm import mixing, quality_model, quality_rules

SF = "/root/testdata/sf0.001"


def plain_copies(rows):
    """Of (id, source, size, taken) how often each document comes, source by source."""
    drawn = lambda name, i: int(hashlib.md5(f"mix:{name}:{i}".encode()).hexdigest()[:15], 16) % 4096 / 4096
    out, half = {}, mixing.BUCKETS // 2
    for source in {r[1] for r in rows}:
        own, rest, classes = [r for r in rows if r[1] == source], 0, defaultdict(list)
        for i, _, size, taken in own:
            times = math.floor(taken / size * 65536) / 65536 if size else 0.0
            out[i] = int(times)
            rest += taken - out[i] * size
            if times > out[i]:
                classes[math.floor((times - out[i] + drawn("copies", i)) * half)].append((i, size))
        before = 0
        for c in sorted(classes, reverse=True):
            words = sum(size for _, size in classes[c])
            for i, _ in classes[c]:
                out[i] += before + words < rest or (before < rest and drawn("more", i) < (rest - before) / words)
            before += words
    return out


def plain(docs, labels, folder):
    """(doc_id, lang, source, n_tokens, sha256 of the ids) of each row that the pipeline should return."""
    # classifier: a model of the labelled rows that aren't held out, in the order of training
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    known = [(i, q) for i, q in labels if i in texts and zlib.crc32(str(i).encode()) % 3 != 1]
    x = quality_model.features([texts[i] for i, _ in known])
    model = quality_model.fit(x, np.array([float(q) for _, q in known]))
    docs = [d for d, s in zip(docs, model.score(quality_model.features([d["text"] or "" for d in docs])), strict=True) if s >= 0.5]
    # rules
    counts = {d["doc_id"]: brute_counts(d["text"]) for d in docs}
    passed = Counter((d["lang"], d["source"]) for d in docs if not counts[d["doc_id"]][5])
    pools = defaultdict(list)
    for d in docs:
        big = passed[d["lang"], d["source"]] >= quality_rules.MIN_ROWS
        pools[d["lang"], d["source"] if big else None].append(d)
    kept = set()
    for pool in pools.values():
        rows = [counts[d["doc_id"]] for d in pool]
        good = [not r[5] for r in rows]
        verdict = brute_kept(rows) if sum(good) >= quality_rules.MIN_ROWS else good
        kept |= {d["doc_id"] for d, v in zip(pool, verdict, strict=True) if v}
    docs = [d for d in docs if d["doc_id"] in kept]
    # near-duplicates
    stay = {i for i, _, c in brute_groups([(d["doc_id"], d["text"]) for d in docs]) if i == c}
    docs = [d for d in docs if d["doc_id"] in stay]
    # mixing, by SQL
    import pyarrow as pa

    pq.write_table(pa.Table.from_pylist(docs), f"{folder}/docs.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/docs.parquet')")
    taken = {i: (size, n) for i, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP4_SQL})").fetchall()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    copies = plain_copies([(d["doc_id"], d["source"], *taken[d["doc_id"]]) for d in docs])
    out = []
    for d in docs:
        ids = np.array(enc.encode_ordinary(d["text"] or ""), "<u4")
        out += [(d["doc_id"], d["lang"], d["source"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest())] * copies[d["doc_id"]]
    return sorted(out)


def test_against_plain_version(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()]
    got = sorted((r.doc_id, r.lang, r.source, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in C.run(spark, SF).collect())
    want = plain(docs, labels, tmp_path)
    assert 50 < len(want) and got == want


def test_mixed_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    want = {r.source: (r.target, r.most) for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("most")).collect()}
    staged = mixing.stage(spark, docs, "")
    got = {r.source: r.n for r in staged.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    assert staged.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert all(abs(got.get(s, 0) - target) <= most + 2 * mixing.BLOCK_WORDS for s, (target, most) in want.items())
    assert sum(abs(got.get(s, 0) - t) for s, (t, _) in want.items()) < 0.03 * sum(t for t, _ in want.values())


def test_extra_columns_with_clashing_names(spark):
    """Columns named like those that stages make of their own are passed on as they are."""
    names = ("n_words", "kept", "size", "taken", "copies", "score", "component_id", "row", "id", "key", "ids")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names})
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", *names]), name
    rows = docs.collect()
    assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    assert C.STAGES[-1][1](spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("k", range(len(C.STAGES)))
def test_odd_rows(spark, k):
    name, stage = C.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "some words of a long text " * 5000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six seven eight nine ten", "en", None, 1), (3, "one two three four five six seven eight nine ten", "en", None, 1), (None, "x y z", "fr", "b", 2), (None, "x y z", "fr", "b", 2), (4, long, "en", "a", 3)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns or k == len(C.STAGES) - 1
    got = out.collect()
    assert len(got) <= 2 * len(rows)
    if "join" in name:
        assert sorted(Counter(r.doc_id for r in got).items(), key=str) == [(1, 1), (2, 1), (3, 1), (4, 1), (None, 1)]
    assert stage(spark, docs.limit(0), SF).count() == 0
