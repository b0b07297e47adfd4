import random
import re

import numpy as np

from orderkeep.llm import ngram_join as N
from orderkeep.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                par[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    passage = [rng.choice(pool) for _ in range(60)]
    bases = [[rng.choice(pool) for _ in range(rng.randint(1, 120))] for _ in range(max(2, n // 10))]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3) if rng.random() < 0.7 else 0):
            if w:
                w[rng.randrange(len(w))] = rng.choice(pool).upper()
        if rng.random() < 0.3:
            w += passage[: rng.randint(10, 60)]
        rows.append((i * 7 % (n * 7 + 1), " ".join(w)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, n, limit, segment, times in ((1, 150, 1024, 1 << 14, 16), (2, 300, 7, 50, 2)):
        monkeypatch.setattr(N, "BLOCK_ROWS", limit)
        monkeypatch.setattr(N, "SEGMENT_NGRAMS", segment)
        monkeypatch.setattr(N, "MIN_TIMES", times)  # 2: many n-grams are frequent
        rows = corpus(seed, n)
        rows += [(100_000, None), (100_001, ""), (100_002, " \n"), (100_003, "a b"), (100_004, "A\tB"), (None, "a b"), (None, "solo words"), (100_005, "x y " * 50_000), rows[0], rows[0]]
        df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, component_id string").repartition(5)
        got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in N.near_groups(df).collect())
        assert got == brute(rows)
        often = N.frequent_ngrams(df.select("text"), 5, 1 << 20, n)
        assert (len(often) > 100) == (times == 2) and (np.diff(often.astype(np.int64)) > 0).all()
    assert N.near_groups(df.limit(0)).count() == 0


def test_partial_overlaps_add_up(spark):
    """One cell in blocks of 3 and several fragments: each pair's partial overlaps sum to the whole overlap, once."""
    rng = np.random.default_rng(4)
    sets = {v: np.unique(rng.integers(0, 1 << 62, 60).astype("<u8") // (1 << 52)) << np.uint64(52) for v in range(20)}
    sets[3] = sets[3][:0]
    cells = spark.createDataFrame([(7, v, len(h), bytearray(h.tobytes())) for v, h in sets.items()], "root long, v long, n long, shared binary")
    seen = {}
    rows = cells.selectExpr("*", "7 AS blocks", "int(v % 7) AS own", "5 AS fragments").mapInArrow(lambda bs: (x for b in bs for x in N._segments(b)), N._SEGMENT).orderBy("root", "x", "y", "g", "side", "v").coalesce(1)
    for r in rows.mapInArrow(N._partial, N._PARTIAL).collect():
        left, right = (np.frombuffer(x, np.int64) for x in (r.left, r.right or r.left))
        counts = np.frombuffer(r.counts, "<u2").reshape(len(left), len(right))
        for i, a in enumerate(left.tolist()):
            for j, b in enumerate(right.tolist()):
                if a < b or r.right:
                    seen.setdefault((min(a, b), max(a, b)), []).append((r.g, int(counts[i, j])))
    assert len(seen) == 190 and all(sorted(g for g, _ in x) == list(range(5)) for x in seen.values())
    assert all(sum(n for _, n in x) == len(np.intersect1d(sets[a], sets[b])) for (a, b), x in seen.items())
    assert len([1 for x in seen.values() if sum(n > 0 for _, n in x) > 1]) > 50


def test_many_fragments_keep_all_bits():
    h = np.unique(np.random.default_rng(5).integers(0, 1 << 62, 5000, dtype=np.uint64))
    for bits in (6, 9, 30):
        shift = np.uint64(N.HASH_BITS - bits)
        back = N._unpack(N._pack(h)) & np.uint64((1 << (N.HASH_BITS - bits)) - 1) | (h >> shift) << shift
        assert (back == h).all()
    n, own = N._bytes(np.array([1, 255, 256, 700]), np.arange(4))
    assert n.tolist() == [1, 255, 255, 1, 255, 255, 190] and own.tolist() == [0, 1, 2, 2, 3, 3, 3]


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 300))).astype("<u8") for _ in range(40)]
    got, half = N.overlaps(sets, columns=37), N.overlaps(sets[:15], sets[15:], 37)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40))
    assert (half == got[:15, 15:]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(-50, 300), rng.randint(-50, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    par = {x: x for e in edges for x in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in par)


def test_stage_with_repeated_ids(spark):
    """One row of each component stays, that of the smallest id, though ids repeat on different texts."""
    a, b, c = ("one two three four five six seven", "red green blue white black grey", "up down left right in out")
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b), (9, c), (None, c), (None, c), (7, ""), (7, None), (7, "")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = N.stage(spark, docs, "").collect()
    assert sorted((r.text or "-") for r in got) == sorted([a, b, c, "-", "-"])
    assert {(r.doc_id, r.text) for r in got if r.text in (a, b)} == {(3, a), (5, b)}
    assert sorted(r.doc_id for r in got if not r.text) == [7, 7]
