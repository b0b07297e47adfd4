import hashlib
import random

import numpy as np

from orderkeep.llm import fingerprints as fp
from orderkeep.llm.textkernel import shingles


def test_shingle_hashes():
    a, b, c = shingles(["A b c d e f", "x\ty", " \n "])
    assert len(a) == 2 and len(b) == 1 and len(c) == 0
    (d,) = shingles(["a B C d e"])
    assert d[0] == a[0]


def test_estimates():
    rng = random.Random(1)
    sketch = fp.Sketch()
    order = sketch.order()
    errors = []
    for n in (1, 3, 30, 300, 3000):
        for share in (0.0, 0.3, 0.8, 1.0):
            a = [f"w{rng.random()}" for _ in range(n + 4)]
            b = a[: int(share * len(a))] + [f"v{rng.random()}" for _ in range(len(a) - int(share * len(a)))]
            s = [set(zip(*(x[i:] for i in range(5)))) for x in (a, b)]
            true = len(s[0] & s[1]) / len(s[0] | s[1])
            one, two = (sketch.fill([" ".join(x)], order) for x in (a, b))
            errors.append(abs(sketch.likeness(one, two)[0] - true) * (n >= 30))
    assert max(errors) < 0.15 and np.mean(errors) < 0.04


def test_neighbours(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice("ab cd ef gh é漢".split()) for _ in range(rng.randint(0, 60)))) for i in range(97)]
    rows[5] = (15, None)
    rows[6] = (18, "")
    rows[7] = (21, "x" * 100_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for parts in (1, 4, 40):
        got = {r.doc_id: r for r in fp.with_next(df, parts=parts).collect()}
        assert len(got) == 97
        for j, (i, t) in enumerate(rows):
            t, n = t or "", rows[(j + 1) % 97][1] or ""
            h = len(t) // 2
            assert got[i].n_chars == len(t)
            assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    assert all(got[i].fingerprint == plain[i] for i in plain)
    assert got[15].fingerprint == "" and 0 <= got[0].near_edited <= 1


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "q"), (1, "a b", "q"), (None, "c", "q"), (None, None, None)], "doc_id long, text string, fingerprint string")
    got = fp.with_next(df, parts=3).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 2
    assert fp.with_next(df.limit(0), parts=3).count() == 0
    (one,) = fp.with_next(df.filter("text = 'c'"), parts=3).collect()
    assert one.near_next == 1.0


def plain_fingerprint(sketch, text, order):
    """Bin by bin, or None without words."""
    (h,) = shingles([text], sketch.words)
    bins = {}
    for x in h.tolist():
        b = x >> (64 - sketch.bins.bit_length() + 1)
        bins[b] = min(x, bins.get(b, x))
    if not bins:
        return None
    return [bins[next(d for d in [b, *order[b].tolist()] if d in bins)] % (1 << sketch.bits) for b in range(sketch.bins)]


def plain_likeness(sketch, a, b):
    if a is None or b is None:
        return float(a is b)
    p = sum(x == y for x, y in zip(a, b, strict=True)) / sketch.bins
    return min(1.0, max(0.0, (p - 2.0**-sketch.bits) / (1 - 2.0**-sketch.bits)))


def test_query_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fp.op2_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    sketch = fp.Sketch()
    order, digits = sketch.order(), sketch.bits // 4
    packed = lambda f: "" if f is None else "".join(f"{x:0{digits}x}" for x in f)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        one, two, three = (plain_fingerprint(sketch, x, order) for x in (text, edited, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(one), packed(two))
        assert abs(r.near_edited - plain_likeness(sketch, one, two)) < 1e-12 and abs(r.near_next - plain_likeness(sketch, one, three)) < 1e-12


def test_an_id_of_many_rows_is_cut_up(spark):
    """Half of the rows have no id, a third one id: their runs are of even size, and each row has one neighbour."""
    text = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    rows = [(None, text(f"n{i}")) for i in range(600)] + [(7, text(f"s{i}")) for i in range(400)] + [(i, text(i)) for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    runs = fp.in_runs(df, 12)
    sizes = [r[1] for r in runs.filter("NOT halo").groupBy("run").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) < 2.5 * 1200 / 12
    kept = {(r[0], r[1]): r[2] for r in runs.filter("halo").groupBy("run", "t").agg({"text": "min"}).collect()}
    assert len({run for run, _ in kept}) == len(sizes)
    got = fp.with_next(df, parts=12).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    # each text is the next one of one other
    heads = {hashlib.sha256((a[:16] + b[:16]).encode()).hexdigest(): (a, b) for a in (t for _, t in rows) for b in (t for _, t in rows)}
    pairs = [heads[r.edited_sha256] for r in got]
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 1200
