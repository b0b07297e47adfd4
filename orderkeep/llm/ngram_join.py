"""N-gram Jaccard join with vertical partitioning.

A text's set are the hashes (HASH_BITS) of its distinct word n-grams; texts with equal sets are one vertex. The global
order of n-grams (by number of sets, then by hash) is cut vertically twice.

First, to find candidates: hash ranges are fragments, each a Spark partition that counts on its own in how many sets its
n-grams occur and sends those of two sets or more on to their vertices; all others can't overlap. N-grams that are
frequent in a sample of texts come last in the order and go to their vertices at once, so that none is gathered in one
fragment; which ones these are changes no result, as any order that all sets share gives the same links. Two sets whose
Jaccard similarity reaches the threshold share an n-gram among the first n - ceil(threshold * n) + 1 of each; n-grams of
one set take the first of these places, and a vertex all of whose places they take is linked with nothing. Vertices that
share such a prefix n-gram, directly or through others, form a cell; links never leave a cell.

Second, to count: of each cell the n-grams' order is cut into fragments of about SEGMENT_NGRAMS and its vertices into
blocks of BLOCK_ROWS. For each two blocks and each fragment one group of segments gives the partial overlaps of all
their pairs; the partial overlaps of the fragments are then summed per pair (a matrix for each two blocks, added up as
rows stream in), and the exact sizes decide. Of two blocks' links a spanning forest leaves the task, so no group is
expanded into its pairs, and none is capped: each pair of a cell is counted.

Defined results: A-Z is lower-cased; with fewer words than n the whole sequence is the one n-gram; a text without words
or null has an empty set, is linked with nothing and is its own component. Repeated rows have equal sets. A null id gets
the smallest other id of its component, null if there is none. An empty table gives an empty result. Other columns are
ignored, whatever their names; a very long text is one set, cut into segments as any other. N-grams are told apart by 62
bits and sets by 64: two of n different ones share a hash with a chance near n * n / 2**63 and n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.llm.common import held, lean, prepare, table, texts
from orderkeep.llm.components import components
from orderkeep.llm.textkernel import shingles
from orderkeep.session import cut

#: Bits of an n-gram's hash: a fragment's number and OFFSET bytes for the place in its range.
HASH_BITS, OFFSET = 62, 7
#: Bytes of text for each fragment of the n-gram universe (their number is a power of two); bounds a task's memory.
FRAGMENT_TEXT = 8 << 20
MIN_FRAGMENTS = 1 << (HASH_BITS - 8 * OFFSET)
#: N-gram hashes that a map task holds before it sends them on.
FLUSH = 1 << 19
#: Bytes of the sample of texts that tells frequent n-grams; those of 1 / FREQUENT of its texts, and of MIN_TIMES at least,
#: count as frequent. So there are at most SAMPLE_TEXT / (2 * MIN_TIMES) of them, 16 MB.
SAMPLE_TEXT, FREQUENT, MIN_TIMES = 64 << 20, 200, 16
#: Vertices of a block, n-grams of a group of segments, columns of an incidence matrix.
BLOCK_ROWS, SEGMENT_NGRAMS, COLUMNS = 128, 1 << 14, 2048
#: The number of sets that frequent n-grams are taken to occur in.
MANY = 1 << 30

#: Up to so many ids are broadcast; more are joined by a shuffle.
MAX_SMALL = 500_000

# Rows by kind. 0, members: ids, vs (their vertices), ns (their sets' sizes). 1, n-grams of a fragment: vs, ns (how many of
# each vertex), keys, and once counted dfs. 2, vertices: vs, ns (sizes), dfs (how many frequent n-grams each), keys.
_WIRE = "part int, kind int, ids array<long>, vs binary, ns binary, keys binary, dfs binary"
_NAMES = [x.split()[0] for x in _WIRE.split(", ")]


def _wire(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _pack(offsets: np.ndarray) -> bytes:
    """The low OFFSET bytes of each."""
    return offsets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :OFFSET].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // OFFSET, 8), np.uint8)
    out[:, :OFFSET] = np.frombuffer(packed, np.uint8).reshape(-1, OFFSET)
    return out.view("<u8").ravel()


def _by_part(part: np.ndarray, owner: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with a part and an owner each: for each part (part, its rows by owner, the owners that have some, how many each)."""
    order = np.lexsort((owner, part))
    edge = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        rows = order[a:b]
        n = np.bincount(owner[rows], minlength=owners)
        some = np.flatnonzero(n)
        yield int(part[rows[0]]), rows, some, n[some]


def _grams(items: list[str], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(vertex, sorted n-gram hashes) of each text."""
    for h in shingles(items, words):
        h = np.unique(h >> np.uint64(64 - HASH_BITS))
        yield xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63), h


def _bytes(n: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts n of owners as bytes: an owner of more than 255 is repeated."""
    times = -(-n // 255)
    last = np.cumsum(times) - 1
    out = np.full(int(times.sum()), 255, np.uint8)
    out[last] = n - 255 * (times - 1)
    return out, np.repeat(owners, times)


def _sets(bits: int, words: int, frequent: Callable[[], np.ndarray]):
    """Texts to wire rows of all kinds; n-grams by fragment, 2**bits of them."""
    parts, shift = 1 << bits, np.uint64(HASH_BITS - bits)

    def flush(ids: list, vs: list[int], hs: list[np.ndarray], turn: int) -> Iterator[tuple]:
        v, n = np.array(vs, np.int64), np.array([len(h) for h in hs], np.int64)
        yield (turn % parts, 0, ids, v.tobytes(), n.tobytes(), None, None)
        once = np.unique(v, return_index=True)[1]
        own = np.repeat(np.arange(len(once)), n[once])
        h = np.concatenate([hs[i] for i in once]) if len(once) else np.zeros(0, np.uint64)
        known = frequent()
        often = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
        yield (turn % parts, 2, None, v[once].tobytes(), n[once].tobytes(), h[often].tobytes(), np.bincount(own[often], minlength=len(once)).astype("<i4").tobytes())
        own, h = own[~often], h[~often]
        for part, rows, some, count in _by_part((h >> shift).astype(np.int64), own, len(once)):
            count, some = _bytes(count, some)
            yield (part, 1, None, v[once[some]].tobytes(), count.tobytes(), _pack(h[rows]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, hs, size, turn = [], [], [], 0, 0
        for batch in batches:
            for i, (v, h) in zip(batch.column("id").to_pylist(), _grams(texts(batch), words), strict=True):
                turn = turn or (i or 0)
                ids.append(i)
                vs.append(v)
                hs.append(h)
                size += len(h) + 1
                if size >= FLUSH:
                    yield _wire(list(flush(ids, vs, hs, turn)))
                    ids, vs, hs, size, turn = [], [], [], 0, turn + 1
        if ids:
            yield _wire(list(flush(ids, vs, hs, turn)))

    return run


def _often(words: int):
    """Texts to (h, times) of the n-grams that occur in two sets or more of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            sets.update(_grams(texts(batch), words))
        if sets:
            h, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            few = times > 1
            yield pa.RecordBatch.from_arrays([pa.array(h[few].astype(np.int64)), pa.array(times[few].astype(np.int64))], names=["h", "times"])

    return run


def frequent_ngrams(rows: DataFrame, words: int, size: int, count: int) -> np.ndarray:
    """Sorted hashes of n-grams that are frequent in a sample of rows (of `size` bytes of text in all)."""
    share = min(1.0, SAMPLE_TEXT / max(size, 1))
    least = max(MIN_TIMES, int(count * share) // FREQUENT)
    found = rows.select("text").sample(share, 7).mapInArrow(lean(_often(words)), "h long, times long")
    often = found.groupBy("h").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).select("h").collect()
    return np.sort(np.array([r[0] for r in often], np.int64)).astype(np.uint64)


def _count(bits: int):
    """A fragment's rows to wire rows by vertex: only n-grams that occur in two sets or more, with how many. Members stay
    where they are, so that a set of many texts is gathered nowhere."""
    parts, shift = 1 << bits, np.uint64(HASH_BITS - bits)
    mask = np.uint64((1 << (HASH_BITS - bits)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        whole: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            passed = []
            for part, kind, *row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                if kind == 0:
                    passed.append((part, kind, *row))
                elif kind == 1:
                    found.setdefault(part, []).append(tuple(row[1:]))
                else:
                    whole.update(_vertex_rows(row[1:]))
            if passed:
                yield _wire(passed)
        if whole:
            v = np.array(list(whole), np.int64)
            out = []
            for part, at, _, _ in _by_part(v % parts, np.zeros(len(v), np.int64), 1):
                own = [whole[x] for x in v[at].tolist()]
                out.append((part, 2, None, v[at].tobytes(), np.array([n for n, _ in own], np.int64).tobytes(), b"".join(h for _, h in own), np.array([len(h) // 8 for _, h in own], "<i4").tobytes()))
            yield _wire(out)
        for fragment, rows in found.items():
            v = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
            n = np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows]).astype(np.int64)
            sent = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            h = _unpack(b"".join(r[2] for r in rows)) & mask | np.uint64(fragment) << shift
            rows.clear()
            own = np.repeat(np.arange(len(v), dtype=np.int32), n)
            _, at, inverse = np.unique(v, return_index=True, return_inverse=True)
            first = sent == sent[at][inverse]  # another task may have sent the same set
            if not first.all():
                own, h = own[first[own]], h[first[own]]
            # runs of equal n-grams, of which those of one are left out
            order = np.argsort(h)
            h, own = h[order], own[order]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            times = np.diff(edge)
            keep = np.repeat(times > 1, times)
            own, h, df = own[keep], h[keep], np.repeat(times[times > 1], times[times > 1]).astype(np.int32)
            order = np.argsort(own, kind="stable")
            own, h, df = own[order], h[order], df[order]
            out = []
            for part, at, some, count in _by_part(v[own] % parts, own, len(v)):
                out.append((part, 1, None, v[some].tobytes(), count.astype("<i4").tobytes(), h[at].astype("<u8").tobytes(), df[at].astype("<i4").tobytes()))
            if out:
                yield _wire(out)

    return run


def _vertex_rows(row: list[bytes]) -> Iterator[tuple[int, tuple[int, bytes]]]:
    """(vertex, (size, its frequent n-grams)) of a wire row of kind 2 without its first columns."""
    vs, ns, keys, counts = row
    at = 0
    for v, n, k in zip(np.frombuffer(vs, np.int64).tolist(), np.frombuffer(ns, np.int64).tolist(), np.frombuffer(counts, "<i4").tolist(), strict=True):
        yield v, (n, keys[at : at + 8 * k])
        at += 8 * k


_VERTEX = "id long, v long, n long, prefix array<long>, shared binary"


def _assemble(percent: int):
    """Wire rows by vertex to members (prefix null) and the vertices that may have links (id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, tuple[int, bytes]] = {}
        found = []
        for batch in batches:
            for _, kind, ids, *row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                if kind == 0:
                    v, n = (np.frombuffer(x, np.int64) for x in row[:2])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(v), pa.array(n), pa.nulls(len(v), pa.list_(pa.int64())), pa.nulls(len(v), pa.binary())], names=["id", "v", "n", "prefix", "shared"])
                elif kind == 1:
                    found.append(row)
                else:
                    whole.update(_vertex_rows(row))
        often = {v: h for v, (_, h) in whole.items() if h}
        if not found and not often:
            return
        v = np.concatenate([*(np.repeat(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], "<i4")) for r in found), np.repeat(np.array(list(often), np.int64), [len(h) // 8 for h in often.values()])])
        key = np.concatenate([*(np.frombuffer(r[2], "<u8") for r in found), np.frombuffer(b"".join(often.values()), "<u8")])
        df = np.concatenate([*(np.frombuffer(r[3], "<i4") for r in found), np.full(sum(map(len, often.values())) // 8, MANY, np.int32)])
        order = np.lexsort((key, df, v))
        v, key = v[order], key[order]
        edge = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1], [True])))
        out: list[tuple] = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n = whole[int(v[a])][0]
            places = n - -(-percent * n // 100) + 1 - (n - (b - a))  # those that n-grams of one set leave
            if places > 0:
                out.append((None, int(v[a]), n, key[a : a + places].astype(np.int64), np.sort(key[a:b]).tobytes()))
                if len(out) == 500:
                    yield _vertices(out)
                    out = []
        if out:
            yield _vertices(out)

    return run


def _vertices(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "v", "n", "prefix", "shared"])


_SEGMENT = "root long, x int, y int, g int, side int, v long, n long, part binary"


def _segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Vertices of cells (root, v, n, shared, blocks, own, fragments) to their segments, for each other block and fragment.
    A vertex without n-grams in a fragment has an empty segment, so that all fragments of two blocks have the same rows."""
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.binary()]
    out, size = [], 0
    for root, v, n, shared, blocks, own, fragments in zip(*(batch.column(c).to_pylist() for c in ("root", "v", "n", "shared", "blocks", "own", "fragments")), strict=True):
        keys = np.frombuffer(shared, "<u8")
        ends = np.searchsorted(keys, np.array([-(-((k + 1) << HASH_BITS) // fragments) for k in range(fragments)], np.uint64)).tolist()
        for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            part = shared[8 * a : 8 * b]
            for other in range(blocks):
                out.append((root, min(own, other), max(own, other), g, int(own > other), v, n, part))
                size += len(part) + 60
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None, columns: int = COLUMNS) -> np.ndarray:
    """The overlap of each of left with each of right (left itself if none) as integers."""
    sets = [*left, *(right or ())]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[col] > 1
    rows, col = rows[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    k = len(left)
    out = np.zeros((k, len(right) if right else k), np.int64)
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(col, (begin, begin + columns))
        part = np.zeros((len(sets), min(columns, int(number[-1]) + 1 - begin)), np.float32)
        part[rows[a:b], col[a:b] - begin] = 1
        out += (part[:k] @ (part[k:] if right else part).T).astype(np.int64)
    if right is None:
        out[np.arange(k), np.arange(k)] = [len(s) for s in left]
    return out


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come ordered by `by`, group by group."""
    key, rows = None, []
    for batch in batches:
        for k, row in zip(zip(*(batch.column(c).to_pylist() for c in by), strict=True), zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield key, rows


_PARTIAL = "root long, x int, y int, g int, left binary, right binary, sizes binary, counts binary"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments ordered by group to the partial overlaps of a group's pairs, a matrix of two blocks' vertices."""
    names = [x.split()[0] for x in _PARTIAL.split(", ")]
    for (root, x, y, g), rows in _groups(batches, ("root", "x", "y", "g"), ("side", "v", "n", "part")):
        sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
        sets = [[np.frombuffer(r[3], "<u8") for r in side] for side in sides]
        both = overlaps(sets[0], sets[1] or None)
        v = [np.array([r[1] for r in side], np.int64).tobytes() for side in sides]
        n = np.array([r[2] for side in sides for r in side], np.int64).tobytes()
        packed = both.astype("<u2" if both.max(initial=0) < 1 << 16 else "<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((root, x, y, g, *v, n, packed), [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 4], strict=True)], names=names)


def _sum(percent: int):
    """Partial overlaps ordered by two blocks: summed per pair; of the pairs that reach the threshold a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, known = None, None, ()
        for batch in batches:
            a, b = [], []
            for root, x, y, left, right, sizes, counts in zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y", "left", "right", "sizes", "counts")), strict=True):
                if (root, x, y) != key:
                    if key is not None:
                        _links(*known, total, percent, a, b)
                    key, known = (root, x, y), (left, right, sizes)
                    total = 0
                i, j = len(left) // 8, (len(right) or len(left)) // 8
                total = total + np.frombuffer(counts, "<u2" if len(counts) == 2 * i * j else "<u4").reshape(i, j).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if key is not None:
            a, b = [], []
            _links(*known, total, percent, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(left: bytes, right: bytes, sizes: bytes, total: np.ndarray, percent: int, a: list[int], b: list[int]) -> None:
    """Append the ends of a spanning forest of the linked vertices of two blocks (of one with itself without right)."""
    v, n = np.frombuffer(left + right, np.int64).tolist(), np.frombuffer(sizes, np.int64)
    k = len(left) // 8
    linked = np.zeros((len(v), len(v)), bool)
    part = 100 * total >= percent * (n[:k, None] + (n[None, k:] if right else n[None, :]) - total)
    if right:
        linked[:k, k:] = part
        linked[k:, :k] = part.T
    else:
        linked[:] = part
        np.fill_diagonal(linked, False)
    for i, j in _forest(linked):
        a.append(v[i])
        b.append(v[j])


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest."""
    out, free = [], linked.any(axis=1)
    while free.any():
        root = int(free.argmax())
        free[root] = False
        front = np.array([root])
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & free)
            out.extend((root, int(x)) for x in new)
            free[new] = False
            front = new
    return out


def links(cells: DataFrame, percent: int, block_rows: int, segment_ngrams: int) -> DataFrame:
    """(a, b): a spanning forest of the links within cells (checkpointed: root, v, n, shared: sorted n-grams, 8 bytes each)."""
    sizes = cells.groupBy("root").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.sum(F.octet_length("shared") / 8).alias("ngrams"))
    # two blocks' n-grams, on average, in groups of segment_ngrams
    pair = F.when(F.col("blocks") == 1, F.col("ngrams")).otherwise(2 * F.col("ngrams") / F.col("blocks"))
    sizes = sizes.select("root", "blocks", F.ceil(pair / segment_ngrams).cast("int").alias("fragments"))
    large = cut(sizes.filter("blocks > 1 OR fragments > 1"))
    known = cells.join(F.broadcast(large) if large.count() <= MAX_SMALL else large, "root", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "fragments": F.greatest(F.coalesce("fragments", F.lit(1)), F.lit(1))})
    dealt = known.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _segments(batch)

    group = ["root", "x", "y", "g"]
    parted = dealt.mapInArrow(run, _SEGMENT).repartition(*group).sortWithinPartitions(*group, "side", "v")
    partial = parted.mapInArrow(lean(_partial), _PARTIAL).repartition(*group[:3]).sortWithinPartitions(*group)
    return cut(partial.mapInArrow(lean(_sum(percent)), "a long, b long"))


def near_groups(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each of df's: texts link from `percent` hundredths of Jaccard similarity on."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = (max(MIN_FRAGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // FRAGMENT_TEXT)) - 1).bit_length()
    often = frequent_ngrams(rows, words, size or 0, count)
    shared, key = spark.sparkContext.broadcast(often.tobytes()), ("frequent", xxhash.xxh3_64_hexdigest(often.tobytes()))
    frequent = lambda: held(key, lambda: np.frombuffer(shared.value, np.uint64))
    dealt = lambda d: d.repartitionById(1 << bits, F.col("part"))
    sets = dealt(rows.mapInArrow(lean(_sets(bits, words, frequent)), _WIRE))
    counted = dealt(sets.mapInArrow(lean(_count(bits)), _WIRE))
    whole = cut(counted.mapInArrow(lean(_assemble(percent)), _VERTEX))
    members, vertices = whole.filter("prefix IS NULL").select("id", "v", "n"), whole.filter("prefix IS NOT NULL")

    posted = vertices.select("v", F.explode("prefix").alias("key"))
    first = cut(posted.groupBy("key").agg(F.min("v").alias("m"), F.count("*").alias("times")).filter("times > 1").select("key", "m"))
    cells = components(posted.join(first, "key").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")))
    found = links(cut(vertices.select("v", "n", "shared").join(cut(cells), "v")), percent, BLOCK_ROWS, SEGMENT_NGRAMS)
    roots = components(found).withColumnRenamed("root", "g")
    # one row for each set, then for each component; checkpointed, so that each join below has plain rows on both sides
    # and Spark can split the rows of a large group
    least = cut(members.filter("n > 0").groupBy("v").agg(F.min("id").alias("least")).join(roots, "v", "left").withColumn("g", F.coalesce("g", "v")))
    groups = cut(least.groupBy("g").agg(F.min("least").alias("component_id")))
    labels = cut(least.join(groups, "g").select("v", "component_id"))
    # sets of no n-gram stay alone
    out = members.join(labels, "v", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the smallest id. A document without id goes by its text; rows that repeat a
    document's id and text are one. Of rows that share an id one stays for each component."""
    key = F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text"))
    keyed = docs.withColumn("__key", key)
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # only then rows must be told apart by their texts
        keyed = keyed.withColumn("__row", F.xxhash64("__key", "text"))
        found = cut(near_groups(keyed, id_col="__row").select("__row", "component_id").distinct())
        known = cut(keyed.select("__row", "__key").distinct())
        least = found.join(known, "__row").groupBy("component_id").agg(F.min(F.struct("__key", "__row")).alias("least"))
        kept = cut(least.select("least.__row"))
        return keyed.join(kept, "__row", "left_semi").dropDuplicates(["__key", "text"]).select(*docs.columns)
    found = cut(near_groups(keyed, id_col="__key"))
    lost = cut(found.filter("__key <> component_id").select("__key").distinct())
    return keyed.join(F.broadcast(lost) if lost.count() <= MAX_SMALL else lost, "__key", "left_anti").select(*docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate components of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id FROM w JOIN reach r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY ALL"""
