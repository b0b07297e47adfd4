"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Each word shingle of a text is hashed once; the hash's top bits choose a bin and each bin keeps its smallest hash. An
empty bin copies the first bin that is not empty in an order of its own, the same for every text (optimal
densification: each empty bin draws on its own). Of each bin the low-order bits are stored, packed. The likeness of
two fingerprints is the share p of equal bins, corrected for chance: (p - 2**-bits) / (1 - 2**-bits), within 0 and 1.

Defined results: a null text is empty; a text without words has the empty fingerprint, whose likeness is 1 to itself
and 0 to any other; equal texts have equal fingerprints. Rows are handled one by one; an empty table gives an empty
result. Neighbours are by (id, hash of the text, text), null ids first; rows that agree in all are neighbours of each
other. A very long text is sketched whole, in a batch of its own. Other columns are ignored, whatever their names.

Rows are dealt into runs of ascending ids of about RUN_TEXT bytes each, one for each task; an id of many rows is cut up by
the hash of the text. Only rows that agree in id and text stay together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.llm.common import NULL_ID, Cuts, map_arrow, parts_of, prepare, table, texts
from orderkeep.llm.textkernel import shingles

#: Bytes of text of a run.
RUN_TEXT = 16 << 20


@dataclass(frozen=True)
class Sketch:
    """bins: a power of two; bits: low-order bits kept of each, 8 at most; words: of a shingle."""

    bins: int = 512
    bits: int = 4
    words: int = 5

    def order(self) -> np.ndarray:
        """For each bin the order in which it looks for another that is not empty."""
        rng = np.random.Generator(np.random.PCG64(self.bins))
        return rng.permuted(np.tile(np.arange(self.bins, dtype=np.int16), (self.bins, 1)), axis=1)

    def fill(self, items: Sequence[str], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bins' low-order bits, uint8 by text and bin; whether the text has a word)."""
        low = np.zeros((len(items), self.bins), np.uint8)
        full = np.zeros((len(items), self.bins), bool)
        shift, mask = np.uint64(64 - self.bins.bit_length() + 1), np.uint64((1 << self.bits) - 1)
        for d, h in enumerate(shingles(items, self.words)):
            if len(h):
                h = np.sort(h)
                at = (h >> shift).astype(np.int64)
                least = np.flatnonzero(np.diff(at, prepend=-1))
                low[d, at[least]] = h[least] & mask
                full[d, at[least]] = True
        some = full.any(axis=1)
        text, empty = np.nonzero(~full & some[:, None])
        step = 0
        while len(text):
            donor = order[empty, step]
            found = full[text, donor]
            low[text[found], empty[found]] = low[text[found], donor[found]]
            text, empty, step = text[~found], empty[~found], step + 1
        return low, some

    def pack(self, low: np.ndarray, some: np.ndarray) -> list[str]:
        shifts = np.arange(self.bits - 1, -1, -1, dtype=np.uint8)
        packed = np.packbits(((low[:, :, None] >> shifts) & 1).reshape(len(low), -1), axis=1)
        return [row.tobytes().hex() if s else "" for row, s in zip(packed, some, strict=True)]

    def likeness(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        chance = 2.0**-self.bits
        p = (a[0] == b[0]).mean(axis=1)
        out = np.clip((p - chance) / (1 - chance), 0, 1)
        return np.where(a[1] & b[1], out, (a[1] == b[1]).astype(float))


def fingerprints(df: DataFrame, sketch: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint string), a row for each of df's."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    order = sketch.order()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sketch.pack(*sketch.fill(texts(batch), order)), pa.string())], names=["id", "fingerprint"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def in_runs(df: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, halo, k, t, id, text): df dealt into runs that ascend by (k, t) (k: the id, null as the least; t: a hash of the
    text), a run in each partition, sorted, and after it, with halo set, the row that follows it; after the last run the
    first row. Only the runs' bounds and first rows come to the driver (parts numbers); the texts are shuffled once."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("t"), "id", "text")
    cuts = Cuts(rows.select("k"), parts)
    number = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False)

    def least(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, t = number(batch, "k"), number(batch, "t")
        order = np.lexsort((t, k))
        run = cuts.of(k, t)[order]
        first = order[np.unique(run, return_index=True)[1]]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(run).astype(np.int64)), pa.array(k[first]), pa.array(t[first])], names=["run", "k", "t"])

    # the hash is needed only where an id is cut
    keys = rows.select("k", "t" if len(cuts.many) else F.lit(0).cast("long").alias("t"))
    firsts = sorted((r.run, r.first.k, r.first.t) for r in map_arrow(keys, least, "run long, k long, t long").groupBy("run").agg(F.min(F.struct("k", "t")).alias("first")).collect())
    #: The key with which a run begins to the run before it, in a ring.
    before = {(k, t) if len(cuts.many) else k: firsts[i - 1][0] for i, (_, k, t) in enumerate(firsts)}
    names, by_hash = ["run", "halo", "k", "t", "id", "text"], bool(len(cuts.many))

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k, t = number(batch, "k"), number(batch, "t")
        columns = [batch.column(c) for c in ("k", "t", "id", "text")]
        yield pa.RecordBatch.from_arrays([pa.array(cuts.of(k, t).astype(np.int64)), pa.array(np.zeros(len(k), bool)), *columns], names=names)
        # the least of a batch's rows with such a key will do
        again: dict = {}
        for i, key in enumerate(zip(k.tolist(), t.tolist(), strict=True) if by_hash else k.tolist()):
            if key in before and ((j := again.get(key)) is None or (t[i], batch.column("text")[i].as_py() or "") < (t[j], batch.column("text")[j].as_py() or "")):
                again[key] = i
        if again:
            part = batch.take(pa.array(list(again.values())))
            yield pa.RecordBatch.from_arrays([pa.array([before[x] for x in again], pa.int64()), pa.array([True] * len(again)), *(part.column(c) for c in ("k", "t", "id", "text"))], names=names)

    dealt = map_arrow(rows, deal, "run long, halo boolean, k long, t long, id long, text string")
    return dealt.repartitionById(len(cuts), F.col("run").cast("int")).sortWithinPartitions("run", "halo", "k", "t", "text")


def with_next(df: DataFrame, sketch: Sketch = Sketch(), parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, and the likeness to that of an edited text (the last half of the code points gives way
    to the first as many of the next row) and to that of the next row: (id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next). parts: of about RUN_TEXT bytes unless given."""
    parts = parts or parts_of(df, RUN_TEXT, text_col)
    order = sketch.order()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, idle, own, text = None, False, None, ""  # the last row; idle: its run is over
        for batch in batches:
            ids, items, out = [], [], []
            for r, halo, i, t in zip(batch.column("run").to_pylist(), batch.column("halo").to_pylist(), batch.column("id").to_pylist(), texts(batch), strict=True):
                if run == r and not idle:
                    ids.append(own)
                    items.append(text)
                    out.append(t)
                if run != r or not halo:
                    idle = False
                if halo:
                    idle = True
                run, own, text = r, i, t
            if not ids:
                continue
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(items, out, strict=True)]
            # the next row of one is mostly the following one: texts are sketched once
            index: dict[int, int] = {}
            distinct = []
            for x in (*items, *out):
                if id(x) not in index:
                    index[id(x)] = len(distinct)
                    distinct.append(x)
            low, some = sketch.fill(distinct, order)
            a, b = [index[id(x)] for x in items], [index[id(x)] for x in out]
            mine, following, changed = (low[a], some[a]), (low[b], some[b]), sketch.fill(edited, order)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(sketch.pack(*mine), pa.string()),
                    pa.array(sketch.pack(*changed), pa.string()),
                    pa.array(sketch.likeness(mine, changed)),
                    pa.array(sketch.likeness(mine, following)),
                ],
                names=names,
            )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_runs(df, parts, id_col, text_col).mapInArrow(pairs, schema).withColumnRenamed("id", id_col)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_next(table(spark, sf_dir, "documents"))
