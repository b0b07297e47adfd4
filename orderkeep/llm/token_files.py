"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A data set is a folder. Part p has p.bin, the ids of its documents end to end as little-endian unsigned integers of 2
bytes (of 4 if the vocabulary has over 65,536 ids), and p.idx: MAGIC and the integer's size as a 64-bit integer, then for
each document the offset of its end in ids (64 bits, the highest set where the document has no id) and its id (64 bits).
Both are written as documents come and read by mapping, so neither side holds a part. manifest.json names the parts in
order with their number of documents and ids and their base, the number of ids in all parts before (prefix sums over
parts). Each document ends with the end id.

Documents are dealt to parts of about PART_TEXT bytes of text by bounds of the ids (an id of many rows is cut up by a
hash of the text), so that parts and documents ascend by id. A task writes its part under a name of its own; only parts
named by finished tasks enter the manifest, and what lost or repeated tasks left is deleted after that. The folder is
opened by pyarrow's file systems; on a local path files are memory-mapped, elsewhere read in ranges.

A tokenizer with byte-level pre-tokenization and no normalizer encodes each distinct piece of text once per memo; any
other encodes whole texts, and so are texts encoded that hold the string of an added token, which the library finds
first. Ids are those of the library's encode() with add_special_tokens=False, which only leaves out what a
post-processor adds.

Defined results: a null or empty text has the end id alone; a null id sorts first; rows of equal ids are ordered by a
hash of the text and then their ids' bytes, and repeated rows are documents of their own. A document's ids must fit a
binary value of Spark's (2**31 - 1 bytes at 4 bytes an id) to be handed on by read(); digests() has no such bound. An
empty table gives a data set without parts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.llm.common import NULL_ID, Cuts, Memo, Pieces, held, map_arrow, parts_of, prepare, table, texts
from orderkeep.session import cut, own_folder

MAGIC = b"OKTOKEN2"
#: An entry of an index.
ENTRY = np.dtype([("end", "<u8"), ("id", "<i8")])
NO_ID = 1 << 63
#: Bytes of text of a part.
PART_TEXT = 64 << 20
#: Pieces in a worker's memo; they are small.
MEMO_ENTRIES = 400_000
#: Ids that a reader hands on at once.
READ_IDS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Tokens:
    """A tokenizer whose ids() gives a text's ids, packed."""

    def __init__(self, content: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(content)
        split = told.get("pre_tokenizer") or {}
        self.by_piece = told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.find = Pieces(pattern)
        added = [regex.escape(t["content"]) for t in told.get("added_tokens") or () if t["content"]]
        self.added = regex.compile("|".join(added)).search if added else lambda text: None
        self.letters, self.pieces = byte_letters(), Memo(self.piece, MEMO_ENTRIES)

    def piece(self, text: str) -> bytes:
        letters = text.encode().decode("latin-1").translate(self.letters)
        return array("H" if self.type.itemsize == 2 else "I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text without added tokens; by pieces, their strings are ordinary text."""
        if self.by_piece:
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        return self.whole(text)

    def ids(self, text: str) -> bytes:
        """The ids that the library gives."""
        return self.whole(text) if self.added(text) else self.encode(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_part(fs: pafs.FileSystem, path: str, kind: np.dtype, rows: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write path.bin and path.idx as rows come; the number of documents and of ids."""
    docs = end = 0
    with fs.open_output_stream(f"{path}.bin") as out, fs.open_output_stream(f"{path}.idx") as index:
        index.write(MAGIC + np.array([kind.itemsize], "<u8").tobytes())
        for i, packed in rows:
            out.write(packed)
            docs, end = docs + 1, end + len(packed) // kind.itemsize
            index.write(np.array([(end | NO_ID if i is None else end, i or 0)], ENTRY).tobytes())
    return docs, end


class _Mapped:
    """A file's bytes, mapped where it is local, else read range by range."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path = fs, path
        self.local = isinstance(fs, pafs.LocalFileSystem)
        self.size = os.path.getsize(path) if self.local else fs.get_file_info(path).size
        self.mapped = np.memmap(path, np.uint8, "r") if self.local and self.size else None

    def bytes(self, first: int, after: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[first:after]
        if first >= after:
            return np.zeros(0, np.uint8)
        with self.fs.open_input_file(self.path) as f:
            f.seek(first)
            return np.frombuffer(f.read(after - first), np.uint8)


class Part:
    """A part for reading: its documents' ids, offsets and packed ids, by slices of the mapped files."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.ids_file, self.index = _Mapped(fs, f"{path}.bin"), _Mapped(fs, f"{path}.idx")
        head = self.index.bytes(0, 16).tobytes()
        if head[:8] != MAGIC or (self.index.size - 16) % ENTRY.itemsize:
            raise ValueError(f"{path}.idx isn't an index")
        self.type = np.dtype(f"<u{int.from_bytes(head[8:], 'little')}")
        self.docs = (self.index.size - 16) // ENTRY.itemsize
        if self.ids_file.size != (self.ends(self.docs - 1, self.docs)[1][-1] if self.docs else 0) * self.type.itemsize:
            raise ValueError(f"{path}.bin has another size than its index says")

    def ends(self, first: int, after: int) -> tuple[list[int | None], np.ndarray]:
        """(document ids, ends) of documents first to after - 1."""
        entries = np.ascontiguousarray(self.index.bytes(16 + first * ENTRY.itemsize, 16 + after * ENTRY.itemsize)).view(ENTRY)
        none = entries["end"] >= NO_ID
        return [None if x else i for i, x in zip(entries["id"].tolist(), none.tolist(), strict=True)], (entries["end"] & np.uint64(NO_ID - 1)).astype(np.int64)

    def ids(self, first: int, after: int) -> np.ndarray:
        """The ids from offset first to after - 1."""
        size = self.type.itemsize
        return np.ascontiguousarray(self.ids_file.bytes(first * size, after * size)).view(self.type)

    def runs(self, most: int = READ_IDS, docs: int = 4096) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """(document ids, offsets: one more than documents, packed ids) for runs of documents of about `most` ids."""
        at = begin = 0
        while at < self.docs:
            known, ends = self.ends(at, min(self.docs, at + docs))
            a = 0
            while a < len(known):
                b = max(a + 1, int(np.searchsorted(ends, begin + most, side="right")))
                yield known[a:b], np.concatenate(([begin], ends[a:b])), self.ids(begin, int(ends[b - 1]))
                a, begin = b, int(ends[b - 1])
            at += len(known)


def write(df: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write df's documents as a data set; its manifest. The driver gets bounds of the ids and a row for each part; parts:
    of about PART_TEXT bytes of text unless given."""
    spark = df.sparkSession
    prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    key, shared = ("tokens", hashlib.sha1((content + pattern).encode()).hexdigest()), spark.sparkContext.broadcast(content)
    tokens = lambda: held(key, lambda: Tokens(shared.value, pattern))
    kind = Tokens(content, pattern).type
    end = np.array([end_id], kind).tobytes()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("t"), "id", "text")
    cuts = Cuts(rows.select("k"), parts or parts_of(rows, PART_TEXT))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = tokens().ids
        part = cuts.of(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t")))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(batch.column(c) for c in ("k", "t", "id")), pa.array([code(t) + end for t in texts(batch)], pa.binary())], names=["part", "k", "t", "id", "ids"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, top = _folder(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        each = ((i, x) for b in batches for i, x in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), strict=True))
        first = next(each, None)
        if first is None:
            return
        fs.create_dir(top, recursive=True)
        docs, ids = write_part(fs, f"{top}/{name}", kind, (x for many in ((first,), each) for x in many))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), name, docs, ids)], names=["part", "name", "docs", "ids"])

    dealt = map_arrow(rows, encode, "part int, k long, t long, id long, ids binary", "tokens").repartitionById(len(cuts), F.col("part")).sortWithinPartitions("k", "t", "ids")
    done = cut(dealt.select("id", "ids").mapInArrow(put, "part long, name string, docs long, ids long")).orderBy("part").collect()
    base = np.concatenate(([0], np.cumsum([r.ids for r in done], dtype=np.int64))).tolist()
    manifest = [{"name": r.name, "docs": r.docs, "ids": r.ids, "base": b} for r, b in zip(done, base, strict=False)]
    fs, top = _folder(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    named = {f"{p['name']}.{x}" for p in manifest for x in ("bin", "idx")}
    for f in fs.get_file_info(pafs.FileSelector(top)):
        if f.base_name.startswith("part-") and f.base_name not in named:
            fs.delete_file(f.path)
    return manifest


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    fs, top = _folder(folder)
    with fs.open_input_file(f"{top}/manifest.json") as f:
        manifest = json.loads(f.read())
    return spark.createDataFrame([(p["name"], p["base"]) for p in manifest], "name string, base long").repartition(max(1, len(manifest)))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids binary of little-endian unsigned 32-bit integers) of a data set's documents; start: the ids of all before."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fs, top = _folder(folder)
        for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
            for known, off, ids in Part(fs, f"{top}/{name}").runs():
                if 4 * len(ids) >= 1 << 31:
                    raise ValueError(f"a document of {folder} has too many ids for one value")
                at = ((off - off[0]) * 4).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(off[:-1] + base), pa.array(np.diff(off)), packed], names=["id", "start", "n_tokens", "ids"])

    return map_arrow(_parts(spark, folder), run, "id long, start long, n_tokens long, ids binary")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 long) of a data set's documents; the crc32 is that of read()'s ids."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fs, top = _folder(folder)
        for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
            part = Part(fs, f"{top}/{name}")
            for known, off, ids in part.runs():
                crc = []
                for a, b in pairwise((off - off[0]).tolist()):
                    c = 0
                    for x in range(a, b, READ_IDS):  # a long document bit by bit
                        c = zlib.crc32(ids[x : min(b, x + READ_IDS)].astype("<u4").tobytes(), c)
                    crc.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(_parts(spark, folder), run, "id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids into the shared folder and read them back."""
    import public_tokenizers

    folder = own_folder(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return digests(spark, folder).withColumnRenamed("id", "doc_id")
