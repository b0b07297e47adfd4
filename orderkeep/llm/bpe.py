"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; each match is encoded on its own. The bytes of a match are mapped to
Latin-1 so that an Aho-Corasick automaton over the vocabulary finds every token that occurs in it. From the left, the
longest token that starts at a position is taken; a token is only taken next to its left neighbour if both stay as
they are when the bytes of the two are merged alone (adjacent-token compatibility, memoised). If no token fits, the
encoder goes back one token and tries the next shorter one; a position that failed once is never entered again, as a
prefix of the text has one valid encoding only. So the work is linear in the text and the ids are those of the merges.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are encoded one by one, so repeated
rows, ties and extra columns change nothing; an empty table gives an empty result. A null id column stays null.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderkeep.llm.common import Memo, Pieces, held, map_arrow, prepare, texts

def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a rank file's lines (base64, space, rank)."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, content.split(b"\n")))}


class Encoder:
    """Encodes and decodes by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.find = Pieces(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (r, len(t)))
        self.automaton.make_automaton()
        self.fits = Memo(self._fit)
        self.pieces = Memo(lambda piece: array("I", self.encode_piece(piece.encode("utf-8"))).tobytes())

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a short piece by the merges themselves: always the pair of lowest rank, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _fit(self, key: int) -> bool:
        left, right = (key >> 32) - 1, key & 0xFFFFFFFF
        pair = [right] if left < 0 else [left, right]
        return self.merged(b"".join(self.token[t] for t in pair)) == pair

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are merged together; left -1: whether right does alone."""
        return self.fits[(left + 1) << 32 | right]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # at each position, the tokens there, shortest first
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            begins[end - size + 1].append((rank, end + 1))
        left = [len(b) for b in begins]  # how many tokens at a position are still to be tried
        failed = bytearray(n + 1)
        out, at, pos = [], [], 0
        while pos < n:
            before = out[-1] if out else -1
            k, options = left[pos], begins[pos]
            while k:
                k -= 1
                rank, end = options[k]
                if not failed[end] and self.compatible(before, rank):
                    left[pos] = k
                    out.append(rank)
                    at.append(pos)
                    pos = end
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                failed[pos] = 1
                out.pop()
                pos = at.pop()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Vocabulary:
    """A rank file as the driver read it, sent once to each executor (its size is that of the file, some MB at most)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            content = f.read()
        self.pattern = pattern
        self.key = ("bpe", hashlib.sha1(content + pattern.encode()).hexdigest())
        self.content = spark.sparkContext.broadcast(content)

    def encoder(self) -> Encoder:
        return held(self.key, lambda: Encoder(read_ranks(self.content.value), self.pattern))

    def tokens(self) -> dict[int, bytes]:
        return held((*self.key, "tokens"), lambda: {r: t for t, r in read_ranks(self.content.value).items()})


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens long, ids binary of little-endian unsigned 32-bit integers), a row for each of df's."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = vocabulary.encoder().encode
        ids = [code(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    return map_arrow(rows, run, T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]), "bpe").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for, as binary column `to` (replaced if it exists); null ids: no bytes."""
    prepare(df.sparkSession)
    keep = [c for c in df.columns if c != to]
    rows = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token = vocabulary.tokens().__getitem__
        out = []
        for ids in batch.column(ids_col):
            held_ids = ids.as_buffer()
            out.append(b"".join(map(token, array("I", held_ids.to_pybytes()) if held_ids is not None else ())))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, to])

    return map_arrow(rows, run, schema, "bpe")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; sizes and digests of both."""
    import public_tokenizers

    from orderkeep.llm.common import table

    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids binary): the documents' ids, as little-endian unsigned 32-bit integers."""
    import public_tokenizers

    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    return encode(whole, vocabulary, id_col="row").select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids")
