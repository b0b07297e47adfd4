import random
import sys
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from orderkeep.llm import token_files as F

PATH = P.path("byte_bpe_50k.json")


def test_pieces_match_the_library():
    own, ref = F.Tokens(open(PATH).read(), P.PATTERN), Tokenizer.from_file(PATH)
    ref.encode_special_tokens = True
    rng = random.Random(1)
    odd = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or chr(c).isnumeric() or 0x1C <= c < 0xA1 or 0x2000 <= c < 0x2070)]
    cases = ["", "<|endoftext|> x", "don't  we'll\n\nI'm", "a" * 3000, "".join(map(chr, range(1, 3000)))]
    cases += ["".join(rng.choice(odd if rng.random() < 0.4 else list("ab cé漢1'st ! ")) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in cases:
        assert np.frombuffer(own.encode(text), own.type).tolist() == ref.encode(text, add_special_tokens=False).ids, repr(text)
    whole = F.Tokens(open(P.path("word_bpe_49k.json")).read(), P.PATTERN)
    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert not whole.by_piece and np.frombuffer(whole.encode("Hello there"), whole.type).tolist() == ref.encode("Hello there", add_special_tokens=False).ids


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 5, " ".join(rng.choice("the sea Größe 漢字 x1".split()) for _ in range(rng.randint(0, 50)))) for i in range(300)]
    rows += [(7, None), (8, ""), (9, "y" * 200_000), (None, "null id"), rows[3], rows[3], (15, "other text")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string").repartition(6)
    ref = Tokenizer.from_file(PATH)
    own = sorted(((i is not None, i or 0, np.array(ref.encode(t or "").ids + [0], "<u2").tobytes()) for i, t in rows))
    by_id = lambda found: [x[:2] for x in found]
    for parts in (1, 9):
        folder = f"file://{tmp_path}/t{parts}"
        manifest = F.write(df, folder, PATH, P.PATTERN, parts=parts)
        assert sum(p["docs"] for p in manifest) == len(rows) and (len(manifest) == 1) == (parts == 1)
        got = sorted(F.read(spark, folder).collect(), key=lambda r: r.start)
        start = 0
        for r in got:
            ids = np.frombuffer(bytes(r.ids), "<u4")
            assert (r.start, r.n_tokens) == (start, len(ids))
            start += len(ids)
        told = [(r.id is not None, r.id or 0, np.frombuffer(bytes(r.ids), "<u4").astype("<u2").tobytes()) for r in got]
        assert by_id(told) == by_id(own) and sorted(told) == own  # rows of equal ids come in an order of their own
        crc = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in F.digests(spark, folder).collect())
        assert crc == [(r.start, r.id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got]
        names = {p["name"] for p in manifest}
        assert {x.name.rpartition(".")[0] for x in (tmp_path / f"t{parts}").iterdir() if x.name.startswith("part-")} == names
    assert F.write(df.limit(0), f"file://{tmp_path}/none", PATH, P.PATTERN) == []
    assert F.read(spark, f"file://{tmp_path}/none").count() == 0


def test_query_against_the_library(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    ref, rows, start = Tokenizer.from_file(PATH), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), 0
    want = []
    for i, t in sorted((r.doc_id, r.text or "") for r in rows):
        ids = np.array(ref.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for size in (F.PART_TEXT, 10_000):  # few and many parts
        monkeypatch.setattr(F, "PART_TEXT", size)
        got = F.op7_token_files(spark, sf)
        assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_long_parts_come_in_runs(tmp_path):
    from pyarrow import fs

    docs = [(None if i % 50 == 0 else i, np.arange(i % 7 * 100, dtype="<u2").tobytes()) for i in range(9000)]
    assert F.write_part(fs.LocalFileSystem(), f"{tmp_path}/p", np.dtype("<u2"), iter(docs)) == (9000, sum(len(x) // 2 for _, x in docs))
    part, back = F.Part(fs.LocalFileSystem(), f"{tmp_path}/p"), []
    for known, off, ids in part.runs(most=1000, docs=100):
        back += [(i, ids[a - off[0] : b - off[0]].tobytes()) for i, a, b in zip(known, off[:-1], off[1:], strict=True)]
    assert back == docs


def test_added_tokens_are_found_as_the_library_does(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "no such string", "é<|endoftext|>" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ref = Tokenizer.from_file(P.path(name))
        F.write(df, f"file://{tmp_path}/{name}", P.path(name), P.PATTERN, parts=2)
        got = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in F.read(spark, f"file://{tmp_path}/{name}").collect()}
        assert got == {i: ref.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert got[1] != got[3]
