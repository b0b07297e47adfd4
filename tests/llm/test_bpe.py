import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from orderkeep.llm import bpe
from orderkeep.llm.common import MEMO_CHARS, Memo, Pieces

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


def test_matches_tiktoken(ranks):
    own, ref = bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    cases = ["", " ", "a" * 3000, "ab" * 2000, "\n\n  \t x", "Größe éàü ñ 漢字仮名交じり文 🙂🙂", "don't we'll I'm", "<|endoftext|>", "1234567890" * 50]
    cases += ["".join(rng.choice("abcdeothnir é漢!1 \n") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    cases += ["".join(rng.choice("etaoinshrd") for _ in range(5000))]
    cases += [f"a{chr(c)}b {chr(c)}1" for c in rng.sample(range(0x110000), 5000) + list(range(0x3000)) if not 0xD800 <= c < 0xE000]
    for text in cases:
        ids = own.encode(text)
        assert list(memoryview(ids).cast("I")) == ref.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_table(spark):
    v = bpe.Vocabulary(spark, PATH, P.PATTERN)
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (2, None, "x"), (None, "", "y"), (3, "z" * 200_000, None)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, v), v).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens > 0, bytes(r.decoded).decode()) for r in rows) == sorted([(False, 1, True, "hello world"), (False, 2, False, ""), (False, 2, False, ""), (True, 0, False, ""), (False, 3, True, "z" * 200_000)])
    assert bpe.encode(df.limit(0), v).count() == 0


def test_query_against_tiktoken(spark, ranks):
    sf = "/root/testdata/sf0.001"
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(ref.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.op1_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pieces_by_both_modules():
    """Texts of common characters give what the regex module gives; a pattern with other classes is left to it."""
    find, rng = Pieces(P.PATTERN), random.Random(6)
    common = [chr(c) for c in Pieces.COMMON]
    assert find.few is not None and Pieces(r"\p{Lu}+|\w+|.").few is None and Pieces(r"[a-z]+|\s").few is None
    for n in range(6000):
        text = "".join(rng.choice(common if n % 3 else "ab cD 1²\n\t'sll\x1c\x85\xa0\u2003\u2019") for _ in range(rng.randint(0, 40)))
        assert not find.rare(text) and find(text) == find.any(text), repr(text)
    assert find("漢字 x²") == find.any("漢字 x²") and find.rare("漢")


def test_memo_keeps_what_is_asked_for_again():
    made = []
    memo = Memo(lambda x: made.append(x) or x.upper(), 3)
    for x in "abcabdaebfag":
        assert memo[x] == x.upper()
    assert made.count("a") == made.count("b") == 1 and len(memo) <= 3
    long = "x" * (MEMO_CHARS + 1)
    assert memo[long] == long.upper() and long not in memo
