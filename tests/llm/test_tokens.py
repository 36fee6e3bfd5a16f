import base64
import random

import pytest
from codelode.llm.tokens import TrieEncoder, token_counts, token_ids, vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return TrieEncoder(vocabulary())


@pytest.fixture(scope="module")
def reference(encoder):
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \t", "hello world", "a" * 3000, "don't we'll I'd", "<|endoftext|> plain", "日本語テキスト", "x" * 40 + "😀" * 9, "\x00\x07 ctrl", "tab\tand  two  blanks", "ÀÉÎ naïve ﬁ"]


def test_agrees_with_another_implementation(encoder, reference):
    rng = random.Random(4)
    alphabet = "abcdefgh  \n\tXYZ019_-.,;:'\"(){}éßж漢😀"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    assert encoder.encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_ids_decode_to_the_text(encoder, reference):
    assert [reference.decode(x) for x in encoder.encode(TEXTS)] == TEXTS


def test_null_and_empty_give_empty_lists_and_rows_stay(spark):
    rows = [(1, None), (2, ""), (3, "again"), (3, "again"), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as ids", "1 as tokens")
    out = token_ids(docs).collect()
    assert len(out) == 5 and [len(r["ids"]) for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"]))][:2] == [0, 0]
    assert {r["doc_id"]: r["tokens"] for r in token_counts(docs).collect()}[1] == 0
    assert token_ids(docs.limit(0)).count() == 0
