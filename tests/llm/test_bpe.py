"""Token ids against the public library, on the same vocabulary."""

import random
from pathlib import Path

import pytest

from termweave.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
FOLDER = str(Path(P.path("byte_bpe_50k.tiktoken")).parent)


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.read_ranks(file.read())


def test_equals_library_and_round_trips(ranks):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Encoder(ranks, P.PATTERN)
    draw = random.Random(7)
    letters = "abcdeéßüñ  \n\t日本語тест๑ก้หิं0123.,'\"-<|endoftext|>🙂"
    texts = ["", " ", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "naïve  cafés\r\n", "a" * 3000]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 200))) for _ in range(300)]
    for text in texts:
        ids = ours.ids(text)
        assert ids == theirs.encode_ordinary(text)
        assert bpe.decode(ids, ranks) == text


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "ab ab", None)], "doc_id bigint, text string, ids int")
    got = {r[0]: r[1] for r in bpe.token_ids(rows, "doc_id", "text", FOLDER).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) >= 2
    assert bpe.token_ids(rows.limit(0), "doc_id", "text", FOLDER).count() == 0
