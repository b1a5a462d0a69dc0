import random

import pytest
import tiktoken

from kmerdex.llm import bpe

from . import data


@pytest.fixture(scope="module")
def plain():
    ranks, pattern = bpe.load()
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(spark, plain):
    docs = data.documents(spark)
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r["text"] or ""
        assert list(r["ids"]) == plain.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_many_small_chunks(spark, plain):
    rnd = random.Random(3)
    parts = ["a", "b'll", " ", "  ", "\n", "9", "é", "'", "!", "the ", "\t　", "<|endoftext|>", "🙂", "'re", "\r\n", "123"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 900))) for _ in range(60)] + ["x" * 3000 + " y", " " * 700, "　\t" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in bpe.encode(df, chunk=100, overlap=20).collect():
        assert list(r["ids"]) == plain.encode_ordinary(texts[r["doc_id"]]), r["doc_id"]
