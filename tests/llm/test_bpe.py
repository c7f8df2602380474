import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from tabveil.llm.bpe import Encoder, Vocabulary, decode, encode, read_ranks

RANKS = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_on_odd_texts():
    rng = random.Random(1)
    texts = ["", " ", "\n\n a", "it's we'll I'D", "a" * 3000, "ab" * 2000 + "aab" * 500, "é" * 700, "1234567890" * 50, " \x1c\x1d\x85 x", "<|endoftext|> ok", "😀👍🏽 — ß", "=" * 600 + "-" * 77]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x10000, 0x1FFFF), 32, 10])) for _ in range(400)) for _ in range(60)]
    texts += ["".join(rng.choice("thewyonabd") for _ in range(rng.randrange(1, 900))) for _ in range(80)]
    own = []
    for flat, lengths in Encoder(Vocabulary(RANKS), public_tokenizers.PATTERN).encode(texts, 20_000):
        own += [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
    assert own == [library().encode_ordinary(t) for t in texts]


def test_round_trip_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = library()
    for r in decode(encode(docs.withColumn("raw", docs.text), RANKS, public_tokenizers.PATTERN), RANKS).collect():
        assert r.ids == lib.encode_ordinary(r.raw) and r.decoded == r.raw.encode()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5, "d"), (2, "", None, None), (2, "a b", 1, "x"), (2, "a b", 1, "x"), (None, "a", 0, "y")], "doc_id long, text string, ids int, decoded string")
    out = decode(encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert [bytes(r.decoded) for r in out.orderBy("doc_id").collect()] == [b"a", b"", b"", b"a b", b"a b"]
    assert decode(encode(df.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).collect() == []
