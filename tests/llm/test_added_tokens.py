"""Texts that hold the literal of an added token get its id, as the plain tokenizer gives it."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quayside.llm import packing, token_output
from quayside.llm.tokens import Encoder
from quayside.session import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>", "<|endoftext|><|endoftext|> b", "x  <|endoftext|>\n\ny ",
         "no <|endof text|> here", "one two", " two\u3000<|endoftext|>é", "", "one  two\n"]


def test_added_tokens(spark):
    plain = Tokenizer.from_file(TOKENIZER)
    ids = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert ids[0] == [505, 220, 50256, 734] and sum(50256 in i for i in ids) == 6
    encoder = Encoder(TOKENIZER)
    for _ in range(2):  # new units, then known ones
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(TEXTS))] == ids
    crc = [zlib.crc32(np.array([*i, 0], "<u4").tobytes()) for i in ids]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    folder = scratch(spark, "tokens")
    got = token_output.read(token_output.write(docs, folder, TOKENIZER), folder).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {d: (len(i) + 1, crc[d]) for d, i in enumerate(ids)}
    pieces = packing.pack(docs, TOKENIZER).collect()
    assert {r["doc_id"]: np.frombuffer(r["tokens"], "<u4").tolist() for r in pieces} == {d: [*i, 1] for d, i in enumerate(ids)}


def test_what_is_remembered_is_bounded_in_bytes():
    """Long texts without white space are not kept, short words up to a number of bytes; the ids stay those of the tokenizer."""
    import random

    import pyarrow as pa

    rng, plain = random.Random(1), Tokenizer.from_file(TOKENIZER)
    encoder = Encoder(TOKENIZER, remembered=100_000)
    for _ in range(6):
        texts = ["".join(rng.choices("abc漢字かな ", k=20_000)).replace(" ", "") for _ in range(3)]
        texts += [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(2000)), "", " ", "x  y ", "a\n b\t"]
        got = encoder.encode(pa.array(texts))
        assert [list(memoryview(ids).cast("I")) for ids in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.remembered() < 250_000
    assert encoder.remembered() > 10_000
