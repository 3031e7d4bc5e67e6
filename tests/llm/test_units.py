"""Units, into which texts are cut for the tokenizer: their ids are those of the plain tokenizer, and all are looked up at once."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quayside.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]


def test_units_have_the_ids_of_the_plain_tokenizer():
    rng, plain, encoder = random.Random(7), Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER)
    wide = [chr(i) for i in range(0x80, 0x3100) if chr(i).isspace()]
    some = [*map(chr, range(128)), *map(chr, range(0xA0, 0x100)), *wide, *"ab 12 '' \n\n\t  ", "'s", "'ll", "n't", "I'M", "×", "÷", "ª", "²", "½", "漢",
            "か", "。", "\u200b", "\u0301", "\u0660", "\U0001f600", "\U00020000", "ſ", "й", "“", "<|", "|>", "the", "schön."]
    for _ in range(40):
        texts = ["".join(rng.choices(some, k=rng.randrange(60))) for _ in range(60)] + ["", " ", "\u3000", "a", "é,"]
        wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids_of(encoder, pa.array(texts)) == wanted
        assert ids_of(encoder, pa.array([t.encode() for t in texts], pa.binary()).slice(7, 40)) == wanted[7:47]


def test_texts_with_white_space_at_their_end_are_looked_up_together(monkeypatch):
    """Each look-up costs as much as all that is remembered, so there is one, whatever the texts are like."""
    looked_up, real = [], Encoder._units
    monkeypatch.setattr(Encoder, "_units", lambda self, units: looked_up.append(len(units)) or real(self, units))
    texts = [f"word{i}  and\u3000more \n" for i in range(50)]
    plain, encoder = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER)
    assert ids_of(encoder, pa.array(texts)) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert looked_up == [53]


def test_a_word_with_other_punctuation_is_not_encoded_again(monkeypatch):
    encoder, made, real = Encoder(TOKENIZER), [], Encoder._new
    monkeypatch.setattr(Encoder, "_new", lambda self, units: made.extend(units.to_pylist()) or real(self, units))
    encoder.encode(pa.array(["a lorem ipsum, lorem.\nIpsum lorem; ipsum"]))
    encoder.encode(pa.array(["a lorem! ipsum) lorem"]))
    assert sorted(made) == ["\nIpsum", " ipsum", " lorem", "!", ")", ",", ".", ";", "a"]
