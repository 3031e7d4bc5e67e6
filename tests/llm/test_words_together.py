"""The search over many words at once and the search over one word give the same paths and scores, to the last bit."""

from __future__ import annotations

import random

import public_tokenizers

from quayside.llm import sentencepiece


def test_words_are_searched_together(monkeypatch):
    pieces = sentencepiece.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 4)
    rng = random.Random(5)
    some = sorted(p for p in pieces.pieces if len(p) < 8)
    words = {"".join(rng.choice(some) for _ in range(rng.randrange(1, 5))) for _ in range(3000)}
    words |= {"▁", "▁a", "▁a\nb", "日本", "😀▁", "▁" + "ab" * 40}
    expected = {w: pieces.best_two(w) for w in words}
    alone, one = [], pieces.best_two
    monkeypatch.setattr(pieces, "best_two", lambda w: alone.append(w) or one(w))
    pieces.learn(words)
    assert pieces.known == expected
    assert all(len(w) > sentencepiece.LONGEST or not pieces.single.issuperset(w) for w in alone) and "▁a\nb" in alone


def test_sequences_are_decoded_together():
    pieces = sentencepiece.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 4)
    texts = ["", "a b", "x\ny 😀 日本", "  two  spaces "]
    ids = [found[0][1] for found in pieces.encode(texts)]
    plain = [t.replace(sentencepiece.SPACE, " ") for t in pieces.model.normalize(texts)]
    assert pieces.decode_all(ids) == [p[1:] if pieces.dummy and p[:1] == " " else p for p in plain]
    assert pieces.decode_all([]) == []
