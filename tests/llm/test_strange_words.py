"""Words with characters that have no piece are searched many at a time, and texts cut into words as the pattern cuts them."""

from __future__ import annotations

import random

import public_tokenizers

from quayside.llm import sentencepiece


def test_strange_words_are_searched_together(monkeypatch):
    pieces = sentencepiece.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 4)
    rng = random.Random(7)
    some = sorted(p for p in pieces.pieces if len(p) < 8)[::50]
    words = {"".join(rng.choice([*some, "\n", "\0", "😀", "\U0010ffff", "漢字"]) for _ in range(rng.randrange(2, 5))) + "\n" for _ in range(500)}
    words = {w for w in words if len(w) <= sentencepiece.LONGEST}
    expected = {w: pieces.best_two(w) for w in words}
    alone, one = [], pieces.best_two
    monkeypatch.setattr(pieces, "best_two", lambda w: alone.append(w) or one(w))
    pieces.learn(words)
    assert pieces.known == expected and not alone


def test_words_of_texts():
    pieces = sentencepiece.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 4)
    rng = random.Random(8)
    texts = ["", "▁", "▁▁", "a", "", "▁a\nb▁▁", "▁c", *("".join(rng.choice("▁▁ab\né漢😀▂") for _ in range(9)) for _ in range(300)), ""]
    for some in (texts, [], [""]):
        words, firsts = pieces.words(some)
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(firsts, firsts[1:])] == [pieces.word.findall(t) for t in some]
