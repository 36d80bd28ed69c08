"""What a worker of the piece encoding holds stays small, and results don't depend on it."""

import sys

import numpy as np

from gridloom.llm import chunked, pieces


def test_two_generations_of_words_stay_small():
    own = pieces.PieceEncoder(pieces.default_model(), verify=False)
    list(own.encode([" ".join(f"word{i:07d}" for i in range(2000))]))
    kept = own._chunks._young
    each = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in kept.items()) / len(kept) + sys.getsizeof(kept) / len(kept)
    assert all(k.isascii() for k in kept)
    assert 2 * own._chunks._limit * each < 80e6


def test_a_long_text_is_encoded_in_bounded_pieces(monkeypatch):
    asked = []
    flush = chunked.ChunkEncoder._flush
    monkeypatch.setattr(chunked.ChunkEncoder, "_flush", lambda self, group: asked.append(sum(map(len, group))) or flush(self, group))
    own = pieces.PieceEncoder(pieces.default_model())
    text = "one ▁two  three▁\n " * 100_000
    assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == own.vocabulary.library.encode(text, add_bos=True, add_eos=True)
    assert len(asked) > 3 and max(asked) <= chunked.PIECE


def test_words_that_left_the_cache_get_the_same_ids():
    own = pieces.PieceEncoder(pieces.default_model())
    own._chunks._limit = 5
    texts = ["a b c d e f g", "▁a ▁b", "x  y z a", "", "b c\td", "a b c d e f g", "é 日 ▁ 😀", " a"]
    for text in texts * 2:
        assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == own.vocabulary.library.encode(text, add_bos=True, add_eos=True)
