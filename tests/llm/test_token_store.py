"""The encoder of op5 against the tokenizers library on texts that sit badly with cutting them into pieces."""

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import token_store

ODD = [
    "It's 'tis don''t a-'s 's ''s I'LL we'Ve", "ΑΣ.b ΑΣ, İstanbul J̌a ẖ ≠ ≮x a≠b é,è café,x", "<|StartOfText|>x <|", "\x00a\x1cb \x85c\xa0d　e", "１２ ½² Ⅷ 12a3", "", None,
    "x" * 5000, "a'b'c'll'd9's", "'", "''", "zero​‍join", "é́ñ̃ 가 ﬁ", "áb ÅC", "日本語 text，漢字。 ok", "𝐀𝐛 😀😀a 👍🏽", "_a_b__c_ $%^a&*(b) 3.14e10 x=1;y='2'",
]


def ids(encoder, texts):
    return [[*encoder.tokenizer.encode(x or "", add_special_tokens=False).ids, encoder.end] for x in texts]


@pytest.mark.parametrize("more", [[], ["<|endoftext|> a"]], ids=["plain", "with an added token"])
def test_odd_texts(more):
    encoder = token_store.Encoder(token_store.default_tokenizer(), 1)
    assert encoder.by_piece
    assert [x.tolist() for x in encoder(pa.array(ODD + more))] == ids(encoder, ODD + more)


def test_random_texts():
    encoder, rng = token_store.Encoder(token_store.default_tokenizer(), 1), np.random.default_rng(5)
    signs = list("abcXYZ019 '.,<|>-\n\té̈ÀßΣ日Ⅷ²")
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
    for part in (texts[:1500], texts[1500:], texts[:1500]):
        assert [x.tolist() for x in encoder(pa.array(part))] == ids(encoder, part)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE", 200)
    encoder = token_store.Encoder(token_store.default_tokenizer(), 1)
    texts = [f"common words and word{chr(97 + k % 26)}{chr(97 + k // 26)}x{k}" for k in range(600)]
    for a in range(0, 600, 50):
        assert [x.tolist() for x in encoder(pa.array(texts[a : a + 50]))] == ids(encoder, texts[a : a + 50])
        assert len(encoder.at) <= 400


def test_hashes_that_meet(monkeypatch):
    """Pieces with one hash are told apart by their bytes."""
    monkeypatch.setattr(token_store, "hashes", lambda strings: np.full(len(strings), 7, np.uint64))
    encoder = token_store.Encoder(token_store.default_tokenizer(), 1)
    texts = ["one two", "three one", "two"]
    assert [x.tolist() for x in encoder(pa.array(texts))] == ids(encoder, texts)


def test_another_make_of_tokenizer():
    """A tokenizer whose pieces hold white space gets whole texts."""
    import public_tokenizers

    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1)
    assert not encoder.by_piece
    assert [x.tolist() for x in encoder(pa.array(ODD))] == ids(encoder, ODD)
