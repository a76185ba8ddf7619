"""The cached encoder against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.llm import tokens

ODD = [
    "", " ", "a  b", "a   b ", "x\n\n y", "a\n b\nc", "it's WE'LL ok  .", "<|endoftext|> a <|startoftext|>", "\ta b\r\nc", "\x1c x\x1fy", "é é ́x", "ΑΣ ΑΣ. İx", "a .b,, c!?", " lead", "tail ", "tail\n", "\nlead",
    "x.\nY z", "x \ny", "日本 語。 ok", "\U0001f600 hi 12345 3.14", "a b 　 c", "a \n\n b", " x y", "word.\n\nNext", "Å Å K",
]


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("cache", [700_000, 50])
def test_same_ids_as_whole_texts(name, keep, cache, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", cache)
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x20, 0x250)]
    mixed = ["".join(rng.choice(letters + [" ", " ", "\n", ".", "the", "THE"]) for _ in range(60)) for _ in range(150)]
    each = [f"A{c}b {c} {c}{c}. {c}\nX" for c in letters]
    texts = ODD + mixed + each + ODD
    path = public_tokenizers.path(name)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path, keep)
    got = [x for at in range(0, len(texts), 7) for x in own.encode(texts[at : at + 7])]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_new_words_skip_the_whole_library(name, keep, monkeypatch):
    """Words of letters, with and without accents and marks behind them, go to the library's model at once."""
    own, seen = tokens.Encoder(public_tokenizers.path(name), keep), []
    whole = own.whole
    monkeypatch.setattr(own, "whole", lambda texts: seen.extend(texts) or whole(texts))
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdeéßñüThwr", k=rng.randint(3, 12))) for _ in range(3000)]
    text = " ".join(w + rng.choice(["", "", ",", "."]) for w in words)
    want = np.array(Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert own.encode([text]) == [want] and len(seen) < 10


def test_words_go_when_a_task_ends():
    path = public_tokenizers.path("word_bpe_49k.json")
    with tokens.encoding(path, False) as enc:
        enc.encode(["some words, and some more"])
        assert enc.new
    assert tokens.encoder(path, False) is enc and not enc.new and not enc.old
