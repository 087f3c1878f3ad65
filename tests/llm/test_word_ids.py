"""The word encoder against the library on whole texts, and how much it asks the library."""

import random

import pyarrow as pa
import pytest

from creditflow.llm import word_ids

P = pytest.importorskip("public_tokenizers")
#: White space of every kind, what may be taken for it, signs, contractions, letters beyond ASCII and an added token.
ATOMS = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x00", "\x85", "\xa0", " ", " "]
ATOMS += [" ", " ", " ", "　", "᠎", "​", "﻿", "a", "foo", "Bar", "é", "É", "À", "ñ", "ß", "×", "÷", "é", "Ω"]
ATOMS += ["中文", "。", "「", "—", "…", "Ⅷ", "²", "🙂", "1", "42", "'", "'s", "'t", "'ll", "'LL", "'re", "x'", "don't", ",", ".", "...", "!?", "("]
ATOMS += ["привет", "שלום", "سلام", "ひらがな", "カー", "한국", "，", "’", "«", "_", "$", "\U0002ebf0", "\U00010d4a", "\u4dc0", "\u0301", "<|", "<|endoftext|>"]


@pytest.fixture
def encoder():
    return word_ids.WordEncoder(P.path("byte_bpe_50k.json"), P.PATTERN)


def ids_of(encoder, texts, end_id=7):
    offsets, ids = encoder.encode(texts, end_id)
    assert offsets[0] == 0 and offsets[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_equals_the_library(encoder):
    rng = random.Random(5)
    texts = [None if i % 97 == 0 else "".join(rng.choices(ATOMS, k=rng.randrange(14))) for i in range(20_000)]
    for lo in range(0, len(texts), 2_500):  # what was remembered and what is new
        some = texts[lo : lo + 2_500]
        want = [[*e.ids, 7] for e in encoder.tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert ids_of(encoder, pa.array(some)) == want
        assert ids_of(encoder, pa.array(some).slice(3, 50)) == want[3:53]
    assert ids_of(encoder, pa.array([], pa.string())) == []


def test_a_word_is_asked_for_once(encoder):
    """By batch, and whatever signs and line ends are around it."""
    asked, looked, compute, values = [], [], encoder.words.compute, encoder.words.values
    encoder.words.compute = lambda words: asked.extend(words) or compute(words)
    encoder.words.values = lambda words: looked.extend(words) or values(words)
    texts = pa.array(["\n".join(f" réré{s} word{s}" for s in (",", ".", "!?", ":", "", ")")) + " 42%"] * 100)
    encoder.encode(texts, 0)
    assert sorted(asked) == sorted([" réré", " word", "\n", ",", ".", "!?", ":", ")", " 42", "%"]) == sorted(looked)
    encoder.encode(texts, 0)
    assert len(asked) == 10


def test_other_patterns_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        word_ids.WordEncoder(P.path("byte_bpe_50k.json"), r"\S+|\s+")
