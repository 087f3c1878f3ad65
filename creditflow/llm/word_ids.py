"""The tokenizers library with a memory of words, for byte-level vocabularies."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from creditflow.llm.memo import Memo, resident

#: White space other than a space; with it, or with runs of spaces, a text is cut by a slower rule.
_white = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_before_word = re.compile(r"(?= \S)")
#: The pattern of these vocabularies, by which the library cuts and for which the cuts below hold.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and signs of old in every version of Unicode; no apostrophe, which may begin a contraction.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯא-תء-غف-يぁ-ゖァ-ヺー一-鿋가-힣"
_SIGNS = r"!-&(-/:-@\[-`{-~«»·–—‘’“”„…、。〈-】！（），：；？"
#: Surely one match: letters, digits or signs, after a space or not.
_one_match = re.compile(f" ?(?:[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+)").fullmatch
#: Where surely a match begins.
_sure = re.compile(f"(?<=[{_LETTERS}])(?=[{_SIGNS}])|(?<=[{_SIGNS}])(?=[{_LETTERS}])").split
#: The byte alphabet of these vocabularies: printable bytes stand for themselves, the others for U+0100 and on in turn.
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_others = iter(range(0x100, 0x200))
BYTE_LEVEL = "".join(chr(b if b in _printable else next(_others)) for b in range(256))

_SPACE, _LINE, _WORD, _SIGN, _QUOTE, _OTHER, _LATER, _MAYBE = range(8)
#: Bytes by what they are or begin: a space, other ASCII white space, ASCII letters and digits, signs, the apostrophe of
#: contractions, what is surely no white space; continuation bytes, which may end a white space, and what may begin one.
_KIND = np.full(256, _OTHER, "uint8")
_KIND[0x80:0xC0] = _LATER
_KIND[[*range(0x00, 0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = _MAYBE
_KIND[0x20], _KIND[0x09:0x0E] = _SPACE, _LINE
_KIND[0x21:0x7F] = [_WORD if chr(b).isalnum() else _QUOTE if b == 0x27 else _SIGN for b in range(0x21, 0x7F)]


def word_chunks(text: str) -> tuple[list[str], list[str]]:
    """Cut a text where byte-level patterns always begin a match: before a space or a line end that a word follows.

    Two lists, to be joined: pieces as they are, then pieces that each follow a space or begin with a line end.
    """
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or " \n" in text or "\n\n" in text or "\n " in text or text[-1:] == "\n" or "\t" in text or "\r" in text or _white.search(text):
        return [c for c in _before_word.split(text) if c], []
    return parts[:1], parts[1:]


def spaced_chunk(part: str) -> str:
    return part if part[0] == "\n" else " " + part


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cut texts where byte-level patterns always begin a match; the words in turn, and each text's first word.

    Such places are: in a run of white space, before its first character and, if a word follows, before its last; after a
    last one that is no space; between ASCII letters or digits (before a sign, letters to U+00FF) and signs.  The apostrophe,
    which may begin a contraction, is not cut from what follows.  Where a neighbour may be white space beyond ASCII there
    is no cut, so a word is longer.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[: offsets[-1]]
    kind = _KIND[data]
    accented = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[1:][accented] = _WORD
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    firsts, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
    after[ends - 1] = _SPACE  # white space that ends a text is one match
    solid = (kind >= _WORD) & (kind <= _OTHER)
    cut = (kind <= _LINE) & (((before >= _WORD) & (before <= _OTHER)) | ((after >= _WORD) & (after <= _OTHER)))
    cut |= solid & (before == _LINE)
    cut |= ((kind == _SIGN) | (kind == _QUOTE)) & (before == _WORD)
    cut |= (kind == _WORD) & (before == _SIGN)
    cut[firsts] = True
    cut[: offsets[0]] = False
    bounds = np.append(np.flatnonzero(cut), offsets[-1])
    words = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype("int64")), pa.py_buffer(data))
    return words, np.searchsorted(bounds[:-1], offsets)


class WordEncoder:
    """Ids of whole texts, equal to the library's on the text as one string.

    Every distinct word is encoded by the library once and remembered.  Added tokens are found by the library:
    a text that holds one of their strings is given to it whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cutter = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or type(cutter).__name__ != "ByteLevel" or cutter.add_prefix_space or not cutter.use_regex or pattern != PATTERN:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.merge = self.tokenizer.model.tokenize
        self.words = Memo(self._words, 500_000)
        self.parts = Memo(self._parts, 200_000)

    def _encode(self, texts: list[str], at_once: int = 5_000) -> list[bytes]:
        out = []
        for i in range(0, len(texts), at_once):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Words that are not surely one match are cut further: texts without spaces are one word."""
        others = [w for w in words if not _one_match(w)]
        cut = [_sure(w) for w in others]
        lists = iter(self.parts.values([p for ps in cut for p in ps]))
        found = {w: b"".join(islice(lists, len(ps))) for w, ps in zip(others, cut, strict=True)}
        return [found[w] if w in found else self._match(w) for w in words]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """The library's model on what is surely one match, the whole library on the rest."""
        others = [p for p in parts if not _one_match(p)]
        found = dict(zip(others, self._encode(others), strict=True))
        return [found[p] if p in found else self._match(p) for p in parts]

    def _match(self, word: str) -> bytes:
        """One match in the model's byte alphabet."""
        own = charmap_decode(word.encode(), "strict", BYTE_LEVEL)[0]
        return array("I", [t.id for t in self.merge(own)]).tobytes()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Every text's ids and ``end_id``: where each text begins among them all, and them all.  A null is an empty text."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        words, first = words_of(pc.if_else(pa.array(whole), "", texts))
        words = words.dictionary_encode()
        lists = self.words.values(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        of_whole = len(lists) + np.arange(whole.sum())
        lists += self._encode(texts.filter(pa.array(whole)).to_pylist())
        lists.append(array("I", [end_id]).tobytes())
        # A text is its words, or one list for the whole of it, and the end.
        more = np.concatenate([of_whole, np.full(len(texts), len(lists) - 1)])
        order = np.argsort(np.concatenate([np.flatnonzero(whole), np.arange(len(texts))]), kind="stable")
        at = np.concatenate([first[1:][whole], first[1:]])
        turn = np.insert(words.indices.to_numpy(), at[order], more[order])
        starts = first + np.concatenate([[0], np.cumsum(1 + whole)])
        sizes = np.fromiter((len(x) // 4 for x in lists), "int64", len(lists))
        known = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(lists), "int32")))
        return np.concatenate([[0], np.cumsum(sizes[turn])])[starts], known.take(pa.array(turn)).flatten().to_numpy()


def encoder(path: str, pattern: str) -> WordEncoder:
    return resident(f"word ids {path} {pattern}", lambda: WordEncoder(path, pattern))
