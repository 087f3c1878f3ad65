"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Byte ``b`` is the character U+0100+b.  Every token of the rank file is a piece scored by its negative rank, so
the model's best merge is the lowest rank; normalisation is the identity, without prefix, escapes or white-space
rules.  Texts are cut by the vocabulary's pattern, pre-tokens that are tokens are looked up, the rest merged.
Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditflow.llm.memo import Memo, resident
from creditflow.llm.shared import small_batches
from creditflow.llm.word_ids import spaced_chunk, word_chunks

_to_char = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; the file's ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """The ModelProto: a piece per rank (id = rank), an unknown piece after them, BPE type, identity normaliser."""
    pieces = [_field(1, _field(1, t.decode("latin-1").translate(_to_char).encode()) + _field(2, float(-i))) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(22, 0) + _field(40, len(tokens)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder for one rank file; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.cut = regex.compile(pattern).findall
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.pieces = Memo(self._merge, 60_000)
        self.chunks = Memo(self._join, 20_000)
        self.spaced = Memo(lambda words: self._join([spaced_chunk(w) for w in words]), 100_000)

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """A pre-token that is a token is that token; others are merged by the model."""
        raw = [p.encode() for p in pieces]
        rest = [t for t in raw if t not in self.whole]
        merged = self.model.encode([t.decode("latin-1").translate(_to_char) for t in rest], num_threads=1)
        packed = dict(zip(rest, [struct.pack(f"<{len(ids)}I", *ids) for ids in merged], strict=True))
        return [self.whole.get(t) or packed[t] for t in raw]

    def _join(self, chunks: list[str]) -> list[bytes]:
        cut = [self.cut(c) for c in chunks]
        ids = iter(self.pieces.values([p for ps in cut for p in ps]))
        return [b"".join(islice(ids, len(ps))) for ps in cut]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks, spaced = word_chunks(text)
        return b"".join(self.chunks.values(chunks) + self.spaced.values(spaced))

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(packed).cast("I")]) if packed else b""


def codec(path: str, pattern: str) -> ByteBPE:
    return resident(f"byte BPE {path} {pattern}", lambda: ByteBPE(path, pattern))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit), n_tokens, decoded (binary) for every row.

    ``decoded`` is made from the ids by the inverse mapping, not from the text.  Nulls: a null text is encoded as
    empty (no ids, no bytes); a null id stays null.  Texts of any length are encoded whole; repeated rows give repeated
    rows, an empty table none; extra columns are ignored.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_path, pattern)
        for batch in texts:
            ids = [own.encode(t) for t in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(x) for x in ids]})

    out = df.select(F.col(id_col), both(F.coalesce(F.col(text_col), F.lit(""))).alias("both"))
    return out.select(id_col, "both.ids", (F.octet_length("both.ids") / 4).cast("long").alias("n_tokens"), "both.decoded")
