"""Token counts of a sentencepiece BPE model with a whole-token shortcut.

No piece of such a model holds a space mark after another character, so merges never cross the
place where a word ends and a space begins.  A text is therefore a row of pre-tokens (the spaces before a
word and the word) whose counts add up.  Before any text is read, on the driver, every vocabulary string is encoded
alone; those that come back as themselves are proved whole tokens, are shipped to the workers and count as 1 by a lookup.  Only other pre-tokens
are merged, by the library, and remembered for the texts that follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditflow.llm.memo import Memo, resident
from creditflow.llm.shared import n_bytes, small_batches

MARK = "▁"
_spaced = re.compile(" +[^ ]*")


def prove_whole(path: str) -> dict[str, int]:
    """The pre-tokens that are a vocabulary string and that the model encodes, alone, as that one token; and the empty one.

    Raises for a model whose counts do not add up by pre-token.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    for p in pieces:
        if re.search(f"[^{MARK}]{MARK}", p):
            raise ValueError(f"piece {p!r} crosses a word boundary; this model's counts do not add up by pre-token")
    words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
    whole = {w: 1 for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1 and model.id_to_piece(ids[0]) == MARK + w}
    return whole | {"": len(model.encode("a ")) - len(model.encode("a"))}  # a space before nothing


class PreTokenCounter:
    """Counts for one model file; keys are pre-tokens without the first space, which the model adds itself."""

    def __init__(self, path: str, whole: dict[str, int]):
        import sentencepiece

        self.model, self.whole = sentencepiece.SentencePieceProcessor(model_file=path), whole
        self.memo = Memo(self._merge, 400_000)

    def pre_tokens(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        return [m[1:] for m in _spaced.findall(" " + text)] if "" in parts else parts

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(self.memo.values(self.pre_tokens(text)))

    def _merge(self, pre_tokens: list[str]) -> list[int]:
        whole, rest = self.whole, [p for p in pre_tokens if p not in self.whole]
        merged = dict(zip(rest, map(len, self.model.encode(rest, num_threads=1)), strict=True))
        return [whole[p] if p in whole else merged[p] for p in pre_tokens]


def counter(path: str, whole: dict[str, int]) -> PreTokenCounter:
    return resident(f"token counts {path}", lambda: PreTokenCounter(path, whole))


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row.

    Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id stays null.  Texts of any length are counted
    whole.  Repeated rows give repeated rows, an empty table none; extra columns are ignored.
    """
    small_batches(df.sparkSession)
    proved = df.sparkSession.sparkContext.broadcast(prove_whole(model_path))  # bounded by the vocabulary

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(model_path, proved.value)
        for batch in texts:
            yield pd.Series([own.count(t) for t in batch], dtype="int64")

    out = df.select(F.col(id_col), n_bytes(F.col(text_col)).alias("n_bytes"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
