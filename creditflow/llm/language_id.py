"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Per language, character n-grams of words (with start and end marks) are counted on Spark over a bounded sample of
labelled documents; one table for all languages holds, per n-gram seen in any of them, the full interpolated
log-probability in each.  A text's cross-entropy under a language is the mean over its characters; the lowest
wins.  A language's own held-aside documents calibrate the cross-entropy above which a text is rejected.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditflow.llm.memo import Memo, resident
from creditflow.llm.shared import named, small_batches, written

UNKNOWN = "und"
ORDER = 4
START, END = "\x02", "\x03"
_letters = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    return _letters.findall(text.lower())


def _hash(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place; codes is uint64 with ``order - 1`` places before the first."""
    n = len(codes) - order + 1
    h = np.full(n, order, "uint64")
    for k in range(order):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64")


@dataclass
class Model:
    """Per order: sorted hashes of n-grams and their log-probabilities; sorted hashes of contexts and back-off weights."""

    languages: list[str]
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unknown: np.ndarray
    limits: np.ndarray | None = None

    def lookup(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.hashes[k - 1], h), len(self.hashes[k - 1]) - 1)
        return self.hashes[k - 1][i] == h, i

    def characters(self, codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        """Log-probabilities (places x languages) of the characters at ``at`` given up to ``order - 1`` before."""
        if order == 0:
            return np.broadcast_to(self.unknown, (len(at), len(self.languages)))
        h = _hash(codes, order)[at - order + 1]
        seen, i = self.lookup(order, h)
        out = self.logp[order - 1][i]
        if not seen.all():
            miss = np.flatnonzero(~seen)
            lower = self.characters(codes, at[miss], order - 1).astype("float32")
            if order > 1:
                hc = _hash(codes, order - 1)[at[miss] - order + 1]
                ctx = self.contexts[order - 1]
                j = np.minimum(np.searchsorted(ctx, hc), len(ctx) - 1)
                known = ctx[j] == hc
                lower[known] += self.backoff[order - 1][j[known]]
            out[miss] = lower
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Sums of log-probabilities by word (words x languages); the last column counts characters."""
        n = len(self.hashes)
        if not words:
            return np.zeros((0, len(self.languages) + 1), "float32")
        codes = _codes("".join([START * (n - 1) + w + END for w in words]))
        sizes = np.array([len(w) + 1 for w in words])
        at = np.flatnonzero(codes != ord(START))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(self.characters(codes, at, n), starts, axis=0)
        return np.hstack([sums, sizes[:, None]]).astype("float32")


def build(counts: pd.DataFrame, order: int = ORDER) -> Model:
    """The model from (lang, gram, n): counts of n-grams of the highest order.

    Discount per order and language: n1 / (n1 + 2 n2).  Lower orders use continuation counts.
    """
    languages = sorted(counts["lang"].unique())
    codes = np.stack([_codes(g) for g in counts["gram"]])
    lang = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    n = counts["n"].to_numpy("float64")
    size = len(languages)
    tables = {}
    for k in range(order, 0, -1):  # unique k-grams and their counts by language
        grams, inverse = np.unique(codes, axis=0, return_inverse=True)
        table = np.zeros((len(grams), size))
        np.add.at(table, (inverse.ravel(), lang), n)
        tables[k] = grams, table
        g, l = np.nonzero(table)
        codes, lang, n = grams[g][:, 1:], l, np.ones(len(g))
    hash_rows = lambda grams, k: _hash(grams.ravel(), k)[::k] if len(grams) else np.zeros(0, "uint64")
    hashes, logp, contexts, backoff = [], [], [], []
    characters = len(tables[1][0]) + 1
    lower_hash, lower_p = np.zeros(0, "uint64"), None
    for k in range(1, order + 1):
        grams, table = tables[k]
        n1, n2 = (table == 1).sum(0), (table == 2).sum(0)
        d = np.where(n1 + n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5).clip(0.1, 0.9)
        ctx, inverse = np.unique(grams[:, :-1], axis=0, return_inverse=True) if k > 1 else (np.zeros((1, 0), "uint64"), np.zeros(len(grams), int))
        inverse = inverse.ravel()
        sums, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
        np.add.at(sums, inverse, table)
        np.add.at(kinds, inverse, (table > 0).astype(float))
        bow = np.where(sums > 0, d * kinds / np.maximum(sums, 1), 1.0)
        if k == 1:
            below = np.full((len(grams), size), 1.0 / characters)
            unknown = np.log(bow[0] / characters)
        else:
            below = lower_p[np.searchsorted(lower_hash, hash_rows(grams[:, 1:].copy(), k - 1))]
        p = np.where(sums[inverse] > 0, np.maximum(table - d, 0) / np.maximum(sums[inverse], 1), 0.0) + bow[inverse] * below
        h = hash_rows(grams, k)
        by = np.argsort(h)
        hashes.append(h[by])
        logp.append(np.log(p[by]).astype("float32"))
        hc = hash_rows(ctx, k - 1) if k > 1 else np.zeros(1, "uint64")
        bc = np.argsort(hc)
        contexts.append(hc[bc])
        backoff.append(np.log(bow[bc]).astype("float32"))
        lower_hash, lower_p = h[by], p[by]
    return Model(languages, hashes, logp, contexts, backoff, unknown.astype("float32"))


class Scorer:
    """Cross-entropies of whole texts; the sums of every distinct piece between spaces are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.memo = Memo(self._pieces, 120_000)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        words = [letter_words(p) for p in pieces]
        sums = np.vstack([self.model.words([w for ws in words for w in ws]), np.zeros((1, len(self.model.languages) + 1), "float32")])
        ends = np.cumsum([len(ws) for ws in words])
        total = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums[:-1], axis=0, dtype="float64")])
        return [row.tobytes() for row in (total[ends] - total[np.concatenate([[0], ends[:-1]])]).astype("float32")]

    def __call__(self, text: str | None) -> tuple[np.ndarray, int]:
        """(cross-entropy by language in nats, characters); no letters: 0 characters."""
        pieces = text.split() if text else []
        if not pieces:
            return np.zeros(len(self.model.languages)), 0
        sums = np.frombuffer(b"".join(self.memo.values(pieces)), "float32").reshape(len(pieces), -1).sum(axis=0, dtype="float64")
        n = int(sums[-1])
        return (-sums[:-1] / n if n else np.zeros(len(self.model.languages))), n


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, mod 3; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3, F.lit(-1))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each label of (id, text, lang), stored once; nowhere more than some three times that.

    Rows are drawn by a hash of their id, at a rate from a count by label.  Equal rows are taken once.  Where an id that
    many texts share is drawn, its label's rows are drawn again, by their texts too.
    """
    spark, bits = rows.sparkSession, 1 << 30

    def rates(per_label: DataFrame, wanted: int) -> DataFrame:
        of = [(r["lang"], int(min(1.0, wanted / r["n"]) * bits)) for r in per_label.collect()]  # a row a label
        return F.broadcast(spark.createDataFrame(of, "lang string, rate long"))

    counted = lambda df: df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = lambda seed, *columns: F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(bits))
    drawn = rows.join(rates(counted(rows), most), "lang").where(draw(5, "id") < F.col("rate"))
    drawn = written(drawn.select("id", "text", "lang").dropDuplicates(), "language-sample")
    # Twice the rows wanted are beyond chance where ids differ, so this draws only among ids that repeat.
    return drawn.join(rates(counted(drawn), 2 * most), "lang").where(draw(7, "id", "text") < F.col("rate")).drop("rate")


def train(
    df: DataFrame, per_language: int = 600, calibrate: int = 100, order: int = ORDER, margin: float = 1.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model | None:
    """Fit on about ``per_language`` documents of each label and calibrate on about ``calibrate`` others.

    Rows are chosen by ``sample``, whose bound does not grow with the table; their whole texts are used.  Every label has a
    model: what comes to the driver and to the workers grows with the number of different labels, and with nothing else.
    Rows without text, label or id are left out.  None if nothing is left.  Only n-gram counts (bounded by the sample) and
    one row a language come to the driver.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    most = per_language + calibrate
    chosen = sample(rows, most).withColumn("fit", F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(most)) < per_language)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for word, times in Counter(letter_words(text)).items():
                    s = START * (order - 1) + word + END
                    for i in range(len(word) + 1):
                        n[lang, s[i : i + order]] += times
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["lang", "gram", "n"])

    counts = chosen.where("fit").select("lang", "text").mapInPandas(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    model = build(counts, order)
    own = predict(chosen.where(~F.col("fit")), model, id_col="id", text_col="text", extra=["lang"])
    own = own.where((F.col("lang") == F.col("lang_pred")) & (F.col("n_letters") >= 20)).groupBy("lang").agg(F.max("cross_entropy").alias("top"))
    tops = {r["lang"]: r["top"] for r in own.collect()}
    # A language without calibration rows takes the highest limit; a margin in nats is kept above the worst own text.
    highest = max(tops.values(), default=math.inf)
    model.limits = np.array([tops.get(x, highest) + margin for x in model.languages])
    return model


RESULT = "lang_pred string, score double, cross_entropy double, n_letters long, rejected boolean"


def judgement(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """A struct of lang_pred, score, cross_entropy, n_letters (with word ends) and rejected for a column of texts.

    A null text, or one without letters, is ``und`` with score 0 and is rejected.  Whole texts are scored.  A tie goes
    to the first language by name.  ``rejected`` is also set where the cross-entropy is above the language's calibrated
    limit.  Without a model all is ``und``.
    """
    small_batches(spark)
    if model is None:
        none = {"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": 0.0, "n_letters": 0, "rejected": True}
        return F.struct(*[F.lit(v).alias(k) for k, v in none.items()]).cast(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
    shipped, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # its size is bounded by the sample; workers outlive a query

    @F.pandas_udf(RESULT)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = resident(f"language {key}", lambda: Scorer(shipped.value))
        limits = own.model.limits
        for batch in texts:
            rows = []
            for text in batch:
                h, n = own(text)
                if not n:
                    rows.append((UNKNOWN, 0.0, 0.0, 0, True))
                    continue
                best = int(np.argmin(h))
                share = 1.0 / np.exp(-(h - h[best]) * min(n, 64)).sum()
                rows.append((own.model.languages[best], float(share), float(h[best]), n, bool(limits is not None and h[best] > limits[best])))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "cross_entropy", "n_letters", "rejected"])

    # Spark would copy the function into every filter on its result, and score each text again there.
    return score.asNondeterministic()(F.coalesce(text, F.lit("")))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """id (and ``extra`` columns), lang_pred, score, cross_entropy, n_letters, rejected: see ``judgement``.

    A null id stays null.  Repeated rows give repeated rows, an empty table none.  Other columns of ``df`` are left out,
    whatever their names; an ``extra`` one with the name of a result gives two columns of that name, for which
    ``judgement`` is the way.
    """
    keep = [id_col, *(extra or [])]
    inner = max(["got", *keep], key=len) + "_"  # a name that no column has
    got = judgement(df.sparkSession, model, named(text_col)).alias(inner)
    fields = [named(inner)[f.split()[0]].alias(f.split()[0]) for f in RESULT.split(", ")]
    return df.select(*map(named, keep), got).select(*map(named, keep), *fields)
