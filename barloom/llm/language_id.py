"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits: the exhaustive code (2**(L-1) - 1 bits) for up to
MAX_EXHAUSTIVE languages, a seeded random dense code beyond. One binary classifier per bit, naive Bayes
over hashed byte 2- and 3-grams, tells the languages coded +1 from those coded -1; its margin on a text
is the mean log-odds over the text's n-grams. N-gram counts by language are summed over all training
rows by the cluster; only the table of counts (languages x BUCKETS) reaches the driver.

Decoding is loss-weighted: a bit's margin is scaled by its spread, and a language's loss is the sum of
exp(-bit * margin), weighted by how often that classifier is right on that language. Those two
statistics come from a bounded sample of different training rows (``calibration_rows``, the smallest hashes of id,
language and text, so that reruns agree). The least loss wins; a
text whose two least losses are close (``ambiguity``) is flagged ambiguous. The score is the winner's
share in the soft minimum of the losses.

Defined results: null texts and texts without a letter are "und" with score 0 and not ambiguous;
with no training row every text is "und"; with one language every text with a letter is that one,
score 1; equal losses go to the language first in code-point order; repeated rows, and rows of one id, are
predicted by their own text; very long texts are read whole, piece by piece; a null id is never held out; an empty table gives
no rows; other columns are ignored. The construction of the code follows the number of languages alone, as
the exhaustive code doubles with each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import chargrams
from barloom.llm.common import different_by_hash, give_back, slices

BITS = 15
BUCKETS = 2 << BITS
ORDERS = (2, 3)
MAX_EXHAUSTIVE = 6
#: n-grams whose weights are looked up at once, whatever the length of a text.
PIECE = 1 << 15
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """[language, bit] of +1/-1; rows differ, no column is constant."""
    if n <= MAX_EXHAUSTIVE:
        bits = [[1 if (column >> (n - 1 - i)) & 1 else -1 for i in range(n)] for column in range(1 << (n - 1), (1 << n) - 1)]
        return np.array(bits, dtype=np.int8).reshape(-1, n).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    while True:
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, width))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0, dtype=int)) < n).all():
            return code


def bucket_codes(data: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of each order from every place in a text; none of the spaces after the last, whose place is chance."""
    for k, n in enumerate(ORDERS):
        code = chargrams.codes(data, n)[: len(data) - chargrams.GAP]
        yield chargrams.hashed(code, BITS, n) + (k << BITS)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # [bucket, bit] log-odds
    spread: np.ndarray  # [bit]
    trust: np.ndarray  # [language, bit], rows sum to 1
    ambiguity: float = 0.1

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Mean log-odds [text, bit]."""
        out = np.zeros((len(texts), self.code.shape[1]), dtype=np.float64)
        for first, end, data, starts in chargrams.layout(texts):
            lengths = np.diff(np.append(starts, len(data) - chargrams.GAP))
            for buckets in bucket_codes(data):
                for at in range(0, len(buckets), PIECE):
                    part = buckets[at : at + PIECE]
                    # the texts that have n-grams in this piece
                    low, high = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(part))
                    out[first + low : first + high] += np.add.reduceat(self.weights.take(part, axis=0), np.maximum(starts[low:high] - at, 0), axis=0)
            out[first:end] /= np.maximum(lengths - chargrams.GAP, 1)[:, None] * len(ORDERS)
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        z = np.clip(margins / self.spread, -8, 8)
        return np.stack([(np.exp(-z * self.code[i]) * self.trust[i]).sum(axis=1) for i in range(len(self.languages))], axis=1)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts], dtype=bool)
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if len(self.languages) == 1:
            return [self.languages[0] if x else "und" for x in lettered], lettered.astype(float), np.zeros(len(texts), dtype=bool)
        loss = self.losses(self.margins(texts))
        order = np.argsort(loss, axis=1, kind="stable")
        least, second = (np.take_along_axis(loss, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        soft = np.exp(-4 * (loss - least[:, None]))
        score = np.where(lettered, 1 / soft.sum(axis=1), 0.0)
        return [self.languages[k] if x else "und" for k, x in zip(order[:, 0], lettered, strict=True)], score, lettered & (second - least < self.ambiguity * second)


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over rows of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                mine = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for *_, data, _starts in chargrams.layout([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for buckets in bucket_codes(data):
                        mine += np.bincount(buckets, minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", calibration_rows: int = 2000, smoothing: float = 0.5, ambiguity: float = 0.1) -> Model:
    rows = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = _counts(rows.select("lang", "text")).toPandas()  # languages x BUCKETS rows at most
    languages = sorted(counts["lang"].unique())
    code = codewords(len(languages)) if len(languages) > 1 else np.zeros((len(languages), 0), dtype=np.int8)
    table = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        mine = counts[counts["lang"] == lang]
        table[i, mine["bucket"].to_numpy()] = mine["n"].to_numpy()
    # each language counts alike in a bit, whatever its share of the rows
    share = np.stack([(table[:, k << BITS : (k + 1) << BITS]) / np.maximum(table[:, k << BITS : (k + 1) << BITS].sum(axis=1, keepdims=True), 1) for k in range(len(ORDERS))], axis=1).reshape(len(languages), -1) if languages else table
    floor = smoothing / max(table.sum(), 1) * len(ORDERS) + 1e-7
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        up, down = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log((up + floor) / (down + floor))
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.full(code.shape, 1 / max(code.shape[1], 1)), ambiguity)
    if code.shape[1]:
        sample = different_by_hash(rows, F.xxhash64("id", "lang", "text"), calibration_rows).select("lang", "text").toPandas()
        margins = model.margins(sample["text"].tolist())
        of = np.array([languages.index(x) for x in sample["lang"]])
        signs = code[of]
        model.spread = np.maximum(np.abs(margins).mean(axis=0), 1e-6) / 2
        right = np.stack([((margins * signs)[of == i] > 0).mean(axis=0) if (of == i).any() else np.ones(code.shape[1]) for i in range(len(languages))])
        model.trust = np.maximum(right, 0.01) / np.maximum(right, 0.01).sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, then lang_pred, score, ambiguous."""
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string("lang_pred string, score double, ambiguous boolean").fields)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, close = model.decide(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=schema.names)
        give_back()

    # a text column that is kept goes over once
    rows, place = (docs.select(*keep), keep.index(text_col)) if text_col in keep else (docs.select(*keep, F.col(text_col).alias("__text")), len(keep))
    return rows.mapInArrow(decide, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def identify_by_folds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Learn from the rows whose fold of 4 is not 2 and predict every row."""
    held = fold(id_col, 4) == 2
    model = fit(docs.filter(~held), text_col, lang_col, id_col, **how)
    return identify(docs.select(F.col(id_col), F.col(text_col)).withColumn("held_out", held), model, text_col, (id_col, "held_out"))
