"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams (ORDERS) in the lower-cased text. Each has the ratio
r = log((p + a) / |p|) - log((q + a) / |q|) of its counts in toxic and clean training texts, and a logistic
regression with L2 penalty is fitted on presence * r. Fitting uses a bounded sample: of each label the
``rows_per_label`` labelled documents first in hash order, and the ``features`` n-grams of largest evidence.
Executors count the sample's n-grams and look up those chosen; the driver gets the chosen n-grams and, for
each sample row, the numbers of those it has, but no text. The intercept is corrected from the sample's
label share to the share among all labelled training documents. Every text is scored whole.

Defined results: null, empty and letterless texts have no feature but the blanks and score by those and the
intercept; with no toxic or no clean training row, all score 0 or 1; a training set without an n-gram in
LEAST_TEXTS texts scores by its label share; labels that contradict (one id, both values) both count; a
document row counts as often as it is there; of rows that tie for the sample's last place those of the
smaller text hash are taken; a null id has no label and is never held out; very long texts are scored whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import chargrams
from barloom.llm.common import slices, written
from barloom.llm.language_id import fold

ORDERS = (3, 4, 5, 6, 7, 8)
BITS = 22
LEAST_TEXTS = 3
HELD = 1 << 21


def _slots(code: np.ndarray) -> np.ndarray:
    return chargrams.hashed(code, BITS, 0)


@dataclass
class Model:
    codes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"codes": self.codes, "weights": self.weights, "bias": self.bias, "_table": None}

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in codes) of the features there, each pair once."""
        if self._table is None:
            self._table = np.zeros(1 << BITS, dtype=bool)
            self._table[_slots(self.codes)] = True
        found = [np.zeros(0, dtype=np.int64)]
        for first, _, points, starts in chargrams.layout_characters(texts) if len(self.codes) else ():
            pairs = []
            for code in chargrams.character_codes(points, ORDERS):
                at = np.flatnonzero(self._table.take(_slots(code)))
                place = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
                ok = self.codes[place] == code[at]
                text = first + np.searchsorted(starts, at[ok], side="right") - 1
                pairs.append(text * len(self.codes) + place[ok])
            found.append(np.unique(np.concatenate(pairs)))
        pair = np.concatenate(found)
        return pair // max(len(self.codes), 1), pair % max(len(self.codes), 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        text, place = self.hits(texts)
        z = self.bias + np.bincount(text, weights=self.weights[place], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression by accelerated gradient descent."""
    w, b, n = np.zeros(width), 0.0, len(y)
    vw, vb = w.copy(), b
    power = np.random.default_rng(0).random(width)
    for _ in range(8):
        power = np.bincount(columns, np.bincount(rows, power[columns] * values, n)[rows] * values, width)
        power /= max(np.linalg.norm(power), 1e-12)
    largest = float(np.square(np.bincount(rows, power[columns] * values, n)).sum())
    rate = 1 / (0.25 * (largest + n) / n + penalty)
    for k in range(steps):
        z = np.bincount(rows, vw[columns] * values, n) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        nw = vw - rate * (np.bincount(columns, g[rows] * values, width) + penalty * vw)
        nb = vb - rate * g.sum()
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(code, n, p, q): in how many toxic and clean texts of (toxic, text) each n-gram is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []

        def rows() -> pa.RecordBatch:
            code = np.concatenate([x for x, *_ in held])
            known, place = np.unique(code, return_inverse=True)
            order, toxic = (np.concatenate([np.full(len(x[0]), x[k]) for x in held]) for k in (1, 2))
            p, q = np.bincount(place, toxic, len(known)), np.bincount(place, 1 - toxic, len(known))
            of = np.zeros(len(known), dtype=np.int32)
            of[place] = order
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(of), pa.array(p.astype(np.int64)), pa.array(q.astype(np.int64))], names=["code", "n", "p", "q"])

        for batch in slices(batches, 50):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for *_, points, _starts in chargrams.layout_characters([text]):
                    held += [(np.unique(code), n, toxic) for n, code in zip(ORDERS, chargrams.character_codes(points, ORDERS), strict=False)]
                if sum(len(x) for x, *_ in held) > HELD:
                    yield rows()
        if held:
            yield rows()

    return sample.select("toxic", "text").mapInArrow(count, "code long, n int, p long, q long").groupBy("code", "n").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter(F.col("p") + F.col("q") >= LEAST_TEXTS)


def fit_sample(sample: DataFrame, features: int = 6_000, penalty: float = 1e-3, smoothing: float = 1.0) -> tuple[Model, int, int]:
    """(model, toxic rows, clean rows) of the bounded rows (toxic, text), which should be cheap to read again."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 500.0 if n_pos else -500.0), n_pos, n_neg
    a = F.lit(smoothing)
    ratio = F.log((F.col("p") + a) / (n_pos + a)) - F.log((F.col("q") + a) / (n_neg + a))
    counted = written(_gram_counts(sample).withColumn("ratio", ratio).withColumn("evidence", F.abs("ratio") * F.sqrt(F.col("p") + F.col("q"))), "grams")
    best = [counted.filter(F.col("n") == n).orderBy(F.desc("evidence"), "code").limit(features // len(ORDERS)).filter("evidence > 0").select("code", "ratio") for n in ORDERS]
    chosen = [r for part in best for r in part.collect()]  # at most features rows
    if not chosen:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(n_pos / n_neg))), n_pos, n_neg
    codes, place = np.unique(np.array([r["code"] for r in chosen], dtype=np.int64).view(np.uint64), return_index=True)
    ratios = np.array([r["ratio"] for r in chosen], dtype=float)[place]
    model = Model(codes, ratios, 0.0)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, place = model.hits(batch.column(1).to_pylist())
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32)))], names=["toxic", "has"])

    seen = sample.select("toxic", "text").mapInArrow(look_up, "toxic int, has array<int>").toPandas()  # a row of numbers for each sample row
    lengths = np.array([len(x) for x in seen["has"]], dtype=np.int64)
    columns = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, dtype=np.int64) for x in seen["has"]]])
    w, b = logistic(np.repeat(np.arange(len(seen)), lengths), columns, ratios[columns], seen["toxic"].to_numpy(dtype=float), len(codes), penalty)
    return Model(codes, w * ratios, b), n_pos, n_neg


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: int = 2000, **how) -> Model:
    """Fit on the bounded sample of the labelled rows of docs; the label is 1 or not 1, null is no label."""
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("toxic"))
    there = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    labelled = written(there.join(named, "id"), "labelled")
    shares = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}

    def first(rows: DataFrame, *order) -> DataFrame:
        return rows.filter("toxic = 1").orderBy(*order).limit(rows_per_label).unionByName(rows.filter("toxic = 0").orderBy(*order).limit(rows_per_label))

    ids = written(first(labelled, F.xxhash64("id"), "id").distinct(), "sample-ids")
    # broadcast: at most 2 * rows_per_label rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")
    sample = written(first(written(texts, "labelled-texts"), F.xxhash64("id"), "id", F.xxhash64("text")).repartition(8, "id"), "sample")
    model, n_pos, n_neg = fit_sample(sample, **how)
    if n_pos and n_neg:
        model.bias += float(np.log(shares[1] / shares[0]) - np.log(n_pos / n_neg))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, then score and predicted."""
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string("score double, predicted int").fields)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.score(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(rate, schema)


def score_by_folds(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Learn from the labels whose fold of 5 is not 0 and score every row of docs."""
    model = fit(docs, labels.filter(fold(id_col, 5) != 0), id_col, text_col, **how)
    held = F.col(id_col).isNotNull() & (fold(id_col, 5) == 0)
    return score(docs.select(F.col(id_col), F.col(text_col)).withColumn("held_out", held), model, text_col, (id_col, "held_out"))
