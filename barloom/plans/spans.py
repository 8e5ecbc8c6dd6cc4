"""One long series on many tasks: operators over spans of a series in place of the whole.

A series is cut into spans of a fixed number of bars; each is a series of its own to the operator, led by a halo
of the bars before it, as many as the operator looks back. Bars are numbered by counts of slots of time, so that
no window spans a series.

Folds whose filters are affine in their state (``layers`` of a fold names them, a layer may depend on those
before it) run as an associative scan. Each span is run from zero and from each unit state of a layer; that
gives the affine step (matrix, vector) which takes the span's first state to its last. A prefix over the steps of
a series, one row a span, gives every span's first state. With the states of all layers
known, each span is run once more for its outputs. What else a fold holds (lags, counts) is right after the halo, or set by its
``started``.

Sums over all bars so far are sums within the span and the totals of the spans before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.series import one_per_time, probing
from barloom.plans import fold as folds
from barloom.session import shared_folder

#: Bars of a span, and seconds of a slot of time in which bars are numbered by a window.
SPAN_BARS = 65_536
SLOT_SECONDS = 86_400
MARK = "\x1f"
MOST_WARM_UP = 1 << 16


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(bars: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One bar for each time, with n, its number in its series from 1 on, and __total, the series' bars."""
    seconds = F.col("time") if dict(bars.dtypes)["time"] in ("bigint", "int") else F.unix_timestamp("time")
    slotted = bars.withColumn("__slot", F.floor(seconds / slot_seconds))
    # the slot stands in the key of the series, so that windows are over slots
    key = F.concat_ws(MARK, "tf", "__slot")
    ones = one_per_time(slotted.withColumn("__tf", F.col("tf")).withColumn("tf", key))
    placed = ones.withColumn("__r", F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("time")))
    counts = ones.groupBy("symbol", "__tf", "tf", "__slot").agg(F.count(F.lit(1)).alias("__count"))
    before = Window.partitionBy("symbol", "__tf").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("symbol", "tf", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__start"), F.sum("__count").over(Window.partitionBy("symbol", "__tf")).alias("__total"))
    return placed.join(starts, ["symbol", "tf"]).withColumn("n", (F.col("__start") + F.col("__r")).cast("long")).withColumn("tf", F.col("__tf")).drop("__slot", "__tf", "__r", "__start")


def spans(bars: DataFrame, halo: int, span_bars: int) -> DataFrame:
    """The bars with tf naming the span too, halo bars of the span before among them; __own tells which are not halo."""
    place = (F.col("n") - 1) % span_bars
    of = F.floor((F.col("n") - 1) / span_bars)
    following = (place >= span_bars - halo) & ((of + 1) * span_bars < F.col("__total"))
    of = F.when(following, F.array(of, of + 1)).otherwise(F.array(of)) if halo else F.array(of)
    dealt = bars.withColumn("__of", F.floor((F.col("n") - 1) / span_bars)).withColumn("__span", F.explode(of)).withColumn("__own", F.col("__of") == F.col("__span"))
    return dealt.withColumn("tf", F.concat_ws(MARK, "tf", "__span")).drop("n", "__total", "__of", "__span")


def warm_up(make, params, inputs: int) -> int:
    """After how many bars all filters of a fold are under way: that of its first output, and one."""
    rng, n = np.random.default_rng(0), 64
    while n <= MOST_WARM_UP:
        out = make(*params).feed(*(1 + rng.random(n) for _ in range(inputs)))
        ready = np.flatnonzero(folds._ready(out, ["double"] * len(out)))
        if len(ready):
            return int(ready[0]) + 2
        n *= 4
    raise ValueError("the fold gives nothing")


def _values(layer) -> np.ndarray:
    return np.array([e.filter.y for e in layer], dtype=float)


def _put(layer, values) -> None:
    for e, y in zip(layer, values, strict=True):
        e.filter.y = float(y)


class Scan:
    """What ``fold`` does within ``over_spans``: the affine scan of its rows by spans."""

    def __init__(self, warm: int, bundle: int = 1):
        self.warm, self.bundle = warm, bundle  # bundle: short spans that one Python call takes, one after the other

    def _begun(self, pdf: pd.DataFrame, make, params, n: int):
        """(fold, its inputs) at the first own bar of a span; warmed up on the halo, or fresh in a first span."""
        own = int(np.argmax(pdf["__own"].to_numpy()))
        arrays = [pdf.iloc[:, k].to_numpy(dtype=float) for k in range(3, 3 + n)]
        fold = make(*params)
        if own:
            fold.feed(*[a[max(0, own - self.warm) : own] for a in arrays])
        return fold, [a[own:] for a in arrays], own

    def run(self, rows: DataFrame, schema: T.StructType, kind: list[str], make, params) -> DataFrame:
        n = len(rows.columns) - 4
        example = make(*params)
        if not hasattr(example, "layers"):
            raise ValueError(f"{type(example).__name__} has no affine state")
        split = F.split("tf", MARK)
        series, span = F.element_at(split, 1), F.element_at(split, 2).cast("long")
        bundled = ("symbol", "__series", "__bundle")
        in_bundles = lambda df: df.withColumns({"__series": series, "__bundle": F.floor(span / self.bundle)}).groupBy(*bundled)
        rows = _written(rows, "spans")
        starts: DataFrame | None = None
        known = "symbol string, tf string, starts array<double>"

        def by_span(of_span):
            def run(pdf: pd.DataFrame, starts_: pd.DataFrame) -> pd.DataFrame:
                states = dict(zip(starts_["tf"], starts_["starts"], strict=True))
                ordered = pdf.sort_values(["tf", "time"], ignore_index=True)
                return pd.concat([of_span(part, states.get(tf)) for tf, part in ordered.groupby("tf", sort=False)], ignore_index=True)

            return run

        def at_start(fold, values, layers: int) -> None:
            """Put the known states of the first layers."""
            if values is not None:
                at = 0
                for layer in fold.layers()[:layers]:
                    _put(layer, values[at : at + len(layer)])
                    at += len(layer)

        def stepped(level: int):
            def step(pdf: pd.DataFrame, known_start) -> pd.DataFrame:
                fold, inputs, own = self._begun(pdf, make, params, n)
                size = len(fold.layers()[level])
                if not own:  # the first span has its states from its own bars
                    fold.feed(*inputs)
                    first = [e.filter.y if e.filter is not None else math.nan for e in fold.layers()[level]]
                    return pd.DataFrame({"symbol": pdf["symbol"][:1], "tf": pdf["tf"][:1], "matrix": [[0.0] * size * size], "vector": [first]})
                ends = []
                for unit in [np.zeros(size), *np.eye(size)]:
                    fold, inputs, _ = self._begun(pdf, make, params, n)
                    at_start(fold, known_start, level)
                    _put(fold.layers()[level], unit)
                    fold.feed(*inputs)
                    ends.append(_values(fold.layers()[level]))
                matrix = (np.array(ends[1:]) - ends[0]).T
                return pd.DataFrame({"symbol": pdf["symbol"][:1], "tf": pdf["tf"][:1], "matrix": [matrix.ravel().tolist()], "vector": [ends[0].tolist()]})

            return by_span(step)

        def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
            """The steps of a series one after the other: the state before each span, with those of the layers before."""
            pdf, state, out = pdf.sort_values("span", ignore_index=True), None, []
            for matrix, vector, old in zip(pdf["matrix"], pdf["vector"], pdf["starts"], strict=True):
                vector = np.array(vector, dtype=float)
                out.append([] if state is None else [*([] if old is None else old), *state])
                state = vector if state is None else np.array(matrix, dtype=float).reshape(len(vector), -1) @ state + vector
            return pd.DataFrame({"symbol": pdf["symbol"], "tf": pdf["tf"], "starts": out})

        empty = rows.sparkSession.createDataFrame([], known)
        for level in range(len(example.layers())):
            have = empty if starts is None else starts
            steps = in_bundles(rows).cogroup(in_bundles(have)).applyInPandas(stepped(level), "symbol string, tf string, matrix array<double>, vector array<double>")
            joined = steps.join(have, ["symbol", "tf"], "left").withColumns({"series": series, "span": span})
            starts = _written(joined.groupBy("symbol", "series").applyInPandas(prefix, known), "starts").filter(F.size("starts") > 0)

        def last(pdf: pd.DataFrame, known_start) -> pd.DataFrame:
            fold, inputs, own = self._begun(pdf, make, params, n)
            if own:
                at_start(fold, known_start, len(fold.layers()))
                if hasattr(fold, "started"):
                    fold.started()
            got = fold.feed(*inputs)
            ok = folds._ready(got, kind)
            out = pdf.iloc[own:, :3][ok].copy()
            for name, values in zip(schema.names[3:], got, strict=True):
                out[name] = np.asarray(values)[ok]
            return out

        return in_bundles(rows).cogroup(in_bundles(starts)).applyInPandas(by_span(last), schema)


def over_spans(operator: Callable[[DataFrame], DataFrame], bars: DataFrame, span_bars: int = SPAN_BARS, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """operator(bars), with the work of a series spread over its spans.

    bars may be ``numbered`` already, once for several operators. For operators of windows, folds with ``layers``, and running sums; ValueError for those that need all bars otherwise.
    """
    with probing() as found, folds.resuming(None, 1) as resume:
        operator(bars.limit(0))
    sums = found.sums and not found.beyond
    if found.beyond or (sums and resume.makers):
        raise ValueError("the operator looks at all bars before")
    if resume.raw is not None:
        resume.raw.unpersist()
    if len(resume.makers) > 1:
        raise ValueError("more than one fold")
    warm = warm_up(*resume.makers[0]) if resume.makers else 0
    halo = int(found.bars) + warm + int(sums) + 1
    cut = spans(bars if "__total" in bars.columns else numbered(bars, slot_seconds), halo, max(span_bars, halo))
    cut = _written(cut, "bars")
    if resume.makers:
        with folds.scanning(Scan(warm, max(1, SPAN_BARS // max(span_bars, halo)))):
            out = operator(cut)
    else:
        out = operator(cut.drop("__own"))
    outputs = [c for c in out.columns if c not in ("symbol", "tf", "time")]
    if not resume.makers:
        own = cut.filter("__own").groupBy("symbol", "tf").agg(F.min("time").alias("__first"))
        out = out.join(own, ["symbol", "tf"])
        if sums:
            out = _written(out, "sums")
            of_span = F.element_at(F.split("tf", MARK), 2).cast("long")
            ends = out.groupBy("symbol", "tf", of_span.alias("span")).agg(*[F.max_by(c, "time").alias(f"end_{c}") for c in outputs], *[F.max_by(c, F.when(F.col("time") < F.col("__first"), F.col("time"))).alias(f"halo_{c}") for c in outputs])
            before = Window.partitionBy("symbol", F.element_at(F.split("tf", MARK), 1)).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
            shift = [(F.coalesce(F.sum(F.col(f"end_{c}") - F.coalesce(f"halo_{c}", F.lit(0.0))).over(before), F.lit(0.0)) - F.coalesce(f"halo_{c}", F.lit(0.0))).alias(f"shift_{c}") for c in outputs]
            out = out.join(ends.select("symbol", "tf", *shift), ["symbol", "tf"]).withColumns({c: F.col(c) + F.col(f"shift_{c}") for c in outputs})
        out = out.filter(F.col("time") >= F.col("__first"))
    return out.select("symbol", F.element_at(F.split("tf", MARK), 1).alias("tf"), "time", *outputs)
