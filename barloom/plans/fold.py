"""The recursion kernel: a fold over each series in time order, in batch and in streams.

A fold is a class whose instances hold the state of one series; ``feed(*arrays)`` takes the next values of
each input and returns one array per output, NaN while there is none. In batch a row number over the series
deals and sorts the bars, without a shuffle or sort where a window before has done so already, and Arrow
batches run through with the state carried over, so no series is ever held whole, however long. Within ``resuming``
a fold goes on from states of an earlier run and gives out new ones at the ends of spans of time. In a stream the
state is a typed value of the state store (``plans.state``), kept for several ends of spans, so that
a late bar is replayed from the nearest one before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from barloom.functions.series import _series
from barloom.plans.state import STATE_FIELDS, STATE_SCHEMA, flat, get_state, nested, set_state

#: Bars of a series between two kept states in a stream, and how many such states and stretches of bars are kept.
STREAM_SPAN, STREAM_SPANS = 256, 4


@dataclass
class Resume:
    """Where the folds of a plan start and what they leave.

    states: symbol, tf, time and the fields of STATE_SCHEMA, one row for each series that goes on; bars up to that time are
    not fed. span: seconds of time after which a state is given out, as at the end of the series. After the operator has been
    called, ``left`` has those states, and ``raw`` the persisted rows of both kinds.
    """

    states: DataFrame | None
    span: int
    left: DataFrame | None = None
    raw: DataFrame | None = None
    makers: list[tuple] = field(default_factory=list)


_resume: Resume | None = None
_scan = None


@contextmanager
def resuming(states: DataFrame | None, span: int) -> Iterator[Resume]:
    global _resume
    before, _resume = _resume, Resume(states, span)
    try:
        yield _resume
    finally:
        _resume = before


KINDS = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}


@contextmanager
def scanning(scan) -> Iterator[None]:
    """Within it, a fold over spans runs as the scan (``plans.spans``); rows tell by ``__own`` which are no halo."""
    global _scan
    before, _scan = _scan, scan
    try:
        yield
    finally:
        _scan = before


def _typed(values, kind: str, ok: np.ndarray) -> pa.Array:
    if kind == "double":
        return pa.array(np.asarray(values, dtype=float)[ok])
    if kind == "boolean":
        return pa.array(np.asarray(values, dtype=float)[ok] != 0)
    return pa.array([v for v, keep in zip(values, ok, strict=True) if keep], KINDS[kind])


def _ready(out: tuple, kinds: list[str]) -> np.ndarray:
    ok = None
    for values, kind in zip(out, kinds, strict=True):
        mine = ~np.isnan(np.asarray(values, dtype=float)) if kind in ("double", "boolean") else np.array([v is not None for v in values], dtype=bool)
        ok = mine if ok is None else ok & mine
    return ok


def fold(bars: DataFrame, inputs: dict[str, Column], outputs: tuple[str, ...], make, *params, kinds: dict[str, str] | None = None) -> DataFrame:
    """symbol, tf, time and outputs of make(*params) over the inputs, where all outputs are there.

    One bar of a series and time is fed; operators choose which by ``one_per_time``. bars may be a stream: see ``_streaming``.
    """
    kind = [(kinds or {}).get(o, "double") for o in outputs]
    rows = bars.select("symbol", "tf", "time", *[c.alias(f"__{k}") for k, c in inputs.items()])
    schema = T.StructType([*rows.schema.fields[:3], *[T.StructField(o, T._parse_datatype_string(k)) for o, k in zip(outputs, kind, strict=True)]])
    if bars.isStreaming:
        return _streaming(rows, schema, kind, make, params)
    if _scan is not None:
        return _scan.run(bars.select(*rows.columns[:3], *[c.alias(f"in_{k}") for k, c in inputs.items()], "__own"), schema, kind, make, params)
    if _resume is not None:
        _resume.makers.append((make, params, len(inputs)))
        return _resumed(rows, schema, kind, make, params, _resume)
    rows = bars.select(*rows.columns[:3], *[c.alias(f"__{k}") for k, c in inputs.items()], F.row_number().over(_series()).alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of, last = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for b, e in zip(edges, edges[1:], strict=False):
                if keys[b] != of or state is None:
                    state, of, last = make(*params), keys[b], None
                part = batch.slice(b, e - b)
                new = np.ones(e - b, dtype=bool)
                new[1:] = pc.not_equal(part.column(2).slice(1), part.column(2).slice(0, e - b - 1)).to_numpy(zero_copy_only=False)
                new[0] = part.column(2)[0].as_py() != last
                last = part.column(2)[e - b - 1].as_py()
                part = part if new.all() else part.filter(pa.array(new))
                out = state.feed(*[c.to_numpy(zero_copy_only=False) for c in part.columns[3:-1]])
                ok = _ready(out, kind)
                if len(ok) and ok.any():
                    keep = pa.array(ok)
                    yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in part.columns[:3]), *(_typed(o, k, ok) for o, k in zip(out, kind, strict=True))], names=schema.names)

    # the row number is handed over, so that the window stays in the plan
    return rows.mapInArrow(run, schema)


NO_SPAN = np.iinfo(np.int64).min


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _seconds(rows: DataFrame) -> Column:
    return F.col("time") if dict(rows.dtypes)["time"] in ("bigint", "int") else F.unix_timestamp("time")


def _resumed(rows: DataFrame, schema: T.StructType, kind: list[str], make, params, resume: Resume) -> DataFrame:
    """Outputs of the bars after the states, as ``fold``; the states at ends of spans go to ``resume.left``."""
    state = T._parse_datatype_string(STATE_SCHEMA)
    nothing = F.lit(None).cast(state)
    fed = rows.withColumns({"__span": F.floor(_seconds(rows) / resume.span), "__state": nothing, "__first": F.lit(1)})
    if resume.states is not None:
        start = resume.states.select("symbol", "tf", F.col("time").alias("__since"), F.struct(*STATE_FIELDS).alias("__start"))
        fed = fed.join(start.select("symbol", "tf", "__since"), ["symbol", "tf"], "left").filter(F.col("__since").isNull() | (F.col("time") > F.col("__since"))).drop("__since")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[3:]]
        fed = fed.unionByName(start.select("symbol", "tf", F.col("__since").alias("time"), *empty, F.lit(None).cast("long").alias("__span"), F.col("__start").alias("__state"), F.lit(0).alias("__first")))
    order = fed.withColumn("__row", F.row_number().over(_series())).withColumn("__next", F.lead("__span").over(_series()))
    n = len(rows.columns)
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema.fields], T.StructField("__state", state)])
    arrow_state = pa.struct([("version", pa.int32()), *[(f, pa.map_(pa.string(), t)) for f, t in (("numbers", pa.float64()), ("integers", pa.int64()), ("flags", pa.bool_()), ("texts", pa.string()), ("arrays", pa.list_(pa.float64())))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold_, of, last = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            spans, following = (pc.fill_null(batch.column(k), NO_SPAN).to_numpy() for k in (n, n + 4))
            first, at = batch.column(n + 2).to_numpy(), batch.column(2).cast(pa.int64()).to_numpy()
            # a run ends with its series, with a span, or where a state stands
            cuts = _changes(batch.column(0)) | _changes(batch.column(1)) | (spans[1:] != spans[:-1]) | (first[1:] == 0)
            edges = [0, *(np.flatnonzero(cuts) + 1).tolist(), batch.num_rows]
            for b, e in zip(edges, edges[1:], strict=False):
                key = batch.column(0)[b].as_py(), batch.column(1)[b].as_py()
                if key != of or fold_ is None:
                    fold_, of, last = make(*params), key, None
                if first[b] == 0:
                    started = batch.column(n + 1)[b].as_py()
                    set_state(fold_, nested(tuple(dict(started[f]) if isinstance(started[f], list) else started[f] for f in STATE_FIELDS)))
                    b += 1
                    if b == e:
                        continue
                part = batch.slice(b, e - b)
                keep = np.append(at[b] != last, at[b + 1 : e] != at[b : e - 1])
                last = at[e - 1]
                part = part if keep.all() else part.filter(pa.array(keep))
                if part.num_rows:
                    got = fold_.feed(*[c.to_numpy(zero_copy_only=False) for c in part.columns[3:n]])
                    ok = _ready(got, kind)
                    if ok.any():
                        chosen = pa.array(ok)
                        yield pa.RecordBatch.from_arrays([*(c.filter(chosen) for c in part.columns[:3]), *(_typed(o, k, ok) for o, k in zip(got, kind, strict=True)), pa.nulls(int(ok.sum()), arrow_state)], names=out.names)
                if following[e - 1] != spans[e - 1]:
                    version, *maps = flat(get_state(fold_))
                    row = {"version": version} | {f: list(m.items()) for f, m in zip(STATE_FIELDS[1:], maps, strict=True)}
                    end = batch.slice(e - 1, 1)
                    yield pa.RecordBatch.from_arrays([*end.columns[:3], *[pa.nulls(1, KINDS[k]) for k in kind], pa.array([row], arrow_state)], names=out.names)

    resume.raw = order.mapInArrow(run, out).persist()
    resume.left = resume.raw.filter("__state is not null").select("symbol", "tf", "time", "__state.*")
    return resume.raw.filter("__state is null").drop("__state")


class _Fold(StatefulProcessor):
    """The fold of one series in a stream.

    Kept are the last bars and the states before them, one for each STREAM_SPAN bars. New bars that come late, or again
    with other values, take their place among the kept ones, and the fold is replayed from the nearest state before
    them: every point from there on comes out anew, and a replayed time without an output comes out with nulls, so that
    an upsert by time leaves the result that the batch gives. Bars older than all kept ones are left out.
    """

    def __init__(self, schema: T.StructType, kind: list[str], make, params):
        self.schema, self.kind, self.make, self.params = schema, kind, make, params

    def init(self, handle) -> None:
        self.kept = handle.getValueState("bars", "times array<bigint>, inputs array<array<double>>")
        self.states = handle.getListState("states", f"time bigint, {STATE_SCHEMA}")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("time", kind="stable").drop_duplicates("time", keep="last")
        stamped = not pd.api.types.is_integer_dtype(new["time"])
        at = new["time"].astype("datetime64[us]").astype("int64") if stamped else new["time"]
        fresh = dict(zip(at.tolist(), new.iloc[:, 3:].to_numpy(dtype=float).tolist(), strict=True))
        times, inputs = ([], []) if not self.kept.exists() else map(list, self.kept.get())
        states = [(int(t), tuple(state)) for t, *state in self.states.get()]
        bars = dict(zip((int(t) for t in times), (list(x) for x in inputs), strict=True))
        if states:  # the oldest state stands before all kept bars
            fresh = {t: x for t, x in fresh.items() if t > states[0][0]}
        fresh = {t: x for t, x in fresh.items() if bars.get(t) != x}
        if not fresh:
            return
        newest, changed = max(bars, default=None), min(fresh)
        bars |= fresh
        order = sorted(bars)
        states = [s for s in states if s[0] < changed]
        fold_ = self.make(*self.params)
        if states:
            set_state(fold_, nested(states[-1][1]))
        todo = order[bisect_left(order, states[-1][0] + 1) if states else 0 :]
        out = []
        for b in range(0, len(todo), STREAM_SPAN):
            part = todo[b : b + STREAM_SPAN]
            out.append(fold_.feed(*np.array([bars[t] for t in part], dtype=float).T))
            states.append((part[-1], flat(get_state(fold_))))
        states = states[-STREAM_SPANS - 1 :]
        order = [t for t in order if t > states[0][0]] if len(states) > STREAM_SPANS else order
        self.kept.update((order, [bars[t] for t in order]))
        self.states.put([(t, *state) for t, state in states])
        got = tuple(np.concatenate([np.asarray(o[k], dtype=None if kind in ("string", "long") else float) for o in out]) for k, kind in enumerate(self.kind))
        ok = _ready(got, self.kind)
        when = np.array(todo)
        shown = ok | (when <= newest if newest is not None else False)
        shown &= when >= changed
        frame = pd.DataFrame({"symbol": key[0], "tf": key[1], "time": pd.to_datetime(when, unit="us") if stamped else when})
        for name, values, kind in zip(self.schema.names[3:], got, self.kind, strict=True):
            frame[name] = pd.array(_typed(values, kind, np.ones(len(ok), dtype=bool)).to_pylist(), dtype=object)
            frame.loc[~ok, name] = None
        frame = frame[shown]
        if len(frame):
            yield frame

    def close(self) -> None:
        pass


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _streaming(rows: DataFrame, schema: T.StructType, kind: list[str], make, params) -> DataFrame:
    """The fold as a stateful operator; its typed state needs the RocksDB provider, which is set where none is chosen."""
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("symbol", "tf").transformWithStateInPandas(_Fold(schema, kind, make, params), schema, "Append", "None")
