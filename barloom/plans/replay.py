"""Recomputing an operator over stored bars from a time on: new bars, late ones and changed ones alike.

A fold goes on from the nearest state before that time, a window operator from as many bars before it as it looks
back, and an operator over all bars of the past starts at the first. Every point from that time on is written
anew and points that no longer exist are removed, so that the store holds what one run over all its bars gives.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import probing
from barloom.plans.fold import resuming
from barloom.plans.state import STATE_FIELDS
from barloom.sources.store import BAR, SPAN_SECONDS, BarStore, check_component

KEYS = ("symbol", "tf", "time")


def needs(operator: Callable[[DataFrame], DataFrame], bars: DataFrame) -> tuple[float, bool]:
    """(bars that an output depends on beside a fold's state, whether there is a fold); nothing runs."""
    with probing() as found, resuming(None, SPAN_SECONDS) as resume:
        operator(bars.limit(0))
    if resume.raw is not None:
        resume.raw.unpersist()
    return found.total, resume.raw is not None


def replay(store: BarStore, exchange: str, symbol: str, tf: str, key: str, operator: Callable[[DataFrame], DataFrame], since: int | None) -> DataFrame | None:
    """Write the operator's points of the series from since (unix seconds; None: from the first bar) into the store.

    The points come back, None where there are no bars; the states that the fold leaves are kept in the store.
    """
    symbol = check_component(symbol)
    rows = store.rows(exchange, symbol, tf).filter(F.col("open").isNotNull()).select("symbol", "tf", "time", *BAR)
    bars = lambda part: part.withColumn("time", F.timestamp_seconds("time"))
    back, folds = needs(operator, bars(rows))
    states = None
    if since is not None and folds and back < math.inf:
        states = store.fold_states(key).filter((F.col("time") < since) & F.col("version").isNotNull()).orderBy(F.desc("time")).limit(1)
        found = states.first()
        begin, states = (None, None) if found is None else (found["time"], store.spark.createDataFrame([(symbol, tf, *found)], "symbol string, tf string, " + states._jdf.schema().toDDL()))
    else:
        begin = None if since is None or back == math.inf else since - 1
    mine = rows
    if begin is not None:
        before = rows.filter(F.col("time") <= begin).orderBy(F.desc("time")).limit(int(back))
        mine = rows.filter(F.col("time") > begin).unionByName(before) if back else rows.filter(F.col("time") > begin)
    mine = mine.persist()
    try:
        last = mine.agg(F.max("time")).first()[0]
        if last is None or (since is not None and last < since):
            return None
        first = -(1 << 62) if since is None else since
        with resuming(None if states is None else states.withColumn("time", F.timestamp_seconds("time")), SPAN_SECONDS) as resume:
            points = operator(bars(mine)).filter(F.unix_timestamp("time") >= first)
        outputs = [c for c in points.columns if c not in KEYS]
        store.rewrite(mine.filter(F.col("time") >= first).select(*KEYS), points.withColumn("time", F.unix_timestamp("time")), exchange, key, outputs)
        left = None if resume.left is None or back == math.inf else resume.left.select(F.unix_timestamp("time").alias("time"), *STATE_FIELDS)
        store.keep_fold_states(key, first, last, left)
        # listeners read the points again: they come from the store, not from the plan
        return store.points(exchange, symbol, tf, key, outputs, dict(points.dtypes), first)
    finally:
        mine.unpersist()
        if "resume" in locals() and resume.raw is not None:
            resume.raw.unpersist()


def replay_all(store: BarStore, exchange: str, tf: str, uses: dict[str, Callable[[DataFrame], DataFrame]], since: DataFrame) -> None:
    """``replay`` of several operators, by key, over many series: since has symbol and since (unix seconds).

    Jobs are as many for a thousand series as for one, and one write takes the points of all uses. States of folds
    are kept by series (``BarStore.series_states``).
    """
    since = since.select(F.upper(F.trim("symbol")).alias("symbol"), F.col("since").cast("long").alias("since")).persist()
    rows = store.rows(exchange, tf=tf).filter(F.col("open").isNotNull()).select("symbol", "tf", "time", *BAR).join(F.broadcast(since), "symbol")
    bars = lambda part: part.select("symbol", "tf", F.timestamp_seconds("time").alias("time"), *BAR)
    written, left, kept = {}, {}, []
    try:
        for key, operator in uses.items():
            back, folds = needs(operator, bars(rows))
            states, mine, bounded = None, rows, back < math.inf
            if bounded and folds:
                states = store.series_states(key)
                if states is not None:
                    before = states.join(F.broadcast(since), "symbol").filter((F.col("tf") == tf) & (F.col("time") < F.col("since")) & F.col("version").isNotNull())
                    states = before.groupBy("symbol", "tf").agg(F.max_by(F.struct("time", *STATE_FIELDS), "time").alias("s")).select("symbol", "tf", "s.*").persist()
                    kept.append(states)
                    mine = rows.join(F.broadcast(states.select("symbol", F.col("time").alias("begin"))), "symbol", "left")
            elif bounded:
                mine = rows.withColumn("begin", F.col("since") - 1)
            if "begin" in mine.columns:
                after = mine.filter(F.col("begin").isNull() | (F.col("time") > F.col("begin")))
                newest = F.row_number().over(Window.partitionBy("symbol", "tf").orderBy(F.desc("time")))
                mine = after.unionByName(mine.filter("time <= begin").withColumn("__r", newest).filter(F.col("__r") <= int(back)).drop("__r")) if back else after
            with resuming(None if states is None else states.withColumn("time", F.timestamp_seconds("time")), SPAN_SECONDS) as resume:
                points = operator(bars(mine))
            if resume.raw is not None:
                kept.append(resume.raw)
            if resume.left is not None and bounded:
                left[key] = resume.left.select("symbol", "tf", F.unix_timestamp("time").alias("time"), *STATE_FIELDS)
            outputs = [c for c in points.columns if c not in KEYS]
            points = points.withColumn("time", F.unix_timestamp("time")).join(F.broadcast(since), "symbol").filter("time >= since")
            written[key] = points, outputs
        # states go first: the write to the store drops what is cached of its bars
        for key, new in left.items():
            store.keep_series_states(key, tf, since, new)
        store.rewrite_all(rows.filter("time >= since"), written, exchange)
    finally:
        for df in (since, *kept):
            df.unpersist()
