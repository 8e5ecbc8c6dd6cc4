"""JSON frames of the wire protocol as rows: snapshot, bar, history, indicators, points, and the listing frames.

Only what carries data is built here; the transport is not part of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<time:bigint,value:double,color:string>"


def bar_json(kind: str = "bar") -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), "symbol", "tf", "time", "open", "high", "low", "close", "volume"))


def frames(bars: DataFrame, kind: str = "bar") -> DataFrame:
    return bars.select("symbol", "tf", "time", bar_json(kind).alias("payload"))


def snapshot(bars: DataFrame, size: int = 500, kind: str = "snapshot") -> DataFrame:
    """One frame per series with its last bars in time order."""
    from barloom.sources.store import recent

    bar = F.struct("time", "open", "high", "low", "close", "volume")
    grouped = recent(bars, size).groupBy("symbol", "tf").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    return grouped.select("symbol", "tf", F.to_json(F.struct(F.lit(kind).alias("type"), "symbol", "tf", "bars")).alias("payload"))


def points(results: DataFrame, name: str, outputs: list[str] | None = None, color: Column | None = None) -> DataFrame:
    """Long form (symbol, tf, series_key, time, value, color) of an operator's outputs."""
    outputs = outputs or [c for c, kind in results.dtypes if kind in ("double", "int") and c not in ("symbol", "tf", "time")]
    key = [F.lit(name if len(outputs) == 1 else f"{name}.{o}") for o in outputs]
    rows = F.explode(F.array(*[F.struct(k.alias("series_key"), F.col(o).cast("double").alias("value")) for k, o in zip(key, outputs, strict=True)]))
    paint = F.lit(None).cast("string") if color is None else color
    return results.withColumn("__color", paint).select("symbol", "tf", "time", "__color", rows.alias("p")).select("symbol", "tf", "p.series_key", "time", "p.value", F.col("__color").alias("color")).filter("value is not null and not isnan(value)")


def trend_color(up: str = "is_uptrend", bull: str = "#26a69a", bear: str = "#ef5350") -> Column:
    return F.when(F.col(up), bull).otherwise(bear)


def indicators_frame(long_points: DataFrame) -> DataFrame:
    """One frame per series and time with the values of all its indicators."""
    grouped = long_points.groupBy("symbol", "tf", "time").agg(F.map_from_entries(F.collect_list(F.struct("series_key", "value"))).alias("values"))
    return grouped.select("symbol", "tf", "time", F.to_json(F.struct(F.lit("indicators").alias("type"), "symbol", "tf", "time", "values")).alias("payload"))


def zigzag_points(results: DataFrame) -> DataFrame:
    """Pivots of a zigzag as points at the pivot bar; the label goes along as JSON in color."""
    label = F.to_json(F.struct(F.col("label").alias("label"), F.col("break_close").alias("break")))
    return results.select("symbol", "tf", F.lit("zigzag").alias("series_key"), F.col("pivot_time").alias("time"), F.col("price").alias("value"), label.alias("color"))


def definitions_frame(defs: DataFrame) -> DataFrame:
    """One frame with the display definitions of all series."""
    row = F.struct("key", "pane", "kind", "color", "levels")
    return defs.agg(F.to_json(F.struct(F.lit("definitions").alias("type"), F.array_sort(F.collect_list(row)).alias("series"))).alias("payload"))


def wire_bar() -> Column:
    """A bar as clients read it; volume only where there is some."""
    return F.struct("time", "open", "high", "low", "close", F.when(F.col("volume") != 0, F.col("volume")).alias("volume"))


def _typed(kind: str, chart_id: str | None) -> list[Column]:
    return [F.lit(kind if chart_id is None else f"chart_{kind}").alias("type"), *([] if chart_id is None else [F.lit(chart_id).alias("chartId")])]


def bar_frames(bars: DataFrame, chart_id: str | None = None) -> DataFrame:
    """A bar frame for each bar, for the main chart or one beside it."""
    return bars.select("symbol", "tf", "time", F.to_json(F.struct(*_typed("bar", chart_id), wire_bar().alias("bar"))).alias("payload"))


def history_frame(page: DataFrame, count: int, chart_id: str | None = None) -> DataFrame:
    """One frame with a page of older bars (``store.history_page``); fewer than count means that there are no more."""
    more = F.count(F.lit(1)) < count
    return page.agg(F.to_json(F.struct(*_typed("history", chart_id), F.array_sort(F.collect_list(wire_bar())).alias("data"), more.alias("noMoreHistory"))).alias("payload"))


def chart_snapshot(bars: DataFrame, chart_id: str | None = None, size: int = 500, digits: int = 2, long_points: DataFrame | None = None, defs: DataFrame | None = None) -> DataFrame:
    """A frame for each series with its last bars, its points by series key and the definitions."""
    from barloom.sources.store import recent

    out = recent(bars, size).groupBy("symbol", "tf").agg(F.array_sort(F.collect_list(wire_bar())).alias("data"))
    fields = [*_typed("snapshot", chart_id), "data", F.lit(digits).alias("digits"), "symbol", F.col("tf").alias("timeframe")]
    if long_points is not None:
        point = F.struct("time", "value", "color")
        last = recent(long_points, size, ("symbol", "tf", "series_key"))
        series = last.groupBy("symbol", "tf", "series_key").agg(F.array_sort(F.collect_list(point)).alias("points"))
        by = series.groupBy("symbol", "tf").agg(F.map_from_entries(F.collect_list(F.struct("series_key", "points"))).alias("points"))
        out, fields = out.join(by, ["symbol", "tf"], "left"), [*fields, "points"]
    if defs is not None:
        rows = [r.asDict() for r in defs.orderBy("key").collect()]  # one row an operator output
        out = out.withColumn("definitions", F.from_json(F.lit(_json(rows)), f"array<{defs.schema.simpleString()}>"))
        fields.append("definitions")
    return out.select("symbol", "tf", F.to_json(F.struct(*fields)).alias("payload"))


def _json(rows: list[dict]) -> str:
    import json

    return json.dumps(rows)


def zigzag_drawing(results: DataFrame, drawing_id: str = "zigzag", color: str = "#FCD535", width: int = 2) -> DataFrame:
    """One drawing_upsert frame a series: the pivots as the points of a line, with their labels."""
    low = F.col("label").startswith("L")
    label = F.struct(F.col("label").alias("text"), F.when(low, "\u25b2").otherwise("\u25bc").alias("icon"), F.when(low, "below").otherwise("above").alias("position"), F.when(low, "#089981").otherwise("#F23645").alias("color"))
    pivot = F.struct(F.col("pivot_time").alias("time"), F.col("price").alias("price"), label.alias("label"))
    by = results.filter("pivot_time >= 0").groupBy("symbol", "tf").agg(F.array_sort(F.collect_list(pivot)).alias("pivots"))
    drawing = F.struct(
        F.lit(drawing_id).alias("id"),
        F.lit("zigzag").alias("tool"),
        F.transform("pivots", lambda p: F.struct(p["time"].alias("time"), p["price"].alias("price"))).alias("points"),
        F.struct(F.lit(color).alias("color"), F.lit(width).alias("width")).alias("style"),
        F.lit("main").alias("paneId"),
        F.lit(True).alias("locked"),
        F.lit(True).alias("visible"),
        F.transform("pivots", lambda p: p["label"]).alias("pointLabels"),
    )
    return by.select("symbol", "tf", F.to_json(F.struct(F.lit("drawing_upsert").alias("type"), drawing.alias("drawing"))).alias("payload"))


def drawing_delete(ids: DataFrame, column: str = "id") -> DataFrame:
    """One frame that deletes the drawings of the ids."""
    return ids.agg(F.to_json(F.struct(F.lit("drawing_delete").alias("type"), F.array_sort(F.collect_set(column)).alias("drawingIds"))).alias("payload"))


def drawings_frame(drawings: DataFrame) -> DataFrame:
    """One frame for each series with all its drawings, in place of those that clients have; drawings as ``zigzag_drawing`` gives them."""
    own = F.get_json_object("payload", "$.drawing")
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(own)), ","), F.lit("]"))
    return drawings.groupBy("symbol", "tf").agg(F.concat(F.lit('{"type":"drawings","drawings":'), listed, F.lit("}")).alias("payload"))


def drawings_clear(series: DataFrame) -> DataFrame:
    """One frame for each series that removes its drawings."""
    return series.select("symbol", "tf").distinct().select("symbol", "tf", F.to_json(F.struct(F.lit("drawings_clear").alias("type"))).alias("payload"))


def indicators_list(defs: DataFrame) -> DataFrame:
    """One frame with the definitions that can be streamed, in order of their keys; defs as ``series_defs`` or ``output_defs`` give them."""
    row = F.struct("key", *[c for c in defs.columns if c != "key"])
    return defs.agg(F.to_json(F.struct(F.lit("indicators_list").alias("type"), F.array_sort(F.collect_list(row)).alias("indicators"))).alias("payload"))


def symbols_frame(rows: DataFrame) -> DataFrame:
    """One frame with the symbols that have rows, each with its timeframes."""
    by = rows.groupBy("symbol").agg(F.array_sort(F.collect_set("tf")).alias("tfs"))
    return by.agg(F.to_json(F.struct(F.lit("symbols_list").alias("type"), F.array_sort(F.collect_list(F.struct("symbol", "tfs"))).alias("symbols"))).alias("payload"))
