"""Display metadata of the operators' outputs: pane, kind, colour, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.registry import OPERATORS

LEVEL = "struct<value:double,color:string,style:int,label:string>"
SCHEMA = f"key string, family string, pane string, kind string, color string, levels array<{LEVEL}>"
HIGH, MIDDLE, LOW = "#EF5350", "#454560", "#26A69A"
#: Reference lines drawn for bounded oscillators (value, colour, line style, text).
LEVELS = {
    "rsi": [(70.0, HIGH, 2, "OB"), (50.0, MIDDLE, 2, ""), (30.0, LOW, 2, "OS")],
    "stochastic": [(80.0, HIGH, 2, ""), (20.0, LOW, 2, "")],
    "stochrsi": [(80.0, HIGH, 2, ""), (20.0, LOW, 2, "")],
    "williams_r": [(-20.0, HIGH, 2, "OB"), (-80.0, LOW, 2, "OS")],
    "cci": [(100.0, HIGH, 2, "OB"), (-100.0, LOW, 2, "OS")],
    "mfi": [(80.0, HIGH, 2, "OB"), (20.0, LOW, 2, "OS")],
    "cmo": [(50.0, HIGH, 2, "OB"), (-50.0, LOW, 2, "OS")],
    "uo": [(70.0, HIGH, 2, "OB"), (30.0, LOW, 2, "OS")],
    "adx": [(25.0, "#787B86", 2, "Trend")],
    "chop": [(61.8, HIGH, 2, ""), (38.2, LOW, 2, "")],
}
#: Line colours of the operators that have one of their own.
COLORS = {
    "sma": "#26A69A", "ema": "#FF9800", "wma": "#E91E63", "dema": "#AB47BC", "tema": "#7B1FA2", "hma": "#00BCD4", "zlema": "#4CAF50", "kama": "#FF5722",
    "keltner": "#9C27B0", "donchian": "#FF5722", "vwap": "#FCD535", "vwma": "#FF5722", "supertrend": "#089981",
    "rsi": "#AB47BC", "cci": "#9C27B0", "williams_r": "#00BCD4", "atr": "#B71C1C", "momentum": "#FF5722", "roc": "#00BCD4", "trix": "#E91E63", "dpo": "#607D8B", "cmo": "#795548",
    "obv": "#2196F3", "mfi": "#4CAF50", "cmf": "#00BCD4", "pvt": "#9C27B0", "nvi": "#FF5722", "pvi": "#4CAF50", "eom": "#607D8B", "force_index": "#E91E63",
    "natr": "#E53935", "hv": "#7B1FA2", "stddev": "#9C27B0", "ui": "#795548",
}
#: Colours of the outputs of operators with several.
OUTPUT_COLORS = {"ichimoku": {"tenkan": "#F44336", "kijun": "#2196F3", "senkou_a": "#089981", "senkou_b": "#F23645", "chikou": "#9C27B0"}}
UP, DOWN = "#089981", "#F23645"
MAIN = ("average", "pattern", "zigzag", "hybrid")
OVER_PRICE = ("bbands", "keltner", "donchian", "chandelier")
HISTOGRAMS = ("ao", "ac")


def _row(o) -> tuple:
    pane = "main" if o.family in MAIN or o.name in OVER_PRICE else "separate"
    kind = "marker" if o.family == "pattern" else "histogram" if o.name in HISTOGRAMS else "line"
    color = UP if kind == "histogram" else "#FF9800" if o.family == "zigzag" else COLORS.get(o.name, "#2196F3")
    return o.name, o.family, pane, kind, color, LEVELS.get(o.name, [])


def series_defs(spark: SparkSession) -> DataFrame:
    """One row for each operator."""
    import barloom.operators  # noqa: F401

    return spark.createDataFrame([_row(o) for o in OPERATORS.values()], SCHEMA)


def output_defs(spark: SparkSession, name: str, outputs: list[str], pane_height: int = 120, **params) -> DataFrame:
    """One row for each output of one use: key, label with its parameters, pane, colours, levels."""
    import barloom.operators  # noqa: F401
    from barloom.registry import get

    o = get(name)
    _, family, pane, kind, color, levels = _row(o)
    numbers = [str(v) for v in (o.defaults | params).values() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    label = f"{name.upper()} ({','.join(numbers)})" if numbers else name.upper()
    rows = []
    for output in outputs:
        hist = kind == "histogram" or output == "histogram"
        own = OUTPUT_COLORS.get(name, {}).get(output, UP if hist else color)
        key = name if len(outputs) == 1 else f"{name}.{output}"
        title = label if len(outputs) == 1 else f"{label} {output}"
        rows.append((key, title, family, pane, "histogram" if hist else kind, own, UP if hist else None, DOWN if hist else None, f"pane_{name}", None if pane == "main" else pane_height, levels))
    return spark.createDataFrame(rows, "key string, label string, family string, pane string, kind string, color string, color_pos string, color_neg string, pane_id string, pane_height int, levels array<" + LEVEL + ">")
