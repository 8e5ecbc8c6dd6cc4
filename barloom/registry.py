"""The operator registry: names, defaults, keys, lookup, user-defined operators, and one call for many."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import one_per_time


def _text(value) -> str:
    return str(value).removeprefix("Column<'").removesuffix("'>") if isinstance(value, Column) else str(value)


@dataclass(frozen=True)
class Operator:
    name: str
    family: str
    function: Callable[..., DataFrame]
    defaults: dict = field(hash=False)

    def __call__(self, bars: DataFrame, **params) -> DataFrame:
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise TypeError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        return self.function(bars, **params)

    def key(self, symbol: str, tf: str, **params) -> str:
        """NAME_SYMBOL_tf_params, with the parameters in order, defaults filled in, columns by their expression."""
        values = [_text(v) for v in (self.defaults | params).values()]
        return "_".join([self.name.upper(), symbol.upper(), tf, *values])


OPERATORS: dict[str, Operator] = {}


def operator(family: str, name: str | None = None):
    """Register a function (bars, **params) -> DataFrame of symbol, tf, time and outputs.

    It is given one bar for each time of a series, by ``one_per_time``, whether it works with windows or folds.
    """

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        of = name or function.__name__
        if of in OPERATORS:
            raise ValueError(f"operator {of} is registered already")
        defaults = {k: p.default for k, p in list(inspect.signature(function).parameters.items())[1:]}

        @functools.wraps(function)
        def over_series(bars: DataFrame, *args, **kwargs) -> DataFrame:
            # a stream's folds leave out duplicates by their state
            return function(bars if bars.isStreaming else one_per_time(bars), *args, **kwargs)

        OPERATORS[of] = Operator(of, family, over_series, defaults)
        return over_series

    return register


def register_operator(name: str, function: Callable[..., DataFrame], family: str = "custom", replace: bool = False) -> Operator:
    """A user-defined operator, from built-in columns or from a fold."""
    if replace:
        OPERATORS.pop(name, None)
    operator(family, name)(function)
    return OPERATORS[name]


def register_pattern(name: str, detect: Callable[[Callable[[str, int], Column]], Column], lookback: int = 1, replace: bool = False) -> Operator:
    """A user-defined candle pattern: detect(at) is +1, -1 or 0, where at(field, k) is a field k bars back."""
    from barloom.functions.series import Series, lag

    def pattern(bars: DataFrame) -> DataFrame:
        s = Series(bars).let(signal=F.coalesce(detect(lambda field, k=0: lag(field, k)).cast("int"), F.lit(0)))
        return s.out(lookback, signal=F.col("signal"))

    return register_operator(name, pattern, "pattern", replace)


def get(name: str) -> Operator:
    try:
        return OPERATORS[name]
    except KeyError:
        raise KeyError(f"no operator {name!r}; there are {', '.join(sorted(OPERATORS))}") from None


#: What an operator is made of: the operators, with their parameters by the operator's own.
PARTS: dict[str, Callable[[dict], list[tuple[str, dict]]]] = {
    "macd": lambda p: [("ema", {"period": p[x], "value": p["value"]}) for x in ("fast", "slow")],
    "bbands": lambda p: [(x, {"period": p["period"], "value": p["value"]}) for x in ("sma", "stddev")],
    "keltner": lambda p: [("ema", {"period": p["period"], "value": p["value"]}), ("atr", {"period": p["atr_period"], "parity": p["parity"]})],
    "dema": lambda p: [("ema", {"period": p["period"], "value": p["value"]})],
    "tema": lambda p: [("ema", {"period": p["period"], "value": p["value"]})],
    "trix": lambda p: [("ema", {"period": p["period"], "value": p["value"]})],
    "hma": lambda p: [("wma", {"period": n, "value": p["value"]}) for n in (p["period"] // 2, p["period"])],
    "zscore": lambda p: [(x, {"period": p["period"], "value": p["value"]}) for x in ("sma", "stddev")],
    "atr": lambda p: [("tr", {"parity": p["parity"]})],
    "natr": lambda p: [("atr", {"period": p["period"], "parity": p["parity"]})],
    "chandelier": lambda p: [("atr", {"period": p["period"]})],
    "supertrend": lambda p: [("atr", {"period": p["period"], "parity": p["parity"]})],
    "stochrsi": lambda p: [("rsi", {"period": p["rsi"], "value": p["value"]})],
    "ac": lambda p: [("ao", {})],
    "adosc": lambda p: [("ad", {})],
    "ppo": lambda p: [("ema", {"period": p[x], "value": p["value"]}) for x in ("fast", "slow")],
    "apo": lambda p: [("ema", {"period": p[x], "value": p["value"]}) for x in ("fast", "slow")],
}


def listing() -> list[dict]:
    return [{"name": o.name, "family": o.family, "params": o.defaults} for o in OPERATORS.values()]


class Registrations:
    """Registered uses of operators: the same operator, symbol, timeframe and parameters is one entry."""

    def __init__(self):
        self._uses: dict[str, tuple[Operator, str, str, dict]] = {}
        self._counts: dict[str, int] = {}

    def add(self, name: str, symbol: str, tf: str, **params) -> str:
        op = get(name)
        key = op.key(symbol, tf, **params)
        self._uses.setdefault(key, (op, symbol, tf, params))
        self._counts[key] = self._counts.get(key, 0) + 1
        return key

    def remove(self, key: str) -> None:
        """Drop one reference; the last one removes the use."""
        self._counts[key] -= 1
        if not self._counts[key]:
            del self._counts[key], self._uses[key]

    def keys(self) -> list[str]:
        return list(self._uses)

    def info(self) -> list[dict]:
        return [{"key": k, "name": op.name, "symbol": s, "tf": tf, "params": op.defaults | p, "uses": self._counts[k]} for k, (op, s, tf, p) in self._uses.items()]

    def graph(self) -> dict[str, list[str]]:
        """Every use and what it is made of, key to keys; a part that several uses have is one node."""
        out: dict[str, list[str]] = {}

        def add(key: str, op: Operator, symbol: str, tf: str, params: dict) -> None:
            if key in out:
                return
            parts = [(get(name), p) for name, p in PARTS.get(op.name, lambda p: [])(op.defaults | params)]
            out[key] = [o.key(symbol, tf, **p) for o, p in parts]
            for (o, p), k in zip(parts, list(out[key]), strict=True):
                add(k, o, symbol, tf, p)

        for key, (op, symbol, tf, params) in self._uses.items():
            add(key, op, symbol, tf, params)
        return out

    def tree(self, source: str = "1m") -> str:
        """The graph as indented text, what nothing is made of first; each node once, with source and own timeframe."""
        graph, lines, seen = self.graph(), [], set()

        def show(key: str, depth: int, tf: str) -> None:
            if key not in seen:
                seen.add(key)
                of = f"[{tf}]" if tf == source else f"[{source} -> {tf}]"
                lines.append("  " * depth + f"- {key} {of}")
                for part in sorted(graph[key]):
                    show(part, depth + 1, tf)

        parts = {p for ps in graph.values() for p in ps}
        for key in sorted(graph):
            if key not in parts:
                show(key, 0, self._uses[key][2])
        return "\n".join(lines)

    def compute(self, bars: DataFrame) -> dict[str, DataFrame]:
        """The result of each use over its own series of bars."""
        return {k: op(bars.filter((bars["symbol"] == s) & (bars["tf"] == tf)), **p) for k, (op, s, tf, p) in self._uses.items()}
