"""Recursive filters over arrays, with their state kept between batches."""

from __future__ import annotations

import functools

import numpy as np

_BLOCK = 64
_tables: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def _finite(feed):
    """feed of the finite values only: others give NaN and leave the state as it is, whatever the batches."""

    @functools.wraps(feed)
    def run(self, x: np.ndarray) -> np.ndarray:
        ok = np.isfinite(x)
        if ok.all():
            return feed(self, x)
        out = np.full(len(x), np.nan)
        out[ok] = feed(self, x[ok])
        return out

    return run


class Linear:
    """y = a y + x, a block of _BLOCK values at a time by one matrix product; powers of a never grow."""

    def __init__(self, a: float, y: float = 0.0):
        self.a, self.y = a, y

    def state(self) -> dict:
        return {"y": float(self.y)}

    def restore(self, fields: dict) -> None:
        self.y = fields["y"]

    @_finite
    def feed(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        if self.a not in _tables:
            power = self.a ** np.arange(_BLOCK + 1)
            gap = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
            _tables[self.a] = np.where(gap >= 0, power[np.maximum(gap, 0)], 0.0), power[1:]
        matrix, decay = _tables[self.a]
        blocks = -(-len(x) // _BLOCK)
        padded = np.zeros(blocks * _BLOCK)
        padded[: len(x)] = x
        out = padded.reshape(blocks, _BLOCK) @ matrix.T
        y, ends = self.y, out[:, -1].tolist()
        before, top = np.empty(blocks), float(decay[-1])
        for k, end in enumerate(ends):
            before[k] = y
            y = end + top * y
        out = (out + before[:, None] * decay).ravel()[: len(x)]
        self.y = float(out[-1])
        return out


class Ema:
    """y = (1 - k) y + k x. seed: the mean of the first n ("sma"), or the first value ("first").

    divisor: what the sum of the seeds is divided by, if not their number.
    """

    def __init__(self, period: int, k: float | None = None, seed: str = "sma", divisor: float | None = None):
        self.k = 2 / (period + 1) if k is None else k
        self.need, self.seeds = (period if seed == "sma" else 1), []
        self.divisor = divisor or self.need
        self.filter: Linear | None = None

    def state(self) -> dict:
        return {"seeds": [float(x) for x in self.seeds], "y": None if self.filter is None else float(self.filter.y)}

    def restore(self, fields: dict) -> None:
        self.seeds, y = list(fields["seeds"]), fields["y"]
        self.filter = None if y is None else Linear(1 - self.k, y)

    @_finite
    def feed(self, x: np.ndarray) -> np.ndarray:
        """As long as x; NaN until the seed."""
        out = np.full(len(x), np.nan)
        start = 0
        if self.filter is None:
            start = min(self.need - len(self.seeds), len(x))
            self.seeds += x[:start].tolist()
            if len(self.seeds) < self.need:
                return out
            self.filter = Linear(1 - self.k, sum(self.seeds) / self.divisor)
            out[start - 1], self.seeds = self.filter.y, []
        out[start:] = self.filter.feed(self.k * x[start:])
        return out


class Tail:
    """The last n - 1 values before a batch, so that windows of n reach over batches."""

    def __init__(self, n: int):
        self.n, self.values = n, np.zeros(0)

    def windows(self, x: np.ndarray) -> tuple[int, np.ndarray]:
        """(first index of x with a full window, windows from there on)."""
        both = np.concatenate([self.values, x])
        self.values = both[max(0, len(both) - self.n + 1) :] if self.n > 1 else both[:0]
        short = max(0, self.n - 1 - (len(both) - len(x)))
        if len(both) < self.n:
            return len(x), np.zeros((0, self.n))
        return min(short, len(x)), np.lib.stride_tricks.sliding_window_view(both, self.n)

    def apply(self, x: np.ndarray, function) -> np.ndarray:
        start, windows = self.windows(x)
        out = np.full(len(x), np.nan)
        if len(windows):
            out[start:] = function(windows)
        return out


class Lagged:
    """The value n before; NaN where there is none."""

    def __init__(self, n: int):
        self.n, self.values = n, np.zeros(0)

    def feed(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.values, x])
        keep = max(0, len(both) - self.n)
        out = np.full(len(x), np.nan)
        start = max(0, self.n - len(self.values))
        if start < len(x):
            first = len(self.values) + start - self.n
            out[start:] = both[first : first + len(x) - start]
        self.values = both[keep:]
        return out


def then(filter_, x: np.ndarray) -> np.ndarray:
    """Feed what is not NaN; NaN stays."""
    out = np.full(len(x), np.nan)
    ok = ~np.isnan(x)
    if ok.any():
        out[ok] = filter_.feed(x[ok])
    return out
