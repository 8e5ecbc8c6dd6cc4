"""Statistics of the last n values, each value in logarithmic or constant time whatever n is."""

from __future__ import annotations

import numpy as np

from barloom.plans.recursive import _finite


class _Ranked:
    """Counts and sums of values by rank: a Fenwick tree over all values that a batch can see."""

    def __init__(self, ranks: int):
        self.size, self.counts, self.sums = ranks, [0] * (ranks + 1), [0.0] * (ranks + 1)

    def add(self, rank: int, count: int, value: float) -> None:
        i, counts, sums, size = rank + 1, self.counts, self.sums, self.size
        while i <= size:
            counts[i] += count
            sums[i] += value
            i += i & -i

    def up_to(self, rank: int) -> tuple[int, float]:
        """(number, sum) of the values of ranks 0 to rank."""
        i, n, s, counts, sums = rank + 1, 0, 0.0, self.counts, self.sums
        while i > 0:
            n += counts[i]
            s += sums[i]
            i -= i & -i
        return n, s


class Sliding:
    """Base: the last n - 1 values are the state; ``windows`` works on them and a batch."""

    def __init__(self, n: int):
        self.n, self.values = n, np.zeros(0)

    @_finite
    def feed_values(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        both = np.concatenate([self.values, x])
        if len(both) >= self.n:
            got = self.windows(both)
            out[len(x) - len(got) :] = got
        self.values = both[max(0, len(both) - self.n + 1) :].copy() if self.n > 1 else both[:0]
        return out

    def feed(self, x):
        return (self.feed_values(x),)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """One value for each full window of x."""
        raise NotImplementedError

    def ranked(self, x: np.ndarray, ask) -> np.ndarray:
        """ask(tree, rank of the newest value, place of the window) for each full window."""
        _, ranks = np.unique(x, return_inverse=True)
        ranks, values, n = ranks.tolist(), x.tolist(), self.n
        tree = _Ranked(max(ranks) + 1)
        for i in range(n - 1):
            tree.add(ranks[i], 1, values[i])
        out = []
        for i in range(n - 1, len(values)):
            tree.add(ranks[i], 1, values[i])
            out.append(ask(tree, ranks[i], i - n + 1))
            tree.add(ranks[i - n + 1], -1, -values[i - n + 1])
        return np.array(out)


def means(x: np.ndarray, n: int) -> np.ndarray:
    """The mean of each window; sums run from the middle of the values, so that they stay small."""
    middle = float(x.mean())
    total = np.concatenate([[0.0], np.cumsum(x - middle)])
    return (total[n:] - total[:-n]) / n + middle


def maxima(x: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each window, by running maxima of blocks from both sides."""
    blocks = -(-len(x) // n)
    padded = np.full(blocks * n, -np.inf)
    padded[: len(x)] = x
    forward = np.maximum.accumulate(padded.reshape(blocks, n), axis=1).ravel()
    backward = np.maximum.accumulate(padded.reshape(blocks, n)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(backward[: len(x) - n + 1], forward[n - 1 : len(x)])


class NotAbove(Sliding):
    """Per cent of the window, the newest value included, that is not above the newest."""

    def windows(self, x):
        return self.ranked(x, lambda tree, rank, _: tree.up_to(rank)[0]) * 100.0 / self.n


class Deviation(Sliding):
    """(newest value, mean, mean absolute deviation) as three outputs."""

    def feed(self, x):
        out = np.full((2, len(x)), np.nan)
        ok = np.isfinite(x)
        kept = x[ok]
        both = np.concatenate([self.values, kept])
        if len(both) >= self.n:
            got = self._both(both)
            full = np.full((2, len(kept)), np.nan)
            full[:, len(kept) - got.shape[1] :] = got
            out[:, ok] = full
        self.values = both[max(0, len(both) - self.n + 1) :].copy() if self.n > 1 else both[:0]
        return np.where(np.isnan(out[0]), np.nan, x), out[0], out[1]

    def _both(self, x: np.ndarray) -> np.ndarray:
        mean, middle, n = means(x, self.n), float(x.mean()), self.n
        # the rank below which values are under the mean
        under = (np.searchsorted(np.unique(x), mean, side="left") - 1).tolist()
        centred, low = (mean - middle).tolist(), x - middle

        def ask(tree, _, i):
            count, total = tree.up_to(under[i])
            return 2.0 * (centred[i] * count - total)

        # the sum of distances is twice that of the values under the mean
        return np.array([mean, np.maximum(self.ranked(low, ask), 0.0) / n])


class Drop(Sliding):
    """Root mean square drop, in per cent, from the highest value of the window."""

    #: Windows of up to so many values are summed one by one, which loses no digits.
    SHORT = 64

    def windows(self, x):
        top = maxima(x, self.n)
        if self.n <= self.SHORT:
            square = ((np.lib.stride_tricks.sliding_window_view(x, self.n) - top[:, None]) ** 2).mean(axis=1)
        else:
            middle = float(x.mean())
            low, high = (x - middle).astype(np.longdouble), (top - middle).astype(np.longdouble)
            one, two = (np.concatenate([[0.0], np.cumsum(v)]) for v in (low, low * low))
            one, two = one[self.n :] - one[: -self.n], two[self.n :] - two[: -self.n]
            square = np.maximum(two / self.n - 2 * high * one / self.n + high * high, 0.0).astype(float)
        return np.divide(100 * np.sqrt(square), np.abs(top), out=np.full(len(top), np.nan), where=top != 0)
