"""Zigzag of channel breaks: a transition table over the place of each close in a channel.

Prices are looked at through the channel's direction: times +1 while it rises and times -1 while it falls, so
one set of rules serves both. A channel has a lead bar with its foot (open) and head (close), and a floor,
the open of the nearest earlier bar of the channel's colour under the lead's foot. A close is OVER the head,
WITHIN foot and head, or UNDER the foot. In the calm state a close of the channel's colour over the head is
the new lead, one within marks the channel as nested, and one under foot or floor alarms. In the alarmed
state the other colour under the floor turns the channel round, which is a pivot; the channel's own
colour back over the foot (or head, if lower) ends the alarm; all else waits.

The first pivot is L or H, later ones LL or LH and HH or HL by the open of the pivot before the last (the last
while there is one only). Bars whose body is not larger than ``min_accept_size`` decide nothing.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.plans.fold import fold
from barloom.registry import operator

O, H, L, C, T = range(5)
OVER, WITHIN, UNDER = "over", "within", "under"
LEAD, NEST, TURN, RETURN, WAIT = "lead", "nest", "turn", "return", "wait"

#: (alarmed, bar of the channel's colour, place of its close) -> what happens; all others wait
TRANSITIONS = {
    (False, True, OVER): LEAD,
    (False, True, WITHIN): NEST,
    (False, False, WITHIN): NEST,
    (True, False, UNDER): TURN,
    (True, True, OVER): RETURN,
}

Row = tuple[float, float, float, float, float]


def _colour(row: Row) -> int:
    return 1 if row[C] >= row[O] else -1


class ZigZagFold:
    RECENT = 200

    def __init__(self, min_accept_size: float):
        self.least = min_accept_size
        self.recent: deque[Row] = deque(maxlen=self.RECENT)
        self.way, self.lead, self.floor = 0, None, 0.0
        self.nested: Row | None = None  # lead of the channel that holds nested closes
        self.nest_follows = self.turned = False  # nested is always the present lead; the lead is from a turn
        self.leg: list[Row] = []
        self.alarmed = self.legs_grow = False
        self.marks: list[Row | None] = []

    def _limits(self, close: float) -> tuple[float, float, float, float]:
        """Floor, foot, head and a close, as the channel looks at them."""
        return tuple(self.way * x for x in (self.floor, self.lead[O], self.lead[C], close))

    def _place(self, close: float) -> str:
        _, foot, head, y = self._limits(close)
        return OVER if y > head else WITHIN if y >= foot else UNDER

    def _place_in_alarm(self, close: float, own: bool) -> str:
        floor, foot, head, y = self._limits(close)
        if own:
            return WITHIN if floor < y < foot else OVER if y > min(foot, head) else UNDER
        return UNDER if y < floor else WITHIN

    def _floor_under(self, row: Row) -> float:
        way, limit = self.way, self.way * row[O]
        opens = (x[O] for x in reversed(self.leg) if _colour(x) == way and way * x[O] < limit)
        found = next(opens, row[O])
        nest = self.lead if self.nest_follows else self.nested
        if found != row[O] and nest is not None and nest[T] != row[T] and nest[O] < found < nest[C]:
            return nest[O]
        return found

    def _take_lead(self, row: Row) -> None:
        floor = self._floor_under(row)
        self.lead, self.floor, self.turned = row, floor, False

    def _calm(self, row: Row) -> None:
        done = TRANSITIONS.get((False, _colour(row) == self.way, self._place(row[C])), WAIT)
        if done == LEAD:
            self._take_lead(row)
        elif done == NEST and not self.nest_follows and (self.nested is None or self.nested[T] != self.lead[T]):
            self.nested, self.nest_follows = self.lead, not self.turned

    def _turn(self, row: Row) -> None:
        """Point the other way, led by the extreme close of the leg."""
        self.way, self.nested, self.nest_follows = -self.way, None, False
        way, lead, nests = self.way, self.leg[0], False
        for x in self.leg:
            if way * x[C] > way * lead[C]:
                lead = x
            else:
                nests = nests or way * lead[O] < way * x[C] < way * lead[C]
        self.lead, self.turned = lead, True
        self.nested = lead if nests else None
        self.floor = self._floor_under(row)

    def _mark(self) -> tuple[str, Row | None, float | None]:
        """(label, bar, plotted price) of the leg that has ended."""
        way, first = self.way, not self.marks
        since = list(self.recent) if first else self.leg
        if not first and self.marks[0] is not None:
            ends = [k for k, x in enumerate(since) if x[T] == self.marks[0][T]]
            since = since[ends[-1] + 1 :] if ends else since
        side = way if first else -way  # the first pivot is named after the new channel, later ones end the old
        bodies = [x for x in since if _colour(x) == side or x[C] == x[O]]
        best = max(reversed(bodies), key=lambda x: side * x[C], default=None)
        if first:
            return "H" if way > 0 else "L", best, None
        extreme = min(reversed(since), key=lambda x: x[L] if way > 0 else -x[H], default=None)
        lower = bool(self.marks[0] and best and self.marks[0][O] > best[C])
        label = ("LL" if lower else "LH") if way > 0 else ("HH" if lower else "HL")
        return label, best, extreme and extreme[H]

    def _move(self, before: Row, row: Row):
        if not self.alarmed:
            self._calm(row)
            floor, foot, _, y = self._limits(row[C])
            self.alarmed = y < max(floor, foot)
            return None
        own = _colour(row) == self.way
        done = TRANSITIONS.get((True, own, self._place_in_alarm(row[C], own)), WAIT)
        mark = None
        if done == TURN:
            self._turn(row)
            mark = self._mark()
            self.marks = [*self.marks[-1:], mark[1]]
        elif done == RETURN:
            self.alarmed = False
            self._calm(row)
        if done != WAIT:
            self.leg, self.alarmed = [before, row], False
        return mark

    def step(self, row: Row):
        """(label, bar, plotted price) if the bar marks a pivot."""
        before, mark = self.recent[-1] if self.recent else None, None
        self.recent.append(row)
        if self.legs_grow:
            self.leg.append(row)
        if before is None or abs(row[O] - row[C]) <= self.least:
            return None
        if self.way:
            mark = self._move(before, row)
            self.legs_grow = self.legs_grow or len(self.marks) == 2
        elif _colour(before) == _colour(row) and _colour(row) * (row[C] - before[C]) > 0:
            self.way, self.leg = _colour(row), [before, row]
            self._take_lead(row)
        return mark

    def feed(self, o, h, l, c, t):
        labels, price, time, close, last = [], [], [], [], []
        for row in zip(o.tolist(), h.tolist(), l.tolist(), c.tolist(), t.tolist(), strict=True):
            label, bar, plotted = self.step(row) or (None, None, None)
            labels.append(label)
            price.append(np.nan if label is None else row[C] if plotted is None else plotted)
            time.append(None if label is None else -1 if bar is None else int(bar[T]))
            close.append(0.0 if bar is None else bar[C])
            last.append(0.0 if label is None else row[C])
        return labels, np.array(price, dtype=float), time, np.array(close), np.array(last)


@operator("zigzag")
def zigzag_base(bars: DataFrame, min_accept_size: float = 0.0) -> DataFrame:
    """One row per accepted break: label, plotted price, pivot bar (time in unix seconds, close), close of the break."""
    seconds = F.col("time").cast("long") if dict(bars.dtypes)["time"] in ("bigint", "int", "timestamp") else F.unix_timestamp(F.col("time").cast("timestamp"))
    inputs = {x[0]: extract(x) for x in ("open", "high", "low", "close")} | {"t": seconds.cast("double")}
    return fold(bars, inputs, ("label", "price", "pivot_time", "pivot_close", "break_close"), ZigZagFold, min_accept_size, kinds={"label": "string", "pivot_time": "long"})
