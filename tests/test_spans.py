"""Operators over spans of a series give what they give over the whole."""

import random

import pytest

import barloom.operators  # noqa: F401
from barloom.bars import EPOCH, from_matrix
from barloom.plans.spans import numbered, over_spans
from barloom.registry import OPERATORS, get


SCANS = ("ema", "rma", "dema", "tema", "zlema", "t3", "macd", "rsi", "adx", "tsi", "trix", "force_index", "atr", "chandelier", "keltner", "ppo", "apo", "vo")
WINDOWS = ("sma", "hma", "trima", "tr", "bbands", "dpo", "kst", "coppock", "chop", "uo", "cmo", "stochastic", "aroon", "morning_star", "ichimoku", "mfi")


def walk(spark, n, symbol="BTC", seed=3):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        close = price + rng.gauss(0, 1)
        rows.append([price, max(price, close) + rng.random(), min(price, close) - rng.random(), close, 1 + rng.random(), EPOCH + 60 * i])
        price = close
    return from_matrix(spark, rows, symbol)


@pytest.fixture(scope="module")
def bars(spark):
    df = walk(spark, 700).unionByName(walk(spark, 130, symbol="ETH", seed=8)).cache()
    yield df
    df.unpersist()


def equal(got, want):
    got, want = ({tuple(r)[:3]: tuple(r)[3:] for r in df.collect()} for df in (got, want))
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9), k


@pytest.mark.parametrize("name", [*SCANS, *WINDOWS, "obv", "ad", "pvt"])
def test_spans_equal_the_whole(spark, bars, name):
    params = {"digits": None} if name in ("rsi", "chop") else {}
    operator = lambda b: get(name)(b, **params)
    equal(over_spans(operator, bars, span_bars=128, slot_seconds=3600), operator(bars))


def test_numbers_and_repeated_bars(spark, bars):
    twice = bars.unionByName(bars.filter("time % 240 = 0"))
    rows = numbered(twice, 1000).orderBy("symbol", "time").collect()
    assert [r.n for r in rows] == [*range(1, 701), *range(1, 131)]
    equal(over_spans(get("ema"), twice, span_bars=100), get("ema")(bars))


def test_no_window_over_a_series(spark, bars):
    """Only counts of slots and steps of spans are windowed or grouped by series."""
    plan = over_spans(get("sma"), bars, span_bars=256)._jdf.queryExecution().toString()
    assert "over_spans" not in plan and "windowspecdefinition(symbol" in plan
    from barloom.plans.spans import spans

    cut = spans(numbered(bars, 3600), 20, 256)
    assert cut.groupBy("symbol", "tf").count().agg({"count": "max"}).first()[0] <= 256 + 20


def test_others_say_so(spark, bars):
    for name in ("vwap", "kama", "zigzag_base", "adosc"):
        with pytest.raises(ValueError):
            over_spans(get(name), bars)
    assert sum(hasattr(o, "family") for o in OPERATORS.values()) == len(OPERATORS)


@pytest.mark.parametrize("name", ["t3", "obv"])
def test_bars_numbered_once_serve_several_operators(spark, bars, name):
    """Short spans go through the scan in bundles."""
    from barloom.plans.spans import numbered

    equal(over_spans(get(name), numbered(bars, 7200), span_bars=64), get(name)(bars))
