"""Independent SQL of the indicator queries, for DuckDB: window SQL, and recursive CTEs for the folds."""

from __future__ import annotations

import math

BARS = """e AS (
  SELECT event_type AS symbol, "value" AS c, row_number() OVER w AS n, coalesce(lag("value") OVER w, "value") AS o,
         (props->>'$.k')::DOUBLE / 1000e0 AS k, (user_id + 1)::DOUBLE AS v
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
b AS (SELECT symbol, '1m' AS tf, n, (1704067200 + 60 * (n - 1))::BIGINT AS "time", o, greatest(o, c) * (1e0 + k) AS h, least(o, c) * (1e0 - k) AS l, c, v FROM e)"""
#: Added before rounding, so that values halfway between decimals round alike in both engines.
SHIFT = "1.23456789e-8"
W = "(PARTITION BY symbol ORDER BY n)"
HL2, HLC3 = "((h + l) / 2e0)", "((h + l + c) / 3e0)"
TR = "CASE WHEN n = 1 THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER (PARTITION BY symbol ORDER BY n)), abs(l - lag(c) OVER (PARTITION BY symbol ORDER BY n))) END"


def num(x: float) -> str:
    return f"({float(x):.17e})"


def over(call: str, n: int) -> str:
    return f"{call} OVER (PARTITION BY symbol ORDER BY n ROWS {n - 1} PRECEDING)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W}" if k else x


def running(x: str) -> str:
    return f"sum({x}) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING)"


def weighted(x: str, weights) -> str:
    total = math.fsum(weights)
    return " + ".join(f"{num(w / total)} * {lag(x, len(weights) - 1 - i)}" for i, w in enumerate(weights))


def shown(name: str, digits: int | None) -> str:
    return name if digits is None else f"round({name} + {SHIFT}, {digits}) AS {name}"


def select(ctes: list[str], source: str, first: int, outs: dict[str, int | None]) -> str:
    there = " AND ".join(f"{o} IS NOT NULL" for o in outs)
    return f'WITH RECURSIVE {", ".join([BARS, *ctes])} SELECT symbol, tf, "time", {", ".join(shown(o, d) for o, d in outs.items())} FROM {source} WHERE n >= {first} AND {there}'


def windows(first: int, outs: dict[str, str], *steps: dict[str, str], digits: int | None = 6) -> str:
    """outs over the last of the steps, each step adding columns to the one before."""
    ctes, source = [], "b"
    for i, step in enumerate([*steps, {f"out_{k}": v for k, v in outs.items()}]):
        ctes.append(f"s{i} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM {source})")
        source = f"s{i}"
    ctes.append(f'f AS (SELECT symbol, tf, n, "time", {", ".join(f"out_{k} AS {k}" for k in outs)} FROM {source})')
    return select(ctes, "f", first, dict.fromkeys(outs, digits))


def recursive(first: int, outs: dict[str, str], states: list[tuple[str, str, str]], *steps: dict[str, str], digits: int | None = 6, start: int = 1) -> str:
    """A fold: states (name, value at the first bar, value after); x.name is the state before, n_name the new one, r the bar."""
    ctes, source = [], "b"
    for i, step in enumerate(steps):
        ctes.append(f"s{i} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM {source})")
        source = f"s{i}"
    new = ", ".join(f"n_{name} AS {name}" for name, *_ in states)
    ctes.append(f"x AS (SELECT symbol, n, {new} FROM (SELECT r.symbol, r.n, {', '.join(f'{seed} AS n_{name}' for name, seed, _ in states)} FROM {source} r WHERE r.n = {start}) UNION ALL SELECT symbol, n, {new} FROM (SELECT r.symbol, r.n, {', '.join(f'{step} AS n_{name}' for name, _, step in states)} FROM x JOIN {source} r ON r.symbol = x.symbol AND r.n = x.n + 1))")
    ctes.append(f'f AS (SELECT r.symbol, r.tf, r.n, r."time", {", ".join(f"{v} AS {k}" for k, v in outs.items())} FROM x JOIN {source} r USING (symbol, n))')
    return select(ctes, "f", first, dict.fromkeys(outs, digits))


def ema(name: str, x: str, n: int, start: int = 1, k: float | None = None, seeds: int | None = None, divisor: float | None = None, begin: int = 1) -> tuple[str, str, str]:
    """State of an EMA of x, there from bar start; its first ``seeds`` values are summed up and divided."""
    k = 2 / (n + 1) if k is None else k
    seeds = n if seeds is None else seeds
    divisor = divisor or seeds
    ready = start + seeds - 1
    seed = "0e0" if start > begin else (f"({x})" if seeds > 1 else f"({x}) / {num(divisor)}")
    step = f"CASE WHEN r.n < {start} THEN 0e0 WHEN r.n < {ready} THEN x.{name} + ({x}) WHEN r.n = {ready} THEN (x.{name} + ({x})) / {num(divisor)} ELSE x.{name} * {num(1 - k)} + ({x}) * {num(k)} END"
    return name, seed, step


def first_seeded(name: str, x: str, n: int, start: int = 1, begin: int = 1) -> tuple[str, str, str]:
    return ema(name, x, n, start, seeds=1, begin=begin)


def rsi_states(n: int, seeds: int) -> list[tuple[str, str, str]]:
    return [ema(s, f"coalesce(greatest({sign} (r.c - r.pc), 0e0), 0e0)", n, 2, 1 / n, seeds, n - 1) for s, sign in (("up", ""), ("down", "-"))]


def _averages() -> dict[str, str]:
    out = {"sma": windows(20, {"sma": over("avg(c)", 20)})}
    line = [1 / 25 + (i - 12) * 12 / sum((j - 12) ** 2 for j in range(25)) for i in range(25)]
    fib = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    gauss = [math.exp(-((i - 0.85 * 19) ** 2) / (2 * (20 / 6) ** 2)) for i in range(20)]
    for name, w in {"wma": range(1, 21), "lsma": line, "fwma": fib, "alma": gauss, "pwma": [math.comb(9, i) for i in range(10)], "swma": [1, 2, 2, 1], "sinwma": [math.sin((i + 1) * math.pi / 15) for i in range(14)]}.items():
        out[name] = windows(len(w), {name: weighted("c", w)})
    out["hma"] = windows(12, {"hma": weighted("raw", (1, 2, 3))}, {"raw": f"2e0 * ({weighted('c', range(1, 6))}) - ({weighted('c', range(1, 11))})"})
    out["vwma"] = windows(20, {"vwma": f"{over('sum(c * v)', 20)} / nullif({over('sum(v)', 20)}, 0e0)"})
    out["trima"] = windows(20, {"trima": over("avg(m)", 10)}, {"m": f"CASE WHEN n >= 11 THEN {over('avg(c)', 11)} END"})
    out["ema"] = recursive(14, {"ema": "e"}, [ema("e", "r.c", 14)])
    out["rma"] = recursive(14, {"rma": "e"}, [ema("e", "r.c", 14, k=1 / 14)])
    chain = [ema("e", "r.c", 14), ema("e2", "n_e", 14, 14), ema("e3", "n_e2", 14, 27)]
    out["dema"] = recursive(27, {"dema": "2 * e - e2"}, chain[:2])
    out["tema"] = recursive(40, {"tema": "3 * e - 3 * e2 + e3"}, chain)
    out["zlema"] = recursive(14, {"zlema": "e"}, [ema("e", "r.z", 14)], {"z": f"2 * c - coalesce({lag('c', 6)}, first_value(c) OVER {W})"})
    f = 0.7
    states = [first_seeded(f"e{i}", f"n_e{i - 1}" if i else "r.c", 5) for i in range(6)]
    out["t3"] = recursive(30, {"t3": f"{num(1 + 3 * f + 3 * f * f + f**3)} * e2 + {num(-3 * f - 6 * f * f - 3 * f**3)} * e3 + {num(3 * f * f + 3 * f**3)} * e4 + {num(-(f**3))} * e5"}, states)
    gain = f"pow(abs(c - {lag('c', 10)}) / coalesce(nullif({over('sum(abs(c - pc))', 10)}, 0e0), 1e-10) * {num(2 / 3 - 2 / 31)} + {num(2 / 31)}, 2)"
    out["kama"] = recursive(12, {"kama": "y"}, [("y", "r.c", "CASE WHEN r.n < 12 THEN x.y ELSE x.y + r.g * (r.c - x.y) END")], {"pc": lag("c")}, {"g": gain})
    cmo = f"coalesce(abs({over('sum(c - pc)', 9)} / nullif({over('sum(abs(c - pc))', 9)}, 0e0)), 0e0)"
    out["vidya"] = recursive(10, {"vidya": "y"}, [("y", "r.c", f"CASE WHEN r.n <= 10 THEN r.c ELSE x.y + {num(2 / 13)} * r.g * (r.c - x.y) END")], {"pc": lag("c")}, {"g": cmo})
    x = "(r.c + 1000e0)"
    out["mcginley"] = recursive(14, {"mcginley": "y"}, [("y", x, f"CASE WHEN r.n < 14 THEN x.y + {x} WHEN r.n = 14 THEN (x.y + {x}) / 14e0 ELSE x.y + ({x} - x.y) / (14e0 * pow({x} / x.y, 4)) END")])
    a = math.exp(-1.414 * math.pi / 20)
    c2, c3 = 2 * a * math.cos(1.414 * math.pi / 20), -a * a
    out["ssma"] = recursive(3, {"ssma": "y"}, [("y", "r.c", f"{num(1 - c2 - c3)} * (r.c + r.pc) / 2e0 + {num(c2)} * x.y + {num(c3)} * x.y2"), ("y2", "r.c", "x.y")], {"pc": lag("c")})
    out["hwma"] = recursive(3, {"hwma": "lv + tr"}, [("lv", "r.c", "0.2e0 * r.c + 0.8e0 * (x.lv + x.tr)"), ("tr", "0e0", "0.1e0 * (n_lv - x.lv) + 0.9e0 * x.tr")])
    beta = 0.45 * 6 / (0.45 * 6 + 2)
    out["jma"] = recursive(7, {"jma": "e0 + 1.5e0 * e1"}, [("e0", "r.c", f"{num(1 - beta**2)} * r.c + {num(beta**2)} * x.e0"), ("e1", "r.c", f"(r.c - n_e0) * {num(1 - beta)} + {num(beta)} * x.e1")])
    return out


def _volatility() -> dict[str, str]:
    tr = {"tr": TR}
    out = {"tr": windows(1, {"tr": TR}), "atr": recursive(14, {"atr": "a"}, [ema("a", "r.tr", 14, k=1 / 14)], tr), "natr": recursive(14, {"natr": "100 * a / nullif(c, 0e0)"}, [ema("a", "r.tr", 14, k=1 / 14)], tr, digits=4)}
    out["stddev"] = windows(20, {"stddev": over("stddev_pop(c)", 20)})
    m, d = over("avg(c)", 20), over("stddev_pop(c)", 20)
    out["bbands"] = windows(20, {"upper": "m + 2 * d", "middle": "m", "lower": "m - 2 * d"}, {"m": m, "d": d})
    out["keltner"] = recursive(20, {"upper": "e + 2 * a", "middle": "e", "lower": "e - 2 * a"}, [ema("e", "r.c", 20), ema("a", "r.tr", 10, k=1 / 10)], tr)
    hi, lo = over("max(h)", 20), over("min(l)", 20)
    out["donchian"] = windows(20, {"upper": "u", "middle": "(u + d) / 2e0", "lower": "d"}, {"u": hi, "d": lo})
    out["chandelier"] = recursive(22, {"chandelier": "top - 3 * a"}, [ema("a", "r.tr", 22, k=1 / 22)], tr | {"top": over("max(h)", 22)})
    out["hv"] = windows(21, {"hv": f"{over('stddev_pop(r)', 20)} * sqrt(252e0) * 100e0"}, {"r": f"ln(c / ({lag('c')}))"}, digits=3)
    out["ui"] = windows(14, {"ui": "sqrt(list_sum(list_transform(w, lambda x: pow((x - top) / top * 100e0, 2))) / 14e0)"}, {"w": over("list(c)", 14), "top": over("max(c)", 14)})
    return out


def _momentum() -> dict[str, str]:
    out = {}
    out["rsi"] = recursive(14, {"rsi": "CASE WHEN up = 0 AND down = 0 THEN NULL WHEN down = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + up / down) END"}, rsi_states(14, 13), {"pc": lag("c")})
    out["macd"] = recursive(34, {"macd": "f - s", "signal": "g", "histogram": "f - s - g"}, [ema("f", "r.c", 12), ema("s", "r.c", 26), ema("g", "n_f - n_s", 9, 26)])
    chain = [ema("e", "r.c", 14), ema("e2", "n_e", 14, 14), ema("e3", "n_e2", 14, 27)]
    out["trix"] = recursive(41, {"trix": "(e3 - p) / nullif(p, 0e0) * 100e0"}, [("p", "0e0", "x.e3"), *chain], digits=4)
    moves = {"tr": TR, "du": f"h - ({lag('h')})", "dd": f"({lag('l')}) - l"}
    dm = {"pdm": "CASE WHEN du > dd THEN greatest(du, 0e0) ELSE 0e0 END", "ndm": "CASE WHEN dd > du THEN greatest(dd, 0e0) ELSE 0e0 END"}
    sums = [(s, "0e0", f"CASE WHEN r.n <= 15 THEN x.{s} + r.{col} ELSE x.{s} * {num(13 / 14)} + r.{col} * {num(1 / 14)} END") for s, col in (("t", "tr"), ("p", "pdm"), ("m", "ndm"))]
    dx = "100e0 * abs(100e0 * n_p / (n_t + 1e-10) - 100e0 * n_m / (n_t + 1e-10)) / (100e0 * n_p / (n_t + 1e-10) + 100e0 * n_m / (n_t + 1e-10) + 1e-10)"
    out["adx"] = recursive(28, {"adx": "a", "plus_di": "100e0 * p / (t + 1e-10)", "minus_di": "100e0 * m / (t + 1e-10)"}, [*sums, ema("a", dx, 14, 15, 1 / 14)], moves, dm)
    w = {"hs": over("list(h)", 26), "ls": over("list(l)", 26)}
    place = {"u": "(list_position(hs, list_max(hs)) - 1) * 100e0 / 25e0", "d": "(list_position(ls, list_min(ls)) - 1) * 100e0 / 25e0"}
    out["aroon"] = windows(26, {"up": "u", "down": "d", "oscillator": "u - d"}, w, place)
    ao = {"a": f"CASE WHEN n >= 34 THEN {over(f'avg({HL2})', 5)} - {over(f'avg({HL2})', 34)} END"}
    out["ao"] = windows(34, {"ao": "a"}, ao)
    out["ac"] = windows(38, {"ac": f"a - {over('avg(a)', 5)}"}, ao)
    tsi = [first_seeded(f"{s}1", x, 25, 2) for s, x in (("p", "coalesce(r.c - r.pc, 0e0)"), ("q", "coalesce(abs(r.c - r.pc), 0e0)"))]
    out["tsi"] = recursive(38, {"tsi": "CASE WHEN q2 = 0 THEN 0e0 ELSE 100e0 * p2 / q2 END"}, [*tsi, first_seeded("p2", "n_p1", 13, 2), first_seeded("q2", "n_q1", 13, 2)], {"pc": lag("c")})
    out["dpo"] = windows(31, {"dpo": f"({lag('c', 10)}) - avg(c) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 30 PRECEDING AND 11 PRECEDING)"})
    rates = {f"r{i}": f"CASE WHEN ({lag('c', r)}) <> 0 THEN (c - ({lag('c', r)})) / ({lag('c', r)}) * 100e0 WHEN n > {r} THEN 0e0 END" for i, r in enumerate((10, 13, 14, 15))}
    out["kst"] = windows(30, {"kst": " + ".join(f"{i + 1} * {over(f'avg(r{i})', s)}" for i, s in enumerate((10, 13, 14, 15)))}, rates, digits=2)
    out["coppock"] = windows(24, {"coppock": weighted("x", range(1, 11))}, {"x": f"(c - ({lag('c', 14)})) * 100e0 / ({lag('c', 14)}) + (c - ({lag('c', 11)})) * 100e0 / ({lag('c', 11)})"}, digits=2)
    sym = (1, 2, 2, 1)
    out["rvi"] = windows(13, {"rvi": over("avg(x)", 10)}, {"num": weighted("(c - o)", sym), "den": weighted("(h - l)", sym)}, {"x": "CASE WHEN n >= 4 THEN coalesce(num / nullif(den, 0e0), 0e0) END"})
    rng = {"hi": over("max(h)", 9), "lo": over("min(l)", 9)}
    out["fisher"] = windows(9, {"fisher": "0.5e0 * ln((1e0 + x) / (1e0 - x))"}, rng, {"x": f"CASE WHEN hi = lo THEN 0e0 ELSE greatest(-0.999e0, least(0.999e0, 2e0 * ({HL2} - lo) / (hi - lo) - 1e0)) END"})
    vm = {"tr": TR, "vp": f"abs(h - ({lag('l')}))", "vn": f"abs(l - ({lag('h')}))"}
    out["vortex"] = windows(15, {"vortex": f"{over('sum(vp)', 14)} / nullif({over('sum(tr)', 14)}, 0e0)", "vortex_minus": f"{over('sum(vn)', 14)} / nullif({over('sum(tr)', 14)}, 0e0)"}, vm)
    return out


def _oscillators() -> dict[str, str]:
    out = {}
    hl = {"hh": over("max(h)", 14), "ll": over("min(l)", 14)}
    out["stochastic"] = windows(16, {"k": "k_", "d": over("avg(k_)", 3)}, hl, {"k_": "CASE WHEN n >= 14 THEN (c - ll) / (hh - ll + 1e-10) * 100e0 END"})
    out["cci"] = windows(20, {"cci": "(tp - m) / (list_sum(list_transform(w, lambda x: abs(x - m))) / 20e0 * 0.015e0 + 1e-10)"}, {"tp": HLC3}, {"m": over("avg(tp)", 20), "w": over("list(tp)", 20)})
    out["williams_r"] = windows(14, {"williams_r": "(hh - c) / (hh - ll + 1e-10) * -100e0"}, hl)
    out["roc"] = windows(13, {"roc": f"(c - ({lag('c', 12)})) * 100e0 / nullif({lag('c', 12)}, 0e0)"}, digits=3)
    out["momentum"] = windows(11, {"momentum": f"c - ({lag('c', 10)})"})
    flow = {"up": "CASE WHEN n > 1 THEN CASE WHEN tp >= p THEN tp * v ELSE 0e0 END END", "dn": "CASE WHEN n > 1 THEN CASE WHEN tp < p THEN tp * v ELSE 0e0 END END"}
    out["mfi"] = windows(15, {"mfi": "CASE WHEN neg = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + pos / neg) END"}, {"tp": HLC3}, {"p": lag("tp")}, flow, {"pos": over("sum(up)", 14), "neg": over("sum(dn)", 14)})
    out["obv"] = windows(2, {"obv": running("x")}, {"x": f"sign(c - ({lag('c')})) * v"})
    d = {"d": f"c - ({lag('c')})"}
    gl = {"g": over("sum(CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0e0 END)", 14), "s": over("sum(CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0e0 END)", 14)}
    out["cmo"] = windows(15, {"cmo": "100e0 * (g - s) / (g + s + 1e-10)"}, d, gl)
    pair = [first_seeded("f", "r.c", 12), first_seeded("s", "r.c", 26)]
    out["ppo"] = recursive(35, {"ppo": "100e0 * (f - s) / nullif(s, 0e0)"}, pair)
    out["apo"] = recursive(26, {"apo": "f - s"}, pair)
    rsi = recursive(15, {"q": "CASE WHEN down = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + up / down) END"}, rsi_states(14, 14), {"pc": lag("c")}, digits=None)
    head, tail = rsi.split(' SELECT symbol, tf, "time", q FROM f')
    span = "(max(q) OVER z - min(q) OVER z)"
    out["stochrsi"] = (
        f"{head}, g AS (SELECT * FROM f WHERE n >= 15), y AS (SELECT *, CASE WHEN n >= 28 THEN CASE WHEN {span} = 0 THEN 50e0 ELSE (q - min(q) OVER z) / {span} * 100e0 END END AS st FROM g WINDOW z AS (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING)), "
        f'k AS (SELECT *, {over("avg(st)", 3)} AS stochrsi FROM y WHERE n >= 28) SELECT symbol, tf, "time", round(stochrsi + {SHIFT}, 2) AS stochrsi FROM k WHERE n >= 32'
    )
    bp = {"pc": lag("c")}
    parts = {"bp": "CASE WHEN n > 1 THEN c - least(l, pc) END", "tw": "CASE WHEN n > 1 THEN greatest(h, pc) - least(l, pc) END"}
    share = lambda p: f"coalesce({over('sum(bp)', p)} / nullif({over('sum(tw)', p)}, 0e0), 0e0)"
    out["uo"] = windows(29, {"uo": f"100e0 * (4 * {share(7)} + 2 * {share(14)} + {share(28)}) / 7e0"}, bp, parts)
    out["chop"] = windows(15, {"chop": f"100e0 * log10(t / nullif(g, 0e0)) / {num(math.log10(14))}"}, {"tr": TR}, {"t": f"nullif({over('sum(tr)', 14)}, 0e0)", "g": f"{over('max(h)', 14)} - {over('min(l)', 14)}"})
    out["force_index"] = recursive(14, {"force_index": "e"}, [first_seeded("e", "coalesce((r.c - r.pc) * r.v, 0e0)", 13, 2)], {"pc": lag("c")}, digits=3)
    return out


def _volume() -> dict[str, str]:
    mfv = {"mfv": "CASE WHEN h <> l THEN ((c - l) - (h - c)) / (h - l) * v ELSE 0e0 END"}
    out = {"ad": windows(1, {"ad": running("mfv")}, mfv, digits=3)}
    out["adosc"] = recursive(10, {"adosc": "f - s"}, [first_seeded("f", "r.ad", 3), first_seeded("s", "r.ad", 10)], mfv, {"ad": running("mfv")}, digits=3)
    out["cmf"] = windows(20, {"cmf": f"{over('sum(mfv)', 20)} / nullif({over('sum(v)', 20)}, 0e0)"}, mfv)
    box = {"m": f"{HL2} - (lag({HL2}) OVER {W})", "bx": "CASE WHEN h <> l THEN v / 10000e0 / (h - l) ELSE 0e0 END"}
    out["eom"] = windows(15, {"eom": over("avg(x)", 14)}, box, {"x": "CASE WHEN n > 1 THEN coalesce(m / nullif(bx, 0e0), 0e0) END"}, digits=1)
    for name, sign in (("nvi", "<"), ("pvi", ">")):
        out[name] = recursive(1, {name: "ln(y)"}, [("y", "1000e0", f"CASE WHEN r.v {sign} r.pv AND r.pc <> 0 THEN x.y * r.c / r.pc ELSE x.y END")], {"pc": lag("c"), "pv": lag("v")})
    out["pvt"] = windows(2, {"pvt": running("x")}, {"x": f"coalesce(v * (c - ({lag('c')})) / nullif({lag('c')}, 0e0), 0e0)"}, digits=2)
    out["vo"] = recursive(10, {"vo": "100e0 * (f - s) / nullif(s, 0e0)"}, [first_seeded("f", "r.v", 5), first_seeded("s", "r.v", 10)])
    out["vroc"] = windows(15, {"vroc": f"(v - ({lag('v', 14)})) * 100e0 / nullif({lag('v', 14)}, 0e0)"})
    return out


def _statistics() -> dict[str, str]:
    md = {"m": over("avg(c)", 20), "d": over("stddev_pop(c)", 20)}
    x = [i - 6.5 for i in range(14)]
    slope = " + ".join(f"{num(w / sum(y * y for y in x))} * {lag('c', 13 - i)}" for i, w in enumerate(x))
    return {
        "zscore": windows(20, {"zscore": "CASE WHEN d > 0 THEN (c - m) / d ELSE 0e0 END"}, md),
        "variance": windows(20, {"variance": over("var_pop(c)", 20)}, digits=4),
        "linreg_slope": windows(14, {"linreg_slope": slope}),
        "correl": windows(20, {"correl": f"CASE WHEN d > 0 THEN {over('corr(c, n::DOUBLE)', 20)} ELSE 0e0 END"}, md),
        "percentrank": windows(20, {"percentrank": "len(list_filter(w, lambda x: x <= c)) * 100e0 / 20e0"}, {"w": over("list(c)", 20)}),
    }


def _hybrid() -> dict[str, str]:
    day = 'PARTITION BY symbol, "time" // 86400 ORDER BY n ROWS UNBOUNDED PRECEDING'
    out = {"vwap": windows(1, {"vwap": f"sum({HLC3} * v) OVER ({day}) / nullif(sum(v) OVER ({day}), 0e0)"})}
    mids = {k: f"({over('max(h)', n)} + {over('min(l)', n)}) / 2e0" for k, n in (("tk", 9), ("kj", 26), ("sb", 52))}
    out["ichimoku"] = windows(52, {"tenkan": "tk", "kijun": "kj", "senkou_a": "(tk + kj) / 2e0", "senkou_b": "sb", "chikou": f"coalesce({lag('c', 26)}, 0e0)"}, mids)
    out["supertrend"] = recursive(
        10, {"value": "CASE WHEN s = 1 THEN lw ELSE uw END", "is_uptrend": "s = 1"},
        [
            ema("a", "r.tr", 10, k=1 / 10),
            ("w", "0e0", f"CASE WHEN r.n < 10 THEN NULL WHEN r.n = 10 OR x.s = 1 THEN CASE WHEN r.n = 10 THEN {_st('-')} ELSE greatest({_st('-')}, x.lw) END ELSE x.lw END"),
            ("z", "0e0", f"CASE WHEN r.n < 10 THEN NULL WHEN r.n = 10 THEN {_st('+')} WHEN x.s = 0 THEN least({_st('+')}, x.uw) ELSE x.uw END"),
            ("s", "0", f"CASE WHEN r.n < 10 THEN 0 WHEN r.n = 10 THEN (r.c > {_MID})::INT WHEN x.s = 1 THEN (r.c >= n_w)::INT ELSE (r.c > n_z)::INT END"),
            ("lw", "0e0", f"CASE WHEN r.n > 10 AND x.s = 0 AND n_s = 1 THEN {_st('-')} ELSE n_w END"),
            ("uw", "0e0", f"CASE WHEN r.n > 10 AND x.s = 1 AND n_s = 0 THEN {_st('+')} ELSE n_z END"),
        ],
        {"tr": TR},
    ).replace(shown("is_uptrend", 6), "is_uptrend")
    out["psar"] = f"""WITH RECURSIVE {BARS},
r AS (SELECT *, lag(h) OVER {W} AS h1, lag(l) OVER {W} AS l1, lag(h, 2) OVER {W} AS h2, lag(l, 2) OVER {W} AS l2, lag(c, 2) OVER {W} AS c2 FROM b),
x AS (
  SELECT symbol, n, c > c2 AS up, CASE WHEN c > c2 THEN l2 ELSE h2 END AS sar, CASE WHEN c > c2 THEN h ELSE l END AS ep, 0.02e0 AS af,
         CASE WHEN c > c2 THEN l1 ELSE 0e0 END AS la, CASE WHEN c > c2 THEN l2 ELSE 0e0 END AS lb, CASE WHEN c > c2 THEN 0e0 ELSE h1 END AS ha, CASE WHEN c > c2 THEN 0e0 ELSE h2 END AS hb
  FROM r WHERE n = 3
  UNION ALL
  SELECT symbol, n, up <> turned, CASE WHEN turned THEN e ELSE s END, CASE WHEN NOT turned THEN e WHEN up THEN l ELSE h END, CASE WHEN turned THEN 0.02e0 ELSE a END,
         CASE WHEN up THEN l ELSE la END, CASE WHEN up THEN la ELSE lb END, CASE WHEN up THEN ha ELSE h END, CASE WHEN up THEN hb ELSE ha END
  FROM (SELECT *, CASE WHEN up THEN l < s ELSE h > s END AS turned
        FROM (SELECT x.symbol, r.n, x.up, r.h, r.l, x.la, x.lb, x.ha, x.hb,
                     CASE WHEN x.up THEN least(x.sar + x.af * (x.ep - x.sar), x.la, x.lb) ELSE greatest(x.sar + x.af * (x.ep - x.sar), x.ha, x.hb) END AS s,
                     CASE WHEN x.up THEN greatest(x.ep, r.h) ELSE least(x.ep, r.l) END AS e,
                     CASE WHEN (x.up AND r.h > x.ep) OR (NOT x.up AND r.l < x.ep) THEN least(x.af + 0.02e0, 0.2e0) ELSE x.af END AS a
              FROM x JOIN r ON r.symbol = x.symbol AND r.n = x.n + 1)))
SELECT symbol, tf, "time", {", ".join(shown(f"x.{o}", 6).replace("AS x.", "AS ") for o in ("sar", "af", "ep"))}, x.up AS is_uptrend FROM x JOIN r USING (symbol, n)"""
    out["zigzag_base"] = ZIGZAG.format(BARS=BARS, W=W, SHIFT=SHIFT, bar="STRUCT(o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, n BIGINT, t BIGINT)")
    return out


#: The zigzag: one row of state a bar, with the bars of the present leg as a list.
ZIGZAG = """WITH RECURSIVE {BARS},
r AS (SELECT symbol, tf, "time", n, x, lag(x) OVER {W} AS p, list(x) OVER (PARTITION BY symbol ORDER BY n ROWS 199 PRECEDING) AS recent
      FROM (SELECT *, {{'o': o, 'h': h, 'l': l, 'c': c, 'n': n, 't': "time"}} AS x FROM b)),
z AS (
  SELECT symbol, n, 0 AS way, NULL::{bar} AS lead, 0e0 AS floor, NULL::{bar} AS nested, false AS follows, false AS turned, []::{bar}[] AS leg,
         false AS alarmed, 0 AS k, NULL::{bar} AS older, NULL::{bar} AS newer, NULL::VARCHAR AS label, NULL::DOUBLE AS price
  FROM r WHERE n = 1
  UNION ALL
  SELECT symbol, n, nway, nlead, nfloor,
         CASE WHEN act = 'turn' THEN CASE WHEN tl.nests THEN nlead END WHEN does = 'nest' THEN lead ELSE nested END,
         CASE WHEN act = 'turn' THEN false WHEN does = 'nest' THEN NOT turned ELSE follows END,
         CASE WHEN act = 'turn' THEN true WHEN act = 'open' OR does = 'lead' THEN false ELSE turned END,
         CASE WHEN act IN ('turn', 'return', 'open') THEN [p, x] ELSE leg END,
         CASE WHEN act = 'calm' THEN nway * x.c < greatest(nway * nlead.o, nway * nfloor) WHEN act = 'skip' THEN alarmed ELSE false END,
         k + (act = 'turn')::INT, CASE WHEN act = 'turn' AND k = 0 THEN best WHEN act = 'turn' AND k > 1 THEN newer ELSE older END, CASE WHEN act = 'turn' AND k > 0 THEN best ELSE newer END,
         CASE WHEN act <> 'turn' THEN NULL WHEN k = 0 THEN CASE WHEN nway > 0 THEN 'H' ELSE 'L' END
              WHEN nway > 0 THEN CASE WHEN coalesce(older.o > best.c, false) THEN 'LL' ELSE 'LH' END ELSE CASE WHEN coalesce(older.o > best.c, false) THEN 'HH' ELSE 'HL' END END,
         CASE WHEN act <> 'turn' THEN NULL WHEN k > 0 AND len(since) > 0 THEN (list_reduce(list_reverse(since), lambda a, y: CASE WHEN CASE WHEN nway > 0 THEN y.l < a.l ELSE y.h > a.h END THEN y ELSE a END)).h ELSE x.c END
  FROM (
    SELECT *, CASE WHEN act = 'open' OR does = 'lead' THEN x WHEN act = 'turn' THEN {{'o': tl.o, 'h': tl.h, 'l': tl.l, 'c': tl.c, 'n': tl.n, 't': tl.t}}::{bar} ELSE lead END AS nlead,
           CASE WHEN act NOT IN ('open', 'turn') AND does IS DISTINCT FROM 'lead' THEN floor
                WHEN f IS NOT NULL AND coalesce(nest.n <> x.n AND nest.o < f AND f < nest.c, false) THEN nest.o ELSE coalesce(f, x.o) END AS nfloor,
           CASE WHEN act = 'turn' AND len(bodies) > 0 THEN list_reduce(list_reverse(bodies), lambda a, y: CASE WHEN side * y.c > side * a.c THEN y ELSE a END) END AS best
    FROM (
      SELECT *, CASE WHEN act = 'turn' THEN CASE WHEN tl.nests THEN {{'o': tl.o, 'h': tl.h, 'l': tl.l, 'c': tl.c, 'n': tl.n, 't': tl.t}}::{bar} END WHEN follows THEN lead ELSE nested END AS nest,
             list_filter(since, lambda y: ((y.c >= y.o) = (side > 0)) OR y.c = y.o) AS bodies
      FROM (
        SELECT *, CASE WHEN act = 'turn' THEN list_reduce(list_transform(leg, lambda y: {{'o': y.o, 'h': y.h, 'l': y.l, 'c': y.c, 'n': y.n, 't': y.t, 'nests': false}}),
                 lambda a, y: CASE WHEN nway * y.c > nway * a.c THEN {{'o': y.o, 'h': y.h, 'l': y.l, 'c': y.c, 'n': y.n, 't': y.t, 'nests': a.nests}}
                   ELSE {{'o': a.o, 'h': a.h, 'l': a.l, 'c': a.c, 'n': a.n, 't': a.t, 'nests': a.nests OR (nway * a.o < nway * y.c AND nway * y.c < nway * a.c)}} END) END AS tl,
               (list_filter(list_reverse(CASE WHEN act = 'open' THEN [p, x] ELSE leg END), lambda y: ((y.c >= y.o) = (nway > 0)) AND nway * y.o < nway * x.o)[1]).o AS f,
               CASE WHEN act <> 'turn' THEN []::{bar}[] WHEN k = 0 THEN recent ELSE list_filter(leg, lambda y: coalesce(y.n > older.n, true)) END AS since,
               CASE WHEN k = 0 THEN nway ELSE -nway END AS side
        FROM (
          SELECT *, CASE act WHEN 'open' THEN col WHEN 'turn' THEN -way ELSE way END AS nway,
                 CASE WHEN act NOT IN ('calm', 'return') THEN NULL WHEN way * x.c > way * lead.c THEN CASE WHEN col = way THEN 'lead' END
                      WHEN way * x.c >= way * lead.o AND NOT follows AND coalesce(nested.n <> lead.n, true) THEN 'nest' END AS does
          FROM (
            SELECT *, CASE WHEN abs(x.o - x.c) <= 0 THEN 'skip' WHEN way = 0 THEN CASE WHEN col = pcol AND col * (x.c - p.c) > 0 THEN 'open' ELSE 'skip' END
                           WHEN NOT alarmed THEN 'calm' WHEN col <> way THEN CASE WHEN way * x.c < way * floor THEN 'turn' ELSE 'skip' END
                           WHEN way * floor < way * x.c AND way * x.c < way * lead.o THEN 'skip' WHEN way * x.c > least(way * lead.o, way * lead.c) THEN 'return' ELSE 'skip' END AS act
            FROM (SELECT r.symbol, r.n, r.x, r.p, r.recent, z.way, z.lead, z.floor, z.nested, z.follows, z.turned, CASE WHEN z.k >= 2 THEN list_append(z.leg, r.x) ELSE z.leg END AS leg,
                         z.alarmed, z.k, z.older, z.newer, CASE WHEN r.x.c >= r.x.o THEN 1 ELSE -1 END AS col, CASE WHEN r.p.c >= r.p.o THEN 1 ELSE -1 END AS pcol
                  FROM z JOIN r ON r.symbol = z.symbol AND r.n = z.n + 1)))))))
SELECT r.symbol, r.tf, r."time", z.label, round(z.price + {SHIFT}, 6) AS price, coalesce(z.pv.t, -1) AS pivot_time, round(coalesce(z.pv.c, 0e0) + {SHIFT}, 6) AS pivot_close, round(r.x.c + {SHIFT}, 6) AS break_close
FROM (SELECT *, CASE WHEN k = 1 THEN older ELSE newer END AS pv FROM z WHERE label IS NOT NULL) z JOIN r USING (symbol, n)"""

_MID = "((r.h + r.l) / 2e0)"


def _st(sign: str) -> str:
    return f"({_MID} {sign} 3e0 * n_a)"


def _bar(k: int) -> dict[str, str]:
    o, h, l, c = (f"{x}{k}" if k else x for x in "ohlc")
    return {
        "o": o, "h": h, "l": l, "c": c, "body": f"abs({c} - {o})", "rng": f"({h} - {l})", "up": f"({h} - greatest({o}, {c}))", "lo": f"(least({o}, {c}) - {l})",
        "mid": f"(({o} + {c}) / 2e0)", "bull": f"({c} >= {o})", "bear": f"({c} < {o})", "share": f"(abs({c} - {o}) / nullif(greatest({h} - {l}, 0e0), 0e0))", "col": f"CASE WHEN {c} >= {o} THEN 1 ELSE -1 END",
    }


def _patterns() -> dict[str, str]:
    """Rules over a, b, c: the bars two and one back and the last."""
    hammer = "{c[lo]} >= 2 * {c[body]} AND {c[up]} <= 0.5e0 * {c[body]} AND {c[share]} >= 0.1e0"
    inverted = "{c[up]} >= 2 * {c[body]} AND {c[lo]} <= 0.5e0 * {c[body]} AND {c[share]} >= 0.1e0"
    legs = "{c[share]} <= 0.05e0 AND {c[up]} >= 0.35e0 * {c[rng]} AND {c[lo]} >= 0.35e0 * {c[rng]}"
    one = {
        "doji": ("{c[share]} <= 0.1e0", "1"),
        "dragonfly_doji": ("{c[share]} <= 0.1e0 AND {c[lo]} >= 0.6e0 * {c[rng]} AND {c[up]} <= 0.1e0 * {c[rng]}", "1"),
        "gravestone_doji": ("{c[share]} <= 0.1e0 AND {c[up]} >= 0.6e0 * {c[rng]} AND {c[lo]} <= 0.1e0 * {c[rng]}", "-1"),
        "hammer": (hammer, "1"), "inverted_hammer": (inverted, "1"), "hanging_man": (hammer, "-1"), "shooting_star": (inverted, "-1"),
        "marubozu": ("{c[share]} >= 0.95e0", "{c[col]}"),
        "spinning_top": ("{c[share]} <= 0.3e0 AND {c[up]} >= 0.2e0 * {c[rng]} AND {c[lo]} >= 0.2e0 * {c[rng]}", "{c[col]}"),
        "long_legged_doji": (legs, "1"),
        "bullish_belt": ("{c[bull]} AND {c[lo]} <= 0.05e0 * {c[body]} AND {c[share]} >= 0.7e0", "1"),
        "bearish_belt": ("{c[bear]} AND {c[up]} <= 0.05e0 * {c[body]} AND {c[share]} >= 0.7e0", "-1"),
        "high_wave": ("{c[share]} <= 0.15e0 AND {c[up]} >= 0.4e0 * {c[rng]} AND {c[lo]} >= 0.4e0 * {c[rng]}", "{c[col]}"),
        "rickshaw_man": (legs + " AND abs({c[mid]} - ({c[h]} + {c[l]}) / 2e0) <= 0.1e0 * {c[rng]}", "1"),
        "umbrella_line": ("{c[rng]} > 0 AND {c[body]} <> 0 AND {c[lo]} >= 2 * {c[body]} AND {c[up]} <= {c[body]}", "{c[col]}"),
    }
    two = {
        "bullish_engulfing": ("{b[bear]} AND {c[bull]} AND {c[o]} <= {b[c]} AND {c[c]} >= {b[o]}", "1"),
        "bearish_engulfing": ("{b[bull]} AND {c[bear]} AND {c[o]} >= {b[c]} AND {c[c]} <= {b[o]}", "-1"),
        "bullish_harami": ("{b[bear]} AND {c[bull]} AND {c[o]} > {b[c]} AND {c[c]} < {b[o]}", "1"),
        "bearish_harami": ("{b[bull]} AND {c[bear]} AND {c[o]} < {b[c]} AND {c[c]} > {b[o]}", "-1"),
        "piercing": ("{b[bear]} AND {c[bull]} AND {c[o]} < {b[c]} AND {b[mid]} < {c[c]} AND {c[c]} < {b[o]}", "1"),
        "dark_cloud_cover": ("{b[bull]} AND {c[bear]} AND {c[o]} > {b[c]} AND {b[o]} < {c[c]} AND {c[c]} < {b[mid]}", "-1"),
        "tweezer": ("abs({b[h]} - {c[h]}) <= 0.001e0 * {b[rng]} AND {b[bull]} AND {c[bear]}", "-1", "abs({b[l]} - {c[l]}) <= 0.001e0 * {b[rng]} AND {b[bear]} AND {c[bull]}", "1"),
        "kicking": ("{b[share]} >= 0.9e0 AND {c[share]} >= 0.9e0 AND {b[bear]} AND {c[bull]} AND {c[o]} > {b[o]}", "1", "{b[share]} >= 0.9e0 AND {c[share]} >= 0.9e0 AND {b[bull]} AND {c[bear]} AND {c[o]} < {b[o]}", "-1"),
        "on_neck": ("{b[bear]} AND {c[bull]} AND abs({c[c]} - {b[l]}) <= 0.002e0 * {b[rng]}", "-1"),
        "matching_low": ("{b[bear]} AND {c[bear]} AND abs({b[c]} - {c[c]}) <= 0.001e0 * {b[rng]}", "1"),
    }
    three = {
        "morning_star": ("{a[bear]} AND {b[body]} < 0.5e0 * {a[body]} AND {c[bull]} AND {b[c]} < {a[c]} AND {c[c]} > {a[mid]}", "1"),
        "evening_star": ("{a[bull]} AND {b[body]} < 0.5e0 * {a[body]} AND {c[bear]} AND {b[c]} > {a[c]} AND {c[c]} < {a[mid]}", "-1"),
        "morning_doji_star": ("{a[bear]} AND {b[share]} <= 0.1e0 AND {c[bull]} AND {c[c]} > {a[mid]}", "1"),
        "evening_doji_star": ("{a[bull]} AND {b[share]} <= 0.1e0 AND {c[bear]} AND {c[c]} < {a[mid]}", "-1"),
        "three_white_soldiers": ("{a[bull]} AND {b[bull]} AND {c[bull]} AND {b[c]} > {a[c]} AND {c[c]} > {b[c]} AND {b[o]} > {a[o]} AND {c[o]} > {b[o]}", "1"),
        "three_black_crows": ("{a[bear]} AND {b[bear]} AND {c[bear]} AND {b[c]} < {a[c]} AND {c[c]} < {b[c]} AND {b[o]} < {a[o]} AND {c[o]} < {b[o]}", "-1"),
        "three_inside_up": ("{a[bear]} AND {b[bull]} AND {c[bull]} AND {b[o]} > {a[c]} AND {b[c]} < {a[o]} AND {c[c]} > {b[c]}", "1"),
        "three_inside_down": ("{a[bull]} AND {b[bear]} AND {c[bear]} AND {b[o]} < {a[c]} AND {b[c]} > {a[o]} AND {c[c]} < {b[c]}", "-1"),
        "deliberation": ("{a[bull]} AND {b[bull]} AND {c[bull]} AND {b[c]} > {a[c]} AND {c[c]} > {b[c]} AND {c[body]} < 0.5e0 * {b[body]}", "-1"),
        "identical_three_crows": ("{a[bear]} AND {b[bear]} AND {c[bear]} AND {b[c]} < {a[c]} AND {c[c]} < {b[c]} AND abs({b[o]} - {a[c]}) <= 0.002e0 * coalesce(nullif({a[rng]}, 0e0), 1e0) AND abs({c[o]} - {b[c]}) <= 0.002e0 * coalesce(nullif({a[rng]}, 0e0), 1e0)", "-1"),
    }
    out = {}
    for need, rules in ((1, one), (2, two), (3, three)):
        lags = {f"{x}{k}": lag(x, k) for k in range(1, need) for x in "ohlc"}
        for name, rule in rules.items():
            a, b, c = _bar(2), _bar(1), _bar(0)
            cases = " ".join(f"WHEN {rule[i].format(a=a, b=b, c=c)} THEN {rule[i + 1].format(c=c)}" for i in range(0, len(rule), 2))
            out[name] = windows(need, {"signal": f"(CASE {cases} ELSE 0 END)::INT"}, *([lags] if lags else []), digits=None)
    return out


def indicator_sql() -> dict[str, str]:
    return {**_averages(), **_volatility(), **_momentum(), **_oscillators(), **_volume(), **_statistics(), **_hybrid(), **_patterns()}


def _rolled(minutes: int, tf: str) -> str:
    start = f'("time" - ("time" % 86400) % {60 * minutes})'
    return f"""SELECT symbol, '{tf}' AS tf, {start} AS "time", arg_min(o, n) AS open, max(h) AS high, min(l) AS low, arg_max(c, n) AS close, sum(v) AS volume,
  CASE WHEN arg_min(o, n) > arg_max(c, n) THEN 0 ELSE 1 END AS side FROM b GROUP BY symbol, {start} HAVING count(*) = {minutes}"""


def _from(sql: str) -> str:
    return f"WITH {BARS}{sql}" if sql.startswith(",") else f"WITH {BARS} {sql}"


def _rounded(columns: dict[str, str], rest: str, digits: int = 6) -> str:
    return ", ".join([rest, *(f"round({v} + {SHIFT}, {digits}) AS {k}" for k, v in columns.items())])


#: The bars with others of the same time above and below them; of each time the largest stays.
DOUBLED = BARS.replace("b AS (", "b0 AS (") + """,
d AS (SELECT * FROM b0 UNION ALL SELECT symbol, tf, n, "time", o + 1, h + 1, l, c + 2, v FROM b0 WHERE n % 5 = 0 UNION ALL SELECT symbol, tf, n, "time", o - 1, h, l - 1, c - 2, v FROM b0 WHERE n % 7 = 0),
b AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, n ORDER BY o DESC, h DESC, l DESC, c DESC, v DESC) AS r FROM d) WHERE r = 1)"""


def _by_name(queries: dict[str, str]) -> str:
    return " UNION ALL ".join(f"""SELECT symbol, "time", '{name}' AS name, {name} AS value FROM ({sql})""" for name, sql in queries.items())


def _parity() -> dict[str, str]:
    tr = TR.replace("CASE WHEN n = 1 THEN h - l", "CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN h - l")
    out = {"tr": windows(1, {"tr": tr}), "atr": recursive(15, {"atr": "a"}, [ema("a", "r.tr", 14, 2, k=1 / 14)], {"tr": tr})}
    out["roc"] = windows(13, {"roc": "(c - p) * 100e0 / nullif(p, 0e0)"}, {"p": f"CASE WHEN n = 13 THEN {lag('c', 12)} ELSE {lag('c', 13)} END"})
    out["zlema"] = recursive(14, {"zlema": "e"}, [ema("e", "r.z", 14)], {"z": f"2 * c - coalesce({lag('c', 7)}, first_value(c) OVER {W})"})
    scale = num(1 / 0.015)
    out["cci"] = windows(20, {"cci": f"(tp - m) / (list_sum(list_transform(w, lambda x: abs(x - m))) / 20e0 * {scale} + 1e-10) * {scale}"}, {"tp": HLC3}, {"m": over("avg(tp)", 20), "w": over("list(tp)", 20)})
    gain = f"pow(abs(c - {lag('c', 11)}) / coalesce(nullif({over('sum(abs(c - pc))', 10)}, 0e0), 1e-10) * {num(2 / 3 - 2 / 31)} + {num(2 / 31)}, 2)"
    out["kama"] = recursive(12, {"kama": "y"}, [("y", "r.c", "CASE WHEN r.n < 12 THEN x.y ELSE x.y + r.g * (r.c - x.y) END")], {"pc": lag("c")}, {"g": gain})
    return out


def relational_sql() -> dict[str, str]:
    every = indicator_sql()
    averages = {name: every[name] for name in ("sma", "ema")}
    ohlcv = {x: x for x in ("open", "high", "low", "close", "volume")}
    raw = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
    side = "CASE WHEN open > close THEN 0 ELSE 1 END AS side"
    out = {"long_series_windows": _by_name({name: every[name] for name in ("sma", "hma", "zscore", "obv")}), "long_series_scan": _by_name({name: every[name] for name in ("ema", "tema", "t3", "tsi")})}
    out |= {"parity": _by_name(_parity()), "late_bars": _by_name(averages), "duplicates_series": _by_name({name: sql.replace(BARS, DOUBLED) for name, sql in averages.items()})}
    out["overview"] = recursive(
        34, {"sma": "sm", "ema": "e", "rsi": "CASE WHEN up = 0 AND down = 0 THEN NULL WHEN down = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + up / down) END", "macd": "f - s", "signal": "g", "histogram": "f - s - g"},
        [ema("e", "r.c", 20), *rsi_states(14, 13), ema("f", "r.c", 12), ema("s", "r.c", 26), ema("g", "n_f - n_s", 9, 26)], {"pc": lag("c"), "sm": over("avg(c)", 20)},
    )
    out["bars_valid"] = _from(f"SELECT {_rounded(raw, 'symbol, \"time\", CASE WHEN o > c THEN 0 ELSE 1 END AS side')} FROM b WHERE h >= greatest(o, c) AND l <= least(o, c) AND v >= 0")
    out["bars_hourly"] = f"""WITH g AS (SELECT event_type AS symbol, epoch(date_trunc('hour', ts))::BIGINT AS "time", arg_min("value", (ts, event_id)) AS open, max("value") AS high, min("value") AS low, arg_max("value", (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)
SELECT *, {side} FROM g"""
    out["bars_daily"] = f"""WITH g AS (SELECT o_orderpriority AS symbol, epoch(date_trunc('day', o_orderdate))::BIGINT AS "time", arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL)
SELECT *, {side} FROM g"""
    out["extractors"] = _from(f"SELECT {_rounded({'x_open': 'o', 'x_high': 'h', 'x_low': 'l', 'x_close': 'c', 'x_volume': 'v', 'x_hl2': HL2, 'x_hlc3': HLC3, 'x_hlcc4': '((h + l + c + c) / 4e0)'}, 'symbol, \"time\"')} FROM b")
    head = "symbol, tf, \"time\", side"
    for name, minutes, tf in (("rollup_5m", 5, "5m"), ("rollup_4h", 240, "4h")):
        out[name] = _from(f", r AS ({_rolled(minutes, tf)}) SELECT {_rounded(ohlcv, head)} FROM r")
    # the bar that opens 5 minutes before midnight takes 2 ticks of the next day, whose first opening is missed
    out["rollup_exact_7m"] = _from(f""", q AS (SELECT symbol, '7m' AS tf, n, "time", o AS open, max(h) OVER f AS high, min(l) OVER f AS low, lead(c, 6) OVER w AS close, sum(v) OVER f AS volume FROM b WINDOW w AS (PARTITION BY symbol ORDER BY n), f AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
r AS (SELECT *, {side} FROM q WHERE close IS NOT NULL AND ("time" % 86400) % 420 = 0 AND NOT ("time" % 86400 = 0 AND n > 1)) SELECT {_rounded(ohlcv, head)} FROM r""")
    one = "SELECT symbol, tf, \"time\", o AS open, h AS high, l AS low, c AS close, v AS volume, CASE WHEN o > c THEN 0 ELSE 1 END AS side FROM b"
    out["rollup_fan_out"] = _from(f", r AS ({one} UNION ALL {_rolled(15, '15m')} UNION ALL {_rolled(60, '1h')}) SELECT {_rounded(ohlcv, head)} FROM r")
    out["multi_timeframe_sma"] = _from(f""", r AS ({_rolled(5, '5m')} UNION ALL {_rolled(15, '15m')}), s AS (SELECT symbol, tf, "time", avg(close) OVER w AS m, row_number() OVER (PARTITION BY symbol, tf ORDER BY "time") AS i FROM r WINDOW w AS (PARTITION BY symbol, tf ORDER BY "time" ROWS 4 PRECEDING)) SELECT {_rounded({'sma': 'm'}, 'symbol, tf, "time"')} FROM s WHERE i >= 5""")
    out["skip_and_recent"] = _from(""", r AS (SELECT symbol, "time", c AS close, row_number() OVER (PARTITION BY symbol ORDER BY n) AS i, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS d FROM b WHERE "time" >= 1704067200 + 3600) SELECT symbol, "time", close FROM r WHERE i > 10 AND d <= 20""")
    out["duplicates_last_write"] = """SELECT event_type AS symbol, epoch(date_trunc('hour', ts))::BIGINT AS "time", arg_max("value", (ts, event_id)) AS "value" FROM events GROUP BY ALL"""
    stored = f""", m AS (SELECT *, CASE WHEN n >= 20 THEN {over('avg(c)', 20)} END AS sma, CASE WHEN n >= 11 AND "time" % 120 = 0 THEN c - ({lag('c', 10)}) END AS mom FROM b)"""
    out["store_merge"] = _from(stored + f""", nw AS (SELECT symbol, "time" + CASE WHEN "time" % 540 = 0 THEN 315360000 ELSE 0 END AS "time", 2 * c AS close, c AS sma FROM m WHERE "time" % 180 = 0),
j AS (SELECT coalesce(m.symbol, nw.symbol) AS symbol, coalesce(m."time", nw."time") AS "time", coalesce(nw.close, m.c) AS close, coalesce(nw.sma, m.sma) AS sma, sign(m.mom)::DOUBLE AS mom_sign, CASE WHEN nw.symbol IS NOT NULL THEN 1e0 END AS added,
  ((coalesce(nw.sma, m.sma) IS NOT NULL)::INT + (m.mom IS NOT NULL)::INT + (nw.symbol IS NOT NULL)::INT) AS n_keys FROM m FULL JOIN nw ON m.symbol = nw.symbol AND m."time" = nw."time")
SELECT {_rounded({'close': 'close', 'sma': 'sma', 'mom_sign': 'mom_sign', 'added': 'added'}, 'symbol, "time", n_keys')} FROM j""")
    out["store_stats"] = _from(stored + f""" SELECT count(mom) AS n, {_rounded({'least': 'min(mom)', 'largest': 'max(mom)', 'mean': 'avg(mom)', 'last_value': 'arg_max(mom, "time") FILTER (mom IS NOT NULL)'}, 'max("time") FILTER (mom IS NOT NULL) AS last_time')} FROM m WHERE symbol = 'click'""")
    out["store_summaries"] = _from(stored + f""" SELECT symbol, count(mom) AS n, {_rounded({'least': 'min(mom)', 'largest': 'max(mom)', 'mean': 'avg(mom)', 'last_value': 'arg_max(mom, "time") FILTER (mom IS NOT NULL)'}, 'max("time") FILTER (mom IS NOT NULL) AS last_time')} FROM m GROUP BY symbol""")
    out["store_complete"] = _from(stored + """, z AS (SELECT * FROM m WHERE symbol = 'view' ORDER BY "time" DESC LIMIT 50) SELECT 'SMA_20' AS key, bool_and(sma IS NOT NULL) AS complete, count(*) AS n_rows FROM z UNION ALL SELECT 'MOM_10', bool_and(mom IS NOT NULL), count(*) FROM z""")
    out["store_keys"] = "SELECT * FROM (VALUES ('MOM_10'), ('SMA_20')) t(key)"
    out["store_series"] = _from(stored + f""" SELECT {_rounded({'value': 'mom', 'sign': 'sign(mom)::DOUBLE'}, '"time"')} FROM m WHERE symbol = 'error' AND mom IS NOT NULL""")
    out["store_candles_with"] = _from(stored + f""", z AS (SELECT * FROM m WHERE symbol = 'signup' ORDER BY "time" DESC LIMIT 100) SELECT {_rounded({'close': 'c', 'sma': 'sma', 'mom': 'mom'}, '"time"')} FROM z""")
    out["store_latest"] = _from(f"SELECT {_rounded(raw, 'symbol, \"time\"')} FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1")
    out["store_history_page"] = _from("""SELECT "time", c AS close FROM b WHERE symbol = 'purchase' AND "time" < 1704067200 + 9000 ORDER BY "time" DESC LIMIT 40""")
    out["store_retention"] = _from("""SELECT symbol, count(*) AS n_rows, min("time") AS first_time FROM b WHERE "time" >= 1704067200 + 6000 GROUP BY symbol""")
    out["store_bulk_points"] = _from("""SELECT symbol, 'O' AS key, count(*) AS n_rows, round(sum(o), 2) AS total FROM b GROUP BY symbol UNION ALL SELECT symbol, 'C', count(*), round(sum(c), 2) FROM b GROUP BY symbol""")
    bands = f""", m AS (SELECT *, {over('avg(c)', 20)} AS mid, {over('stddev_pop(c)', 20)} AS d FROM b), p AS (""" + " UNION ALL ".join(f"""SELECT symbol, tf, 'BBANDS_20.{k}' AS series_key, "time", {v} AS "value" FROM m WHERE n >= 20""" for k, v in (("upper", "mid + 2 * d"), ("middle", "mid"), ("lower", "mid - 2 * d"))) + ")"
    out["payload_points"] = _from(f"""{bands} SELECT {_rounded({'"value"': '"value"'}, 'symbol, tf, series_key, "time"')} FROM p""")
    out["payload_bars"] = _from(f"SELECT {_rounded(raw, 'symbol, \"time\"')} FROM b")
    out["as_of_higher_timeframe"] = _from(f""", r AS (SELECT symbol, "time" + 840 AS t, close FROM ({_rolled(15, '15m')})) SELECT b.symbol, b."time", b.c AS close, r.close AS close_15m FROM b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b."time" >= r.t""")
    return out
