"""The state of a fold as typed values: read and set by field, without the names of classes.

``get_state`` gives nested values of the fields of a fold and of the filters inside it; ``set_state`` puts them
into a fold that was made with the same parameters, so that classes may be renamed or moved. A fold that changes
its fields raises its ``state_version`` and gives ``upgrade(fields, version)``, which takes older fields.
``flat`` and ``nested`` turn the values into one row of typed maps and back: that row is what a state
store or a table holds.
"""

from __future__ import annotations

from collections import deque

import numpy as np

#: The typed row; names are paths of fields.
STATE_SCHEMA = "version int, numbers map<string,double>, integers map<string,bigint>, flags map<string,boolean>, texts map<string,string>, arrays map<string,array<double>>"
STATE_FIELDS = [c.split(" ")[0] for c in STATE_SCHEMA.split(", ")]


def _out(x):
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return {"array": [float(v) for v in x]}
    if isinstance(x, tuple):
        return {"tuple": [_out(v) for v in x]}
    if isinstance(x, deque):
        return {"deque": [_out(v) for v in x], "most": x.maxlen}
    if isinstance(x, list):
        return [_out(v) for v in x]
    return {"fields": _fields(x)}


def _fields(x) -> dict:
    return x.state() if hasattr(x, "state") else {k: _out(v) for k, v in vars(x).items()}


def _in(value, fresh):
    """What the value stands for; fresh is the same field of the new object."""
    if isinstance(value, dict):
        if "fields" in value:
            _set_fields(fresh, value["fields"])
            return fresh
        if "array" in value:
            return np.array(value["array"], dtype=float)
        if "tuple" in value:
            old = fresh if isinstance(fresh, tuple) else ()
            return tuple(_in(v, old[i] if i < len(old) else None) for i, v in enumerate(value["tuple"]))
        return deque((_in(v, None) for v in value["deque"]), maxlen=value["most"])
    if isinstance(value, list):
        old = fresh if isinstance(fresh, list) else []
        return [_in(v, old[i] if i < len(old) else None) for i, v in enumerate(value)]
    return value


def _set_fields(x, fields: dict) -> None:
    if hasattr(x, "restore"):
        x.restore(fields)
        return
    for k, v in fields.items():
        if hasattr(x, k):
            setattr(x, k, _in(v, getattr(x, k)))


def get_state(fold) -> dict:
    """{"version", "fields"}: everything that the fold has to know of the values so far."""
    return {"version": getattr(fold, "state_version", 1), "fields": _fields(fold)}


def set_state(fold, state: dict) -> None:
    """Put a state into a fold that was made with the same parameters; fields that it no longer has are left out."""
    now, fields = getattr(fold, "state_version", 1), state["fields"]
    if state["version"] > now:
        raise ValueError(f"a state of version {state['version']}, where the fold knows {now}")
    if state["version"] < now:
        fields = fold.upgrade(fields, state["version"])
    _set_fields(fold, fields)


def flat(state: dict) -> tuple:
    """The state as one row of STATE_SCHEMA."""
    maps: dict[str, dict] = {k: {} for k in STATE_FIELDS[1:]}

    def put(path: str, x) -> None:
        if x is None:
            maps["texts"][path + "?"] = "none"
        elif isinstance(x, bool):
            maps["flags"][path] = x
        elif isinstance(x, int):
            maps["integers"][path] = x
        elif isinstance(x, float):
            maps["numbers"][path] = x
        elif isinstance(x, str):
            maps["texts"][path] = x
        elif isinstance(x, list):
            if all(isinstance(v, float) for v in x):
                maps["arrays"][path] = x
            else:
                maps["integers"][path + "#"] = len(x)
                for i, v in enumerate(x):
                    put(f"{path}/{i}", v)
        else:
            maps["texts"][path + "?"] = "map"
            for k, v in x.items():
                put(f"{path}/{k}", v)

    put("", state["fields"])
    return (int(state["version"]), *maps.values())


def nested(row) -> dict:
    """The state that ``flat`` made a row of."""
    values = dict(zip(STATE_FIELDS, row, strict=True))
    leaves = {p: v for k in ("numbers", "integers", "flags", "arrays") for p, v in (values[k] or {}).items()}
    leaves |= {p: v for p, v in (values["texts"] or {}).items() if not p.endswith("?")}
    kinds = {p[:-1]: v for p, v in (values["texts"] or {}).items() if p.endswith("?")}
    def take(path: str):
        if path in leaves:
            v = leaves[path]
            return [float(x) for x in v] if isinstance(v, (list, np.ndarray)) else v
        if path + "#" in leaves:
            return [take(f"{path}/{i}") for i in range(leaves[path + "#"])]
        if kinds.get(path) == "none":
            return None
        names = {p[len(path) + 1 :].split("/")[0].removesuffix("#") for p in [*leaves, *kinds] if p.startswith(path + "/")}
        return {k: take(f"{path}/{k}") for k in sorted(names)}

    return {"version": values["version"], "fields": take("")}
