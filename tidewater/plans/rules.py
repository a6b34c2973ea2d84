"""Strategies as data: a tree of rules over indicators, prices and numbers, compiled to boolean columns.

A rule is {left, op, right}; an operand {kind: indicator, id, params, output}, {kind: price, field} or {kind: value,
value}. Each indicator with its parameters is computed once, however many rules use it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import REGISTRY, add_indicators
from ..operators.ordered import along, numbered, windowed

COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: F.abs(a - b) < 1e-9}


def operand_name(operand: dict) -> str:
    """The column that holds an indicator operand."""
    known = REGISTRY[operand["id"]]
    params = known.params | operand.get("params", {})
    output = operand.get("output") or known.outputs[0]
    if output not in known.outputs:
        raise ValueError(f"{operand['id']} has no output {output}")
    return "_".join(["i", operand["id"], *[f"{v:g}".replace(".", "p") for _, v in sorted(params.items())], output])


def operands(group: dict) -> list[dict]:
    return [o for r in group.get("rules", []) for o in (r["left"], r["right"])]


def with_operands(bars: DataFrame, wanted: list[dict]) -> DataFrame:
    """Adds a column for each different indicator operand; a builder runs once for each set of parameters."""
    out = bars if "rn" in bars.columns else numbered(bars)
    sets: dict[tuple, dict] = {}
    for o in wanted:
        if o["kind"] == "indicator":
            sets.setdefault((o["id"], tuple(sorted((REGISTRY[o["id"]].params | o.get("params", {})).items()))), {})[operand_name(o)] = o.get("output") or REGISTRY[o["id"]].outputs[0]
    for (id_, params), names in sets.items():
        out = add_indicators(out, [(id_, dict(params))])
        out = out.withColumns({name: F.col(output) for name, output in names.items()}).drop(*REGISTRY[id_].outputs)
    return out


def value(operand: dict) -> Column:
    kind = operand["kind"]
    return F.lit(float(operand["value"])) if kind == "value" else F.col(operand["field"] if kind == "price" else operand_name(operand))


def compile_rule(rule: dict) -> Column:
    """Null operands make a rule false. A cross compares this bar and the one before; it has to run over along()."""
    a, b, op = value(rule["left"]), value(rule["right"]), rule["op"]
    if op in COMPARE:
        return F.coalesce(COMPARE[op](a, b), F.lit(False))
    before = [F.lag(x).over(along()) for x in (a, b)]
    if op == "cross_above":
        return F.coalesce((a > b) & (before[0] <= before[1]), F.lit(False))
    if op == "cross_below":
        return F.coalesce((a < b) & (before[0] >= before[1]), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def compile_group(group: dict) -> Column:
    """A group without rules is false."""
    parts = [compile_rule(r) for r in group.get("rules", [])]
    return reduce(or_ if group.get("logic") == "or" else and_, parts) if parts else F.lit(False)


def in_hours(start: int, end: int, ts: str = "ts") -> Column:
    """The hour is in [start, end), around midnight if end is not after start."""
    h = F.hour(ts)
    return (h >= start) & (h < end) if start < end else (h >= start) | (h < end)


def signals(bars: DataFrame, spec: dict) -> DataFrame:
    """Adds long_entry, short_entry, exit_signal, stop_dist and target_dist. Stops and targets are {type: fixed, value}
    or {type: atr, mult, n}."""
    groups = {"long_entry": spec.get("long", {}), "short_entry": spec.get("short", {}), "exit_signal": spec.get("exit", {})}
    wanted = [o for g in groups.values() for o in operands(g)]
    brackets = {f"{k}_dist": spec[k] for k in ("stop", "target") if spec.get(k)}
    atr = {name: {"kind": "indicator", "id": "atr", "params": {"n": b.get("n", 14)}} for name, b in brackets.items() if b["type"] == "atr"}
    ready = with_operands(bars, [*wanted, *atr.values()])
    ready = windowed(ready, {name: compile_group(g) for name, g in groups.items()}, back=1)
    if hours := spec.get("entry_hours"):
        ready = ready.withColumns({c: F.col(c) & in_hours(*hours) for c in ("long_entry", "short_entry")})
    for name in ("stop_dist", "target_dist"):
        b = brackets.get(name)
        dist = F.lit(None).cast("double") if b is None else F.lit(float(b["value"])) if b["type"] == "fixed" else b["mult"] * F.col(operand_name(atr[name]))
        ready = ready.withColumn(name, dist)
    return ready.select(*bars.columns, *(["rn"] if "rn" not in bars.columns else []), *groups, "stop_dist", "target_dist")
