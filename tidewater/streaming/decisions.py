"""One order pair a day around a morning's range: what to do at every quote, as a stateful stream with timers.

State is kept for each symbol and restored from the checkpoint; the day's part starts anew with the day. At the flat time a timer closes what is
open even if no quote comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Guards:
    """Minutes of the day (UTC) and limits."""

    box_start: int = 13 * 60 + 30
    box_end: int = 14 * 60
    last_entry: int = 18 * 60
    flat: int = 20 * 60
    box_bars: int = 5
    widest: float = 12.0
    spread: float = 0.60
    trades: int = 1
    loss: float = 25.0
    lots: float = 0.01
    contract: float = 100.0
    slippage: float = 0.02
    commission: float = 6.0


@dataclass(frozen=True)
class Desk:
    """What is known of a symbol's day. Sides are 1 and -1, 0 for none; bars are bits, one for each five minutes of the box."""

    day: int = -1
    high: float = float("-inf")
    low: float = float("inf")
    bars: int = 0
    armed: bool = False
    pending: bool = False
    side: int = 0
    entry: float = 0.0
    spread_in: float = 0.0
    trades: int = 0
    made: float = 0.0
    over: bool = False
    bid: float = 0.0
    ask: float = 0.0
    said: str = ""


def decide(minute: int, desk: Desk, guards: Guards, kill: bool, price: float, spread: float | None) -> tuple[str, str]:
    """(intent, reason). The flat time goes before all; then the box has to be whole; an open position is left to its stop; then come the guards of the
    day, of the box, of the price and of the spread."""
    held_back = "cancel" if desk.pending else "skip"
    if minute >= guards.flat:
        return ("close", "session flat") if desk.side else ("cancel" if desk.pending else "skip", "past flat time")
    if minute < guards.box_end:
        return "wait", "forming box"
    if (n := desk.bars.bit_count()) < guards.box_bars:
        return ("skip" if minute >= guards.last_entry else "wait"), ("no box" if n == 0 else "incomplete box")
    if desk.side:
        return "wait", "in trade"
    day_guards = ((kill, "kill switch"), (desk.trades >= guards.trades, "trade cap"), (desk.made <= -abs(guards.loss), "daily loss halt"), (minute >= guards.last_entry, "entry window closed"))
    if reason := next((r for met, r in day_guards if met), None):
        return held_back, reason
    if desk.high - desk.low > guards.widest:
        return "skip", "box too wide"
    if not desk.armed and not desk.low <= price <= desk.high:
        return "skip", "broke box before arm"
    if spread is not None and spread > guards.spread:
        return ("cancel" if desk.pending else "wait"), "spread"
    return ("wait", "armed") if desk.pending else ("place", "box")


Event = tuple[int, str, str, int, float, float]


def _out(desk: Desk, guards: Guards, at: int, price: float, why: str, spread: float) -> tuple[Desk, Event]:
    units = guards.lots * guards.contract
    net = desk.side * (price - desk.entry) * units - (desk.spread_in / 2 + spread / 2) * units - guards.commission * guards.lots
    return replace(desk, side=0, pending=False, made=desk.made + net), (at, "exit", why, desk.side, price, net)


def quoted(desk: Desk, guards: Guards, at: int, bid: float, ask: float, kill: bool = False) -> tuple[Desk, list[Event]]:
    """The desk after a quote at `at` (microseconds), and what happened: (at, event, reason, side, price, net). An open position or working orders are looked
    after first, as a broker would; then comes the decision."""
    day, minute = at // 86_400_000_000, at % 86_400_000_000 // 60_000_000
    events: list[Event] = []
    if day != desk.day:
        desk = Desk(day=day, side=desk.side, entry=desk.entry, spread_in=desk.spread_in, high=desk.high if desk.side else float("-inf"), low=desk.low if desk.side else float("inf"))
    mid, spread = (bid + ask) / 2, ask - bid
    desk = replace(desk, bid=bid, ask=ask)
    if guards.box_start <= minute < guards.box_end:
        desk = replace(desk, high=max(desk.high, mid), low=min(desk.low, mid), bars=desk.bars | 1 << (minute - guards.box_start) // 5)
    if desk.side:
        stop = desk.low if desk.side > 0 else desk.high
        if (bid <= stop) if desk.side > 0 else (ask >= stop):
            desk, event = _out(desk, guards, at, stop, "stop", spread)
            events.append(event)
    elif desk.pending:
        side = 1 if ask >= desk.high else -1 if bid <= desk.low else 0
        if side:
            entry = max(desk.high, ask) + guards.slippage if side > 0 else min(desk.low, bid) - guards.slippage
            desk = replace(desk, side=side, entry=entry, spread_in=spread, pending=False, trades=desk.trades + 1)
            events.append((at, "fill", "box", side, entry, 0.0))
    if desk.over and not desk.side and not desk.pending:
        return desk, events
    intent, reason = decide(minute, desk, guards, kill, mid, spread)
    if intent == "close":
        desk, event = _out(desk, guards, at, bid if desk.side > 0 else ask, reason, spread)
        events.append(event)
    elif intent == "place":
        desk = replace(desk, pending=True, armed=True)
    elif intent == "cancel":
        desk = replace(desk, pending=False)
    elif intent == "skip":
        desk = replace(desk, over=True)
    if intent not in ("wait", "close") or f"{intent} {reason}" != desk.said and intent == "wait":
        events.append((at, intent, reason, 0, mid, 0.0))
    return replace(desk, said=f"{intent} {reason}"), events


EVENTS = "symbol string, ts timestamp, event string, reason string, side int, price double, net double"
_KINDS = {int: "long", float: "double", bool: "boolean", str: "string"}
STATE = ", ".join(f"{name} {_KINDS[type(value)]}" for name, value in asdict(Desk()).items())


def decisions(quotes: DataFrame, guards: Guards = Guards(), late: str = "10 minutes") -> DataFrame:
    """Events of a stream of quotes: symbol, ts, bid, ask and, if there is one, kill (boolean: no new trades). Quotes of a batch are taken in the order of ts, bid, ask; null
    quotes are left out. A position that is open when the watermark passes the flat time is closed at the last quote."""
    kill = F.coalesce(F.col("kill"), F.lit(False)) if "kill" in quotes.columns else F.lit(False)
    q = quotes.where(F.col("ts").isNotNull() & F.col("bid").isNotNull() & F.col("ask").isNotNull()).select("symbol", "ts", F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"), kill.alias("kill"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        desk, events = Desk(*state.get) if state.exists else Desk(), []
        if state.hasTimedOut:
            if desk.side:
                at = desk.day * 86_400_000_000 + guards.flat * 60_000_000
                desk, event = _out(desk, guards, at, desk.bid if desk.side > 0 else desk.ask, "session flat", desk.ask - desk.bid)
                events.append(event)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "bid", "ask"])
            for at, bid, ask, stop in zip(rows["ts"].to_numpy().astype("datetime64[us]").astype("int64"), rows["bid"], rows["ask"], rows["kill"]):
                desk, more = quoted(desk, guards, int(at), float(bid), float(ask), bool(stop))
                events += more
        state.update(tuple(asdict(desk).values()))
        if desk.side:
            due = desk.day * 86_400_000 + guards.flat * 60_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], datetime.fromtimestamp(at / 1e6, UTC).replace(tzinfo=None), *rest) for at, *rest in events], columns=[c.split()[0] for c in EVENTS.split(", ")])

    return q.withWatermark("ts", late).groupBy("symbol").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
