"""Path-dependent exits of independent trades: a state folded over the bars of each trade.

Prices are turned so that every trade is a long one: heights are side times price. Most trades end soon, so a short
frame of bars is folded first, and only trades that are still open get the whole one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.shared import Written

from .ordered import same_series

#: step(state, bar, trade) -> new state; they give columns by name. A state has r (null while open), stop, took and made.
Step = Callable[[Column, Column, Callable[[str], Column]], Column]


def _state(r: Column, stop: Column, took: Column, made: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), stop.cast("double").alias("stop"), took.cast("boolean").alias("took"), made.cast("double").alias("made"))


def _made(level: Column, t: Callable[[str], Column]) -> Column:
    return (level - t("height")) / t("risk")


def fixed(reward: float) -> Step:
    """The stop, or a target of `reward` risks; the stop first."""

    def step(s: Column, b: Column, t: Callable[[str], Column]) -> Column:
        r = F.when(b["worst"] <= s["stop"], _made(s["stop"], t)).when(b["best"] >= t("height") + reward * t("risk"), reward)
        return _state(r, s["stop"], s["took"], s["made"])

    return step


def to_level(fallback: float) -> Step:
    """The stop, or the trade's own level; a target of `fallback` risks where the level is missing or behind the entry."""

    def step(s: Column, b: Column, t: Callable[[str], Column]) -> Column:
        ahead = F.coalesce(t("level") > t("height"), F.lit(False))
        target = F.when(ahead, t("level")).otherwise(t("height") + fallback * t("risk"))
        r = F.when(b["worst"] <= s["stop"], _made(s["stop"], t)).when(b["best"] >= target, _made(target, t))
        return _state(r, s["stop"], s["took"], s["made"])

    return step


def swing_trail(buffer: float, half_at: float | None = None) -> Step:
    """A stop that follows the extreme of the three bars before, less a share of the bar's range measure, from the fourth
    bar on. half_at: half is closed at so many risks first; the stop then moves to the entry and only then follows."""

    def step(s: Column, b: Column, t: Callable[[str], Column]) -> Column:
        took, made, stop = s["took"], s["made"], s["stop"]
        if half_at is not None:
            now = ~s["took"] & (b["best"] >= t("height") + half_at * t("risk"))
            took, made = s["took"] | now, F.when(now, s["made"] + 0.5 * half_at).otherwise(s["made"])
            stop = F.when(now, F.greatest(s["stop"], t("height"))).otherwise(s["stop"])
        left = F.when(took, 0.5).otherwise(1.0)
        r = F.when(b["worst"] <= stop, made + left * _made(stop, t))
        follows = (b["off"] >= 3) & (took if half_at is not None else F.lit(True))
        return _state(r, F.when(follows, F.greatest(stop, b["swing"] - buffer * b["range"])).otherwise(stop), took, made)

    return step


def steps_up() -> Step:
    """A target of three risks; the stop moves to the entry after one risk, and to one risk after two."""

    def step(s: Column, b: Column, t: Callable[[str], Column]) -> Column:
        reached = _made(b["best"], t)
        r = F.when(b["worst"] <= s["stop"], _made(s["stop"], t)).when(reached >= 3, 3.0)
        stop = F.when(reached >= 2, F.greatest(s["stop"], t("height") + t("risk"))).when(reached >= 1, F.greatest(s["stop"], t("height"))).otherwise(s["stop"])
        return _state(r, stop, s["took"], s["made"])

    return step


def mean_cross() -> Step:
    """Out at the close beyond the mean; the stop follows the worst price of each bar."""

    def step(s: Column, b: Column, t: Callable[[str], Column]) -> Column:
        r = F.when(b["worst"] <= s["stop"], _made(s["stop"], t)).when(b["end"] < b["mean"], _made(b["end"], t))
        return _state(r, F.greatest(s["stop"], b["worst"]), s["took"], s["made"])

    return step


#: Four exits of continuation trades and three of daily trades.
MODELS: dict[str, Step] = {
    "two_risks": fixed(2.0), "swing": swing_trail(0.1), "half_then_swing": swing_trail(0.1, 1.5), "prior_extreme": to_level(2.0),
    "three_risks": fixed(3.0), "steps": steps_up(), "mean": mean_cross(),
}


def _frames(bars: DataFrame, entries: DataFrame, hold: int, by: str) -> DataFrame:
    """Entries with their bars from `at` on, hold + 1 of them as far as there are, in order, turned to the trade's side."""
    width = hold + 1
    e = entries.select(by, "id", "at", "side").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + hold) / width))))
    b = bars.withColumn("_cell", F.floor(F.col("rn") / width))
    met = same_series(e, b, [by, "_cell"]).where((F.col("rn") >= F.col("at")) & (F.col("rn") <= F.col("at") + hold))
    up = F.col("side") > 0
    turned = F.struct(
        (F.col("rn") - F.col("at")).cast("int").alias("off"), F.when(up, F.col("low")).otherwise(-F.col("high")).alias("worst"), F.when(up, F.col("high")).otherwise(-F.col("low")).alias("best"),
        (F.col("side") * F.col("close")).alias("end"), F.when(up, F.col("low3")).otherwise(-F.col("high3")).alias("swing"), F.col("range").alias("range"), (F.col("side") * F.col("mean")).alias("mean"),
    )
    return same_series(entries, met.groupBy(by, "id").agg(F.array_sort(F.collect_list(turned)).alias("_bars")), [by, "id"])


def folded_exits(bars: DataFrame, entries: DataFrame, hold: int, models: dict[str, Step] | None = None, first: int = 16, by: str = "symbol") -> DataFrame:
    """One row for each entry: by, id and for each model <name>_r (what the trade makes, in risks) and <name>_bars (bars held).

    bars: by, rn, high, low, close and, for models that use them, low3 and high3 (extremes of the three bars before), range and mean.
    entries: by, id, at (number of the first bar), side (1 or -1), price, risk (> 0), stop, level (null: none). A trade that is open after `hold` bars leaves
    at the close of the next one, or of the last. A null `by` is a series; an entry without bars has nulls."""
    models = models or MODELS
    for c in ("low3", "high3", "range", "mean"):
        if c not in bars.columns:
            bars = bars.withColumn(c, F.lit(None).cast("double"))
    bars = bars.select(by, "rn", "high", "low", "close", "low3", "high3", "range", "mean")
    e = entries.select(by, "id", "at", "side", (F.col("side") * F.col("price")).alias("height"), "risk", (F.col("side") * F.col("stop")).alias("stop"), (F.col("side") * F.col("level")).alias("level"))

    def fold(framed: DataFrame, upto: int) -> DataFrame:
        t = lambda c: F.col(c)
        inside = F.filter("_bars", lambda b: b["off"] < upto)
        start = F.struct(F.lit(None).cast("double").alias("r"), F.col("stop").cast("double").alias("stop"), F.lit(False).alias("took"), F.lit(0.0).alias("made"), F.lit(0).alias("held"))

        def following(step: Step) -> Callable[[Column, Column], Column]:
            def follow(s: Column, b: Column) -> Column:
                new = step(s, b, t)
                return F.when(s["r"].isNotNull(), s).otherwise(F.struct(new["r"].alias("r"), new["stop"].alias("stop"), new["took"].alias("took"), new["made"].alias("made"), b["off"].alias("held")))

            return follow

        for name, step in models.items():
            framed = framed.withColumn(f"_{name}", F.aggregate(inside, start, following(step)))
        return framed

    shorter = min(first, hold)
    part = Written(bars.sparkSession).table(fold(_frames(bars, e, shorter, by), shorter), keep=True)
    done = F.lit(True)
    for name in models:
        done = done & F.col(f"_{name}.r").isNotNull()
    keep = [by, "id", "height", "risk", "_bars", *[f"_{name}" for name in models]]
    out = part.where(done).select(*keep)
    still = part.where(~done).select(*e.columns)
    out = out.unionByName(fold(_frames(bars, still, hold, by), hold).select(*keep))
    end = F.element_at("_bars", -1)
    made = []
    for name in models:
        s = F.col(f"_{name}")
        left = F.when(s["took"], 0.5).otherwise(1.0)
        made += [F.coalesce(s["r"], s["made"] + left * (end["end"] - F.col("height")) / F.col("risk")).alias(f"{name}_r"), F.when(s["r"].isNotNull(), s["held"]).otherwise(end["off"]).alias(f"{name}_bars")]
    return same_series(entries.select(by, "id"), out.select(by, "id", *made), [by, "id"], "left")
