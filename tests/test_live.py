"""Decisions at quotes, as plain steps and as a stream with a restart; snapshots and cursors."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.streaming.decisions import Desk, Guards, decide, decisions, quoted
from tidewater.streaming.live import sessions, sliding, write_latest
from tidewater.streaming.snapshot import Cursor, Latest

G = Guards()
BOX = Desk(day=1, high=2650.0, low=2640.0, bars=0b111111)


@pytest.mark.parametrize(("minute", "desk", "kill", "price", "spread", "intent"), [
    (845, BOX, False, 2645, 0.25, ("place", "box")),
    (845, BOX, False, 2645, 0.99, ("wait", "spread")),
    (845, Desk(**{**BOX.__dict__, "pending": True, "armed": True}), False, 2645, 0.99, ("cancel", "spread")),
    (845, Desk(**{**BOX.__dict__, "high": 2700.0}), False, 2645, 0.25, ("skip", "box too wide")),
    (845, BOX, False, 2655, 0.25, ("skip", "broke box before arm")),
    (1200, Desk(**{**BOX.__dict__, "side": 1}), False, 2645, 0.25, ("close", "session flat")),
    (1200, Desk(**{**BOX.__dict__, "pending": True}), False, 2645, 0.25, ("cancel", "past flat time")),
    (845, Desk(**{**BOX.__dict__, "trades": 1}), False, 2645, 0.25, ("skip", "trade cap")),
    (1081, BOX, False, 2645, 0.25, ("skip", "entry window closed")),
    (1081, Desk(**{**BOX.__dict__, "pending": True}), False, 2645, 0.25, ("cancel", "entry window closed")),
    (845, Desk(**{**BOX.__dict__, "made": -26.0}), False, 2645, 0.25, ("skip", "daily loss halt")),
    (845, BOX, True, 2645, 0.25, ("skip", "kill switch")),
    (845, Desk(**{**BOX.__dict__, "side": -1, "trades": 1}), True, 2645, 0.25, ("wait", "in trade")),
    (835, BOX, False, 2645, 0.25, ("wait", "forming box")),
    (845, Desk(day=1, high=2650.0, low=2640.0, bars=0b11), False, 2645, 0.25, ("wait", "incomplete box")),
    (1081, Desk(day=1), False, 2645, 0.25, ("skip", "no box")),
])
def test_what_to_do(minute, desk, kill, price, spread, intent):
    assert decide(minute, desk, G, kill, price, spread) == intent


def day_of(day="2024-06-12", symbol="x"):
    """Six bars of box between 3990 and 4010, then a fill upwards and a stop."""
    at = lambda hm: pd.Timestamp(f"{day} {hm}")
    rows = [(at(f"13:{30 + 5 * k}"), (4010 if k % 2 else 3990) - 0.05, (4010 if k % 2 else 3990) + 0.05) for k in range(6)]
    rows += [(at("14:05"), 3999.9, 4000.1), (at("14:10"), 4010.3, 4010.5), (at("14:40"), 3989.9, 3990.1), (at("15:00"), 4000.0, 4000.2)]
    return pd.DataFrame(rows, columns=["ts", "bid", "ask"]).assign(symbol=symbol)


WIDE = Guards(widest=40.0)


def test_fill_and_stop_of_a_day():
    desk, events = Desk(), []
    for ts, bid, ask in day_of()[["ts", "bid", "ask"]].itertuples(index=False):
        desk, more = quoted(desk, WIDE, int(ts.value // 1000), bid, ask)
        events += more
    assert [(e[1], e[2]) for e in events] == [("wait", "forming box"), ("place", "box"), ("fill", "box"), ("wait", "in trade"), ("exit", "stop"), ("skip", "trade cap")]
    fill, out = events[2], events[4]
    assert fill[3:5] == (1, 4010.52) and out[4] == 3990.0 and abs(-20.52 - out[5]) < 0.5 and out[5] < -20.52


def drained(spark, source, target, checkpoint, guards=WIDE):
    stream = spark.readStream.schema("ts timestamp, bid double, ask double, symbol string").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = decisions(stream, guards).writeStream.format("parquet").option("path", str(target)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None


def test_stream_equals_steps_over_a_restart_and_a_timer(spark, tmp_path):
    quiet = day_of(symbol="y").head(8)  # filled, then silence
    later = pd.DataFrame({"ts": [pd.Timestamp("2024-06-12 21:00"), pd.Timestamp("2024-06-12 22:00")], "bid": 1.0, "ask": 1.1, "symbol": "z"})
    whole = pd.concat([day_of(), quiet, later]).sort_values("ts")
    put = lambda d: spark.createDataFrame(d).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(whole[whole.ts < pd.Timestamp("2024-06-12 14:07")])
    drained(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    for part in (whole[(whole.ts >= pd.Timestamp("2024-06-12 14:07")) & (whole.ts < pd.Timestamp("2024-06-12 16:00"))], later):
        put(part)
        drained(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["ts", "event"])
    x = got[(got.symbol == "x") & ~got.event.isin(["wait"])]
    assert x.event.tolist() == ["place", "fill", "exit", "skip"]
    y = got[(got.symbol == "y") & (got.event == "exit")]
    assert y.reason.tolist() == ["session flat"] and y.ts.tolist() == [pd.Timestamp("2024-06-12 20:00")] and y.price.tolist() == [4010.3]


def test_snapshots_are_whole_and_replays_ignored(spark, tmp_path):
    latest = Latest(spark, str(tmp_path / "snap"))
    assert latest.read() is None
    assert latest.publish(spark.range(3), 0) and latest.publish(spark.range(5), 1)
    reader = latest.read()
    assert not latest.publish(spark.range(99), 1) and reader.count() == 5
    with pytest.raises(Exception):  # a batch that fails keeps the old version
        latest.publish(spark.range(4).select(F.raise_error(F.lit("no")).alias("id")), 2)
    assert latest.read().count() == 5
    assert latest.publish(spark.range(7), 2) and reader.count() == 5 and latest.read().count() == 7
    assert latest.publish(spark.range(8), 3) and len([p for p in (tmp_path / "snap").iterdir() if p.name.startswith("batch=")]) == 2 + 1  # and what the failed batch left


def test_stream_publishes_its_latest_batch(spark, tmp_path):
    for n in (2, 6):
        spark.range(n).write.mode("append").parquet(str(tmp_path / "in"))
        q = write_latest(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "snap"), str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert Latest(spark, str(tmp_path / "snap")).read().count() == n


def test_cursor_moves_only_when_done(spark, tmp_path):
    c = Cursor(spark, str(tmp_path / "at"))
    assert c.start() is None and c.start("2024-01") == "2024-01"
    c.advance("2024-03", complete=False)
    assert c.start() is None
    c.advance("2024-03"), c.advance("2024-02")
    assert c.start("2024-01") == "2024-03" and c.start("2024-05") == "2024-05"


def test_sliding_and_session_windows_equal_batch(spark, tmp_path):
    at = [pd.Timestamp("2024-01-01 10:00") + pd.Timedelta(minutes=m) for m in (0, 3, 12, 50, 55, 300)]
    d = spark.createDataFrame(pd.DataFrame({"symbol": "x", "user_id": 1, "ts": at, "price": [1.0, 3.0, 5.0, 7.0, 9.0, 1.0]}))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    far = spark.createDataFrame([("x", 2, datetime(2024, 1, 2), 0.0)], d.schema)
    far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, f, want in (("slide", lambda s: sliding(s, "20 minutes", "10 minutes", "1 minute"), [1, 1, 1, 2, 2, 2, 3]), ("gap", lambda s: sessions(s, "30 minutes", "1 minute"), [1, 2, 3])):
        q = f(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert sorted(r.n for r in spark.table(name).collect()) == want
