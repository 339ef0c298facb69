"""P1. Price bars over an event stream, opens included."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BAR = "series_id string, period_start timestamp, open double, high double, low double, close double, volume long"


def _merged(bar: list | None, ticks: pd.DataFrame, end: int) -> list:
    """A bar [end, first, its time, top, bottom, close, its time, volume] with more ticks; of one time the least value is
    first and the greatest last."""
    ticks = ticks.sort_values(["ts", "value"])
    first, last = ticks.iloc[0], ticks.iloc[-1]
    new = [end, float(first["value"]), first["ts"].value, float(ticks["value"].max()), float(ticks["value"].min()), float(last["value"]), last["ts"].value, len(ticks)]
    if bar is None:
        return new
    head = min((bar[2], bar[1]), (new[2], new[1]))
    tail = max((bar[6], bar[5]), (new[6], new[5]))
    return [end, head[1], head[0], max(bar[3], new[3]), min(bar[4], new[4]), tail[1], tail[0], bar[7] + new[7]]


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    close, bars = None, {}
    if state.exists:
        held = json.loads(state.get[0])
        close, bars = held["close"], {int(k): b for k, b in held["bars"].items()}
    touched = set()
    for frame in frames:
        for start, ticks in frame.groupby("start"):
            at = start.value
            bars[at] = _merged(bars.get(at), ticks, ticks["end"].iloc[0].value)
            touched.add(at)
    out, before, moved = [], close, False
    for at in sorted(bars):
        _, first, _, top, bottom, last, _, volume = bars[at]
        opened = first if before is None else before
        if at in touched or moved:  # a bar whose close may have changed moves the open of the next
            out.append((key[0], pd.Timestamp(at), opened, max(top, opened), min(bottom, opened), last, volume))
        before, moved = last, at in touched
    # bars that end by the watermark cannot change any more; the last one's close is all that is kept of them
    mark = state.getCurrentWatermarkMs()
    for at in sorted(bars):
        if bars[at][0] > mark * 1_000_000:
            break
        close = bars.pop(at)[5]
    state.update((json.dumps({"close": close, "bars": bars}),))
    if bars:
        state.setTimeoutTimestamp(max(mark + 1, min(b[0] for b in bars.values()) // 1_000_000 + 1))
    if out:
        yield pd.DataFrame(out, columns=["series_id", "period_start", "open", "high", "low", "close", "volume"])


def stream_candles(events: DataFrame, period: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Bars (as N1's) of a stream ``events(series_id, ts, value)``, in update mode: a row for each new or amended bar, and for
    a bar whose open has moved because a late event amended the close before it. Events more than ``delay`` late are
    dropped.

    The state of a series is the close of its last finished bar and the bars that may still change; a timer in event
    time lets go of bars as the watermark passes their end.
    """
    window = F.window("ts", period)
    ticks = events.filter("value IS NOT NULL").withWatermark("ts", delay).select("series_id", "ts", "value", window.alias("w"))
    ticks = ticks.select("series_id", "ts", "value", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    return ticks.groupBy("series_id").applyInPandasWithState(_advance, BAR, "held string", "update", GroupStateTimeout.EventTimeTimeout)


def write_candles(bars: DataFrame, path: str, checkpoint: str):
    """Each micro-batch's new and amended bars as Parquet, one folder a batch, so a rerun batch replaces itself."""
    return bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")).start()


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each bar."""
    last = F.max_by(F.struct("open", "high", "low", "close", "volume"), F.struct("epoch", "volume"))
    bars = spark.read.option("basePath", path).schema(f"{BAR}, epoch int").parquet(path)
    return bars.groupBy("series_id", "period_start").agg(last.alias("b")).select("series_id", "period_start", "b.*")
