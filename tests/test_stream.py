"""Bars of a stream, batch by batch."""

import datetime as dt

from panelcast.streaming import candles


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def test_an_amended_close_moves_the_open_of_the_next_bar(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "series_id string, ts timestamp, value double"
    batches = [
        [("a", at(1, 9), 10.0), ("a", at(1, 17), 11.0), ("a", at(2, 10), 12.0), ("b", at(1, 12), 5.0), ("b", at(1, 12), 4.0), ("b", at(1, 13), None)],
        [("a", at(1, 18), 9.0), ("b", at(3, 1), 6.0)],  # late, within the delay
        [("a", at(6, 1), 20.0), ("b", at(6, 1), 7.0)],
        [("a", at(1, 20), 99.0), ("a", at(6, 2), 21.0)],  # the first one is too late
    ]
    spark.createDataFrame([], schema).write.parquet(source)
    run = candles.write_candles(candles.stream_candles(spark.readStream.schema(schema).parquet(source), "1 day", "2 days"), out, str(tmp_path / "state"))
    emitted = []
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            run.processAllAvailable()
            every = {tuple(r) for r in spark.read.option("basePath", out).schema(f"{candles.BAR}, epoch int").parquet(out).collect()}
            emitted.append(sorted(r[:7] for r in every if r not in {x for e in emitted for x in e} and r[:7] not in {x for e in emitted for x in e}))
    finally:
        run.stop()
    assert emitted[0] == [("a", at(1, 0), 10.0, 11.0, 10.0, 11.0, 2), ("a", at(2, 0), 11.0, 12.0, 11.0, 12.0, 1), ("b", at(1, 0), 4.0, 5.0, 4.0, 5.0, 2)]
    assert emitted[1] == [("a", at(1, 0), 10.0, 11.0, 9.0, 9.0, 3), ("a", at(2, 0), 9.0, 12.0, 9.0, 12.0, 1), ("b", at(3, 0), 5.0, 6.0, 5.0, 6.0, 1)]
    assert emitted[2] == [("a", at(6, 0), 12.0, 20.0, 12.0, 20.0, 1), ("b", at(6, 0), 6.0, 7.0, 6.0, 7.0, 1)]
    assert emitted[3] == [("a", at(6, 0), 12.0, 21.0, 12.0, 21.0, 2)]
    latest = {(r["series_id"], r["period_start"]): r["open"] for r in candles.read_candles(spark, out).collect()}
    assert latest == {("a", at(1, 0)): 10.0, ("a", at(2, 0)): 9.0, ("a", at(6, 0)): 12.0, ("b", at(1, 0)): 4.0, ("b", at(3, 0)): 5.0, ("b", at(6, 0)): 6.0}
