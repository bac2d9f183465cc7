"""A stream in several micro-batches gives what the batch operator gives."""

import random

import pytest
from pyspark.sql import functions as F

from tracklane.operators import keyed, prepare
from tracklane.operators.heatmap import heatmap_cell, heatmap_second
from tracklane.operators.stateful import deadband, debounce
from tracklane.params import AREAS_TEXT
from tracklane.plans.catalog import PARAMS
from tracklane.session import materialize
from tracklane.sources import streams
from tracklane.streaming import keyed as live
from tracklane.streaming.run import as_stream, run_available

ORDER = ["generation_ts", "seq"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(11)
    rows = [("m", 1_000_000 + 1000 * (i // 2), i, f"A{1 + i % 2}", "A", rnd.uniform(-60, 60), rnd.uniform(-40, 40), 0.0, rnd.choice([None, "a", "a", "b"])) for i in range(240)]
    schema = "match_id string, generation_ts bigint, seq bigint, object_id string, team_id string, x double, y double, z double, who string"
    files = [spark.createDataFrame(rows[i:i + 60], schema).coalesce(1) for i in range(0, 240, 60)]
    path = materialize(files[0], "stream-test").inputFiles()[0].rsplit("/", 1)[0]
    for f in files[1:]:
        f.write.mode("append").parquet(path)
    return spark.read.schema(files[0].schema).parquet(path)


def same(a, b, cols):
    read = lambda d: sorted(tuple(r) for r in d.select(*cols).collect())
    assert read(a) == read(b)


def test_rules(table):
    keys = ["match_id", "object_id"]
    src = lambda: as_stream(table, files_per_trigger=1)
    same(run_available(live.debounce_stream(src(), keys, 4000), "t"), debounce(table, keys, 4000, 9000), ["seq"])
    same(run_available(live.deadband_stream(src(), keys, ["x", "y"], 50.0), "t"), deadband(table, keys, ["x", "y"], 50.0, 9000), ["seq"])
    same(run_available(live.emit_on_change_stream(src(), keys, ORDER, "who"), "t"),
         keyed.emit_on_change(table, keys, ORDER, 9000, F.col("who")), ["seq"])
    same(run_available(live.phase_events_stream(src(), keys, ORDER, "who"), "t"),
         keyed.phase_events(table, keys, ORDER, 9000, F.col("who"), []), ["seq", "identity", "phase", "event_no"])


def test_changes_of_numbers_with_nulls(spark):
    rows = [("k", i, i, v) for i, v in enumerate([None, None, 1.0, None, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "key string, generation_ts bigint, seq bigint, v double").coalesce(1)
    table = materialize(df, "null-changes")
    out = run_available(live.emit_on_change_stream(as_stream(table), ["key"], ORDER, "v"), "n")
    assert sorted(r["seq"] for r in out.collect()) == [0, 2, 3, 5]
    same(out, keyed.emit_on_change(table, ["key"], ORDER, 9, F.col("v")), ["seq"])


def test_velocity(spark, table):
    raw = table.drop("who")
    meta = spark.createDataFrame(
        [("m", 105.0, 68.0, False, False, "", "", AREAS_TEXT)],
        "match_id string, field_length double, field_width double, mirrored_x boolean, mirrored_y boolean, object_rename_map string, team_rename_map string, areas string",
    )
    batch = prepare.field_object_state(raw, meta, PARAMS)
    stream = run_available(live.velocity_stream(as_stream(table, files_per_trigger=1).drop("who"), PARAMS), "v")
    same(*[d.select("seq", *[F.round(c, 6).alias(c) for c in ("vx", "vy", "vz", "vabs")]) for d in (stream, batch)], ["seq", "vx", "vy", "vz", "vabs"])


def test_heatmap(table):
    sized = table.withColumn("field_length", F.lit(105.0)).withColumn("field_width", F.lit(68.0))
    sized = materialize(sized, "sized")
    keys = ["match_id", "second", "item", "cell_x", "cell_y"]
    out = run_available(live.heatmap_stream(as_stream(sized, files_per_trigger=1), PARAMS, late=None), "h", keys=keys)
    same(out, heatmap_second(heatmap_cell(sized, PARAMS)), [*keys, "n"])


def test_ticks(table):
    src = as_stream(table, files_per_trigger=1).withColumn("at", F.timestamp_millis("generation_ts")).withWatermark("at", "0 seconds")
    out = run_available(live.active_key_ticks_stream(src, "match_id", 700, 5000), "k")
    stream = sorted(tuple(r) for r in out.collect())
    batch = sorted(tuple(r) for r in keyed.active_key_ticks(table, "match_id", 700, 5000, 9000).collect())
    last = max(t for _, t, _ in batch)
    assert [t for t in stream if t[1] < last] == [t for t in batch if t[1] < last]


def test_write_read_guard(spark, table, tmp_path):
    out = table.withColumn("stream_name", F.when(F.col("seq") < 5, "else").otherwise("kick_event"))
    streams.write_stream(out, "kick_event", str(tmp_path), width=10_000)
    back = streams.read_stream(spark, ["kick_event"], schema=out.schema, path=str(tmp_path), streaming=False)
    assert back.count() == table.count() and streams.stream_guard(back).count() == table.count() - 5
    live_back = streams.read_stream(spark, ["kick_event"], schema=out.schema, path=str(tmp_path))
    assert live_back.isStreaming
    with pytest.raises(ValueError):
        streams.write_stream(out, "raw_position", str(tmp_path))
