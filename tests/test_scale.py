"""Plans that must stay off the driver and parse once per match, whatever the estimates of sizes say, and sources of streams."""

import pandas as pd
from pyspark.sql import functions as F

from tracklane.operators import heatmap, prepare
from tracklane.operators.ordered import Total, scan
from tracklane.params import AREAS_TEXT, Params
from tracklane.plans import catalog
from tracklane.streaming import run
from tracklane.streaming.keyed import in_order

P = Params().with_(chunk_ms=1000)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_carries_do_not_pass_through_the_driver(spark):
    df = spark.range(10).select(F.lit("k").alias("key"), (F.col("id") * 400).alias("generation_ts"), F.col("id").alias("seq"), F.lit(1).alias("v"))
    out = scan(df, ["key"], ["generation_ts", "seq"], 1000, Total("total", F.col("v")))
    assert "Broadcast" not in plan(out)
    assert [r.total for r in out.orderBy("seq").collect()] == list(range(1, 11))


def test_grids_do_not_pass_through_the_driver(spark):
    spans = spark.sql("select 'm' match_id, 'A1' item, 0L first_s, 2L last_s")
    seconds = spark.sql("select 'm' match_id, c1 second, 'A1' item, 1L cell_x, 2L cell_y, c2 n from values (0L, 3L), (2L, 1L) as t(c1, c2)")
    p = P.with_(intervals_s=(0, 1))
    found = heatmap.heatmap_interval(seconds, spans, p)
    assert sorted((r.interval_s, r.second, r.n) for r in found.collect()) == [(0, 0, 3), (0, 1, 3), (0, 2, 4), (1, 0, 3), (1, 2, 1)]
    texts = heatmap.heatmap_rle(found, spans, p)
    assert "LeftOuter" in plan(texts) and not [line for line in plan(texts).splitlines() if "Broadcast" in line and "LeftOuter" in line]
    assert sorted((r.interval_s, r.second, r.total) for r in texts.collect()) == [(0, 0, 3), (0, 1, 3), (0, 2, 4), (1, 0, 3), (1, 1, 0), (1, 2, 1)]


def test_texts_of_the_metadata_are_parsed_per_match(spark):
    raw = spark.createDataFrame(
        [(f"m{i % 2}", i * 200, i, "A1", "A", float(i), 0.0, 0.0) for i in range(8)],
        "match_id string, generation_ts long, seq long, object_id string, team_id string, x double, y double, z double")
    metadata = raw.select("match_id").distinct().select(
        "match_id", F.lit(105.0).alias("field_length"), F.lit(68.0).alias("field_width"), F.lit(False).alias("mirrored_x"),
        F.lit(False).alias("mirrored_y"), F.lit("").alias("object_rename_map"), F.lit("").alias("team_rename_map"), F.lit(AREAS_TEXT).alias("areas"))
    states = prepare.field_object_state(raw, metadata, P)
    assert "SortAggregate" not in plan(states)
    assert states.filter(F.array_contains("areas", "field")).count() == 8


def test_sorting_of_a_keys_rows():
    rows = pd.DataFrame({"t": [3, 1, 1, 2], "s": [0, 5, 4, 1], "x": list("abcd")})
    assert in_order(rows, ["t", "s"])["x"].tolist() == rows.sort_values(["t", "s"], kind="stable")["x"].tolist() == list("cbda")
    assert in_order(rows[::-1].iloc[:0], ["t", "s"]).empty


def test_micro_batches_of_several_files(spark, monkeypatch):
    monkeypatch.setattr(run, "FILE_ROWS", 10)
    rows = spark.range(160).select((F.col("id") * 10).alias("generation_ts"), F.col("id").alias("seq"), F.lit("m").alias("match_id"))
    source = run.out_of_order(rows, "many", 50, end={"match_id": "end", "seq": 0})
    sizes = run.run_available(source.withColumn("file", F.input_file_name()), "many")
    assert sizes.select("file").distinct().count() == 6 * 4
    assert sorted(r.seq for r in sizes.filter("match_id = 'm'").collect()) == list(range(160))


def test_event_batches_keep_the_order_of_far_apart_ids(spark, tmp_path):
    ids = [*range(8), *range(10**9, 10**9 + 8)]
    at = F.timestamp_millis(F.col("event_id") % 1000 * 3_600_000 + F.when(F.col("event_id") > 100, 8 * 3_600_000).otherwise(0))
    events = spark.createDataFrame([(i, 1, "view", 1.0, '{"k": 1}') for i in ids], "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", at).write.parquet(f"{tmp_path}/events.parquet")
    source = catalog._event_stream(spark, str(tmp_path))
    batches = []
    source.writeStream.option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).foreachBatch(
        lambda df, n: batches.append(sorted(r.seq for r in df.collect()))).start().awaitTermination()
    assert [b for b in batches if b] == [ids[:8], ids[8:]]
