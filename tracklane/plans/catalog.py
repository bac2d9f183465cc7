"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.functions import geometry as geo
from tracklane.functions import parsing
from tracklane.functions.extract import extract_all
from tracklane.operators import (
    areagrid, ballside, filters, heatmap, keyed, offside, ordered, passes, possession, pressing, setplay, speed, teamarea,
)
from tracklane.operators.asof import MATCH, ORDER, SEQ, TS, asof_join
from tracklane.operators.stateful import deadband, debounce
from tracklane.params import ROSTER_TEXT, Params
from tracklane.plans.match import Match
from tracklane.session import materialize, work_dir
from tracklane.sources import streams
from tracklane.sources.elements import elements, event_columns, keyed_events
from tracklane.sources.trace import positions
from tracklane.streaming import keyed as live
from tracklane.streaming import ordered as ordered_live
from tracklane.streaming.run import FILE_ROWS, as_stream, out_of_order, run_available

# The trace has 5 readings a second instead of 45: histories and the throw-in window follow it. Its
# matches last 29 s, so 10 s chunks let every running value cross chunk borders.
PARAMS = Params().with_(chunk_ms=10_000, set_play_history=6, throw_in_ms=400)
HOUR = 3_600_000
DAY = 24 * HOUR
USER = ["user_id"]

_matches: dict[tuple[str, str], Match] = {}


def match(spark: SparkSession, sf_dir: str) -> Match:
    """Stage tables of one session and data folder, shared by the queries that need them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _matches:
        _matches[key] = Match.from_events(spark, sf_dir, PARAMS)
    return _matches[key]


def forget() -> None:
    """Let the next query build its stage tables anew."""
    _matches.clear()


def tidy(df: DataFrame) -> DataFrame:
    """Comparable values: doubles to six places, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def text(c: Column, sep: str = ";") -> Column:
    return F.array_join(F.transform(c, lambda v: v.cast("string")), sep)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def match_query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(match(spark, sf_dir))

    run.__name__ = f.__name__
    return query(run)


def ev(spark, sf_dir):
    return keyed_events(spark, sf_dir)


# --- sources and sinks ---------------------------------------------------------------------------


@query
def read_stream(spark, sf_dir):
    e = elements(spark, sf_dir)
    path = f"{work_dir(spark)}/topics-{uuid.uuid4().hex}"
    for name in ("click", "view", "error"):
        streams.write_records(e.filter(F.col("stream_name") == name).select(MATCH, TS, SEQ, "phase"), name, path, key=MATCH)
    rows = streams.read_stream(
        spark, ["click", "view"], path=path, schema=T.StructType([e.schema[c] for c in (MATCH, TS, SEQ, "phase")]), encoded=True, files_per_trigger=1)
    return run_available(rows, "topics").filter(F.col("key") == F.col(MATCH)).select("topic", MATCH, TS, SEQ)


@match_query
def write_stream(m):
    spark = m.areas.sparkSession
    path = f"{work_dir(spark)}/streams-{uuid.uuid4().hex}"
    streams.write_stream(m.areas, "area_event", path, width=m.p.chunk_ms)
    return spark.read.schema(m.areas.schema).parquet(f"{path}/area_event").select(MATCH, TS, SEQ, "object_id", "area_id", "in_area")


@query
def stream_guard(spark, sf_dir):
    e = elements(spark, sf_dir)
    topic = F.when(F.col("payload.longValue") % 10 == 0, "other").otherwise(F.col("stream_name"))
    return streams.stream_guard(e.withColumn("topic", topic)).select("stream_name", MATCH, SEQ)


@query
def arrival_metadata(spark, sf_dir):
    e = ev(spark, sf_dir)
    out = streams.arrival_metadata(e, F.col(TS) + F.col("k"), F.col(SEQ))
    return out.select("user_id", TS, "append_ts", "offset")


@match_query
def processing_latency(m):
    rows = m.states.withColumn("processing_ts", F.col(TS) + 5 + F.col(SEQ) % 40)
    return streams.processing_latency(rows, m.p.ball)


@match_query
def latency_percentiles(m):
    rows = m.states.withColumn("processing_ts", F.col(TS) + 5 + F.col(SEQ) % 40)
    sketches = materialize(streams.latency_sketches(streams.processing_latency(rows, m.p.ball), m.p.chunk_ms), "latency-sketches")
    return streams.latency_percentiles(sketches)


@query
def union_streams(spark, sf_dir):
    e = ev(spark, sf_dir)
    clicks = e.filter("event_type = 'click'").select("user_id", TS, SEQ, "k")
    views = e.filter("event_type = 'view'").select("user_id", TS, SEQ, "value")
    return keyed.union_streams(clicks, views)


# --- field extraction ----------------------------------------------------------------------------

_EXTRACTS = {
    "extract_static": {"v": "static{v1}"},
    "extract_field": {"a": "fieldValue{longValue,true}", "b": "fieldValue{doubleValue,true}", "c": "fieldValue{atomic,false}"},
    "extract_array_value": {"a": "arrayValue{object_identifiers,1,false}", "b": "arrayValue{repeatedValue,0,true}"},
    "extract_array_size": {"a": "arraySize{group_identifiers,false}", "b": "arraySize{repeatedValue,true}"},
    "extract_key": {"a": "key"},
    "extract_stream_name": {"a": "streamName"},
    "extract_none": {"a": "no", "b": "fieldValue{stringValue,true}"},
}


def _extracted(specs):
    return lambda spark, sf_dir: tidy(extract_all(elements(spark, sf_dir), specs))


for _name, _specs in _EXTRACTS.items():
    QUERIES[_name] = _extracted(_specs)


@query
def extract_position(spark, sf_dir):
    return extract_all(elements(spark, sf_dir), {"p": "positionValue{0}"}).select(MATCH, SEQ, "p.x", "p.y", "p.z")


@query
def extract_phase(spark, sf_dir):
    return extract_all(elements(spark, sf_dir), {"phase": "phase"}, strict=False)


# --- filters -------------------------------------------------------------------------------------


def _kept(df):
    return df.select("stream_name", MATCH, SEQ)


@query
def filter_eq(spark, sf_dir):
    e = elements(spark, sf_dir)
    return _kept(filters.filter_all(e, filters.eq(e, "streamName", "click")))


@query
def filter_ne(spark, sf_dir):
    e = elements(spark, sf_dir)
    return _kept(filters.filter_all(e, filters.ne(e, "fieldValue{stringValue,true}", "click")))


@query
def filter_in(spark, sf_dir):
    e = elements(spark, sf_dir)
    return _kept(filters.filter_all(e, filters.is_in(e, "fieldValue{longValue,true}", [1, 5, 42])))


@query
def filter_all(spark, sf_dir):
    e = elements(spark, sf_dir)
    return _kept(filters.filter_all(e, filters.eq(e, "fieldValue{boolValue,true}", True), filters.ne(e, "streamName", "view")))


@query
def filter_any(spark, sf_dir):
    e = elements(spark, sf_dir)
    return _kept(filters.filter_any(e, filters.eq(e, "streamName", "error"), filters.eq(e, "arraySize{group_identifiers,false}", 0)))


@query
def filter_error_drop(spark, sf_dir):
    e = elements(spark, sf_dir)
    return _kept(filters.filter_all(e, filters.ne(e, "arrayValue{group_identifiers,0,false}", "g1")))


# --- generic keyed state -------------------------------------------------------------------------


@query
def latest_value(spark, sf_dir):
    view = F.when(F.col("event_type") == "view", F.col("value"))
    return keyed.latest_value(ev(spark, sf_dir), USER, ORDER, DAY, view, "latest").select("user_id", SEQ, "latest")


@query
def latest_value_default(spark, sf_dir):
    view = F.when(F.col("event_type") == "view", F.col("k"))
    return keyed.latest_value(ev(spark, sf_dir), USER, ORDER, DAY, view, "latest", default=0).select("user_id", SEQ, "latest")


@query
def running_increase(spark, sf_dir):
    bought = F.when(F.col("event_type") == "purchase", F.col("k"))
    return keyed.running_increase(ev(spark, sf_dir), USER, ORDER, DAY, bought, "total").select("user_id", SEQ, "total")


@query
def history_n(spark, sf_dir):
    out = keyed.history_n(ev(spark, sf_dir), USER, ORDER, DAY, F.col("k"), 3, "h")
    return out.select("user_id", SEQ, text(F.col("h")).alias("history"))


@query
def history_latest(spark, sf_dir):
    errors = F.when(F.col("event_type") == "error", F.col("k"))
    out = keyed.history_n(ev(spark, sf_dir), USER, ORDER, DAY, errors, 2, "h")
    return out.select("user_id", SEQ, F.get("h", F.lit(0)).alias("newest"), F.get("h", F.lit(1)).alias("older"))


@query
def store_many(spark, sf_dir):
    entries = [
        ("latest_phase", "fieldValue{phase,false}", None, "string"),
        ("latest_size", "arraySize{group_identifiers,false}", None, "int"),
        ("long_history", "fieldValue{longValue,true}", 2, "bigint"),
    ]
    out = keyed.store_many(elements(spark, sf_dir), [MATCH], ORDER, DAY, entries, forward=False)
    return out.select(MATCH, SEQ, "latest_phase", "latest_size", text(F.col("long_history")).alias("long_history"))


@query
def composite_inner_key(spark, sf_dir):
    e = ev(spark, sf_dir)
    out = ordered.done(ordered.scan(e, ["user_id", "event_type"], ORDER, DAY, ordered.Last("before", F.col("k"), inclusive=False)))
    return out.select("user_id", "event_type", SEQ, "before")


@match_query
def snapshot_asof(m):
    o = m.frames.filter("players is not null").select(MATCH, TS, SEQ, F.explode("players").alias("o"))
    return o.select(MATCH, TS, SEQ, "o.*")


@query
def asof_join_(spark, sf_dir):
    e = ev(spark, sf_dir)
    clicks = e.filter("event_type = 'click'")
    bought = e.filter("event_type = 'purchase'").select("user_id", TS, SEQ, "value")
    return asof_join(bought, clicks, USER, {"click_seq": F.col(SEQ), "click_value": F.col("value")}, DAY)


QUERIES["asof_join"] = QUERIES.pop("asof_join_")


@match_query
def possession_state(m):
    rows = speed.players(m.states, m.p).select(MATCH, TS, SEQ, "object_id")
    return possession.possession_state(rows, m.changes, m.p)


@query
def active_keys(spark, sf_dir):
    return keyed.active_keys(ev(spark, sf_dir), "user_id", F.col(TS) + F.col("k"), F.col(TS))


@query
def active_key_ticks(spark, sf_dir):
    return keyed.active_key_ticks(ev(spark, sf_dir), "user_id", HOUR, 6 * HOUR, DAY)


@query
def debounce_(spark, sf_dir):
    return debounce(ev(spark, sf_dir), USER, 6 * HOUR, 5 * DAY).select("user_id", TS, SEQ)


QUERIES["debounce"] = QUERIES.pop("debounce_")


@query
def emit_on_change(spark, sf_dir):
    return keyed.emit_on_change(ev(spark, sf_dir), USER, ORDER, DAY, F.col("event_type")).select("user_id", SEQ, "event_type")


@query
def deadband_(spark, sf_dir):
    rows = ev(spark, sf_dir).select("user_id", TS, SEQ, "value", F.col("k").cast("double").alias("level"))
    return deadband(rows, USER, ["value", "level"], 30.0, 5 * DAY)


QUERIES["deadband"] = QUERIES.pop("deadband_")


@query
def phase_events(spark, sf_dir):
    who = F.when(F.col("value") >= 20, F.when(F.col("k") < 50, "low").otherwise("high"))
    rows = keyed.phase_events(ev(spark, sf_dir), USER, ORDER, DAY, who, [])
    return rows.select("user_id", SEQ, "identity", "phase", "event_no")


@match_query
def initial_statistics(m):
    entries = m.areas.filter((F.col("object_id") == m.p.ball) & F.col("area_id").isin(*passes.OUTSIDE_AREAS))
    first = keyed.union_streams(m.changes.select(MATCH, TS), entries.select(MATCH, TS))
    successful = m.passes.filter("outcome = 'successful_pass'")
    gates = {
        "pass_statistics": first, "shot_statistics": first, "set_play_statistics": m.states.filter(F.col("object_id") == m.p.ball),
        "pass_sequence_statistics": successful, "speed_level_statistics": speed.players(m.states, m.p),
        "dribbling_statistics": speed.players(m.states, m.p),
    }
    return keyed.union_streams(*[keyed.initial_statistics(rows, MATCH, m.p.items, s) for s, rows in gates.items()])


@match_query
def item_rollup(m):
    rows = keyed.item_rollup(m.kicks, "player_id", "team_id")
    out = ordered.scan(rows, [MATCH, "item"], ORDER, m.p.chunk_ms, ordered.Total("kicks", F.lit(1).cast("bigint")))
    return out.select(MATCH, SEQ, "item", "kicks")


# --- preparation and geometry --------------------------------------------------------------------


@match_query
def field_object_state(m):
    return m.states.select(MATCH, TS, SEQ, "object_id", "team_id", "x", "y", "z", "vx", "vy", "vz", "vabs")


@query
def rename_map(spark, sf_dir):
    raw = positions(spark, sf_dir)
    return raw.select(MATCH, SEQ, parsing.renamed(F.col("object_id"), parsing.rename_map(F.lit("{BALL:ball}%{A1:keeper}%{B11:striker}"))).alias("object_id"))


@match_query
def parse_areas(m):
    return m.metadata.select(MATCH, F.explode(parsing.parse_areas(F.col("areas"))).alias("a")).select(MATCH, "a.*")


@query
def parse_roster(spark, sf_dir):
    raw = positions(spark, sf_dir).groupBy(MATCH).agg(F.count("*").alias("readings"))
    roster = raw.select(MATCH, "readings", F.explode(parsing.parse_roster(F.lit(ROSTER_TEXT))).alias("r"))
    return roster.select(MATCH, "r.object_id", "r.team_id", "readings")


@match_query
def distance(m):
    o = m.frames.filter("players is not null").select(MATCH, SEQ, possession.point().alias("ball"), F.explode("players").alias("o"))
    return o.select(
        MATCH, SEQ, "o.object_id", geo.distance(F.col("o"), F.col("ball")).alias("dist"),
        geo.distance(F.col("o"), F.col("ball"), flat=True).alias("flat_dist"),
    )


@match_query
def norm(m):
    return m.states.select(MATCH, SEQ, geo.norm(possession.point()).alias("norm"))


def _velocity():
    return F.col("vx"), F.col("vy"), F.col("vz")


def _position():
    return F.col("x"), F.col("y"), F.col("z")


@match_query
def angle(m):
    return m.states.select(MATCH, SEQ, geo.angle3(_velocity(), _position()).alias("angle"))


@match_query
def projected_norm(m):
    return m.states.select(MATCH, SEQ, geo.projected_norm3(_velocity(), _position()).alias("speed"))


@match_query
def nearest_object(m):
    near = m.frames.filter("players is not null").withColumn("n", geo.nearest(F.col("players"), possession.point(), 5.0))
    return near.select(MATCH, SEQ, "n.object_id", "n.team_id", F.col("n.dist").alias("dist"))


@match_query
def k_nearest(m):
    near = m.frames.filter("players is not null").select(MATCH, SEQ, geo.k_nearest(F.col("players"), possession.point(), 3, 20.0).alias("n"))
    return near.select(MATCH, SEQ, F.posexplode("n").alias("rank", "o")).select(MATCH, SEQ, "rank", "o.object_id", F.col("o.dist").alias("dist"))


@match_query
def players_nearer_to_goal(m):
    return m.possession.filter("num_nearer is not null").select(MATCH, SEQ, "player_id", "num_nearer")


# --- detection -----------------------------------------------------------------------------------


@match_query
def area_event(m):
    return m.areas


@match_query
def area_event_grid(m):
    areas = m.metadata.select(MATCH, F.explode(parsing.parse_areas(F.col("areas"))).alias("a")).select(MATCH, "a.*")
    return areagrid.area_event_grid(m.states, areas, m.p)


@match_query
def kickoff_event(m):
    return m.kickoffs


@match_query
def match_time_progress(m):
    return possession.match_time_progress(m.frames, m.kickoffs, m.p)


@match_query
def ball_hit(m):
    return possession.ball_hit(m.possession)


@match_query
def ball_possession_change(m):
    return m.changes.drop("left_team", "areas")


@match_query
def duel_event(m):
    return m.duels


@match_query
def kick_event(m):
    return m.kicks


@match_query
def pass_shot_match(m):
    return m.passes.select(MATCH, TS, SEQ, "kick_ts", "kicker", "receiver", "area_id")


@match_query
def pass_classify(m):
    return m.passes.select(MATCH, "kick_ts", "outcome")


@match_query
def pass_geometry(m):
    return m.passes.select(MATCH, "kick_ts", "length", "velocity", "angle", "direction")


@match_query
def packing(m):
    return m.passes.filter("packing is not null").select(MATCH, "kick_ts", "kicker", "receiver", "packing")


@match_query
def pass_sequence(m):
    out = passes.pass_sequence(m.chains)
    return out.select(MATCH, TS, "team_id", "length", "first_ts", passes.chain_text(F.col("chain")).alias("passes"))


@match_query
def double_pass(m):
    out = passes.double_pass(m.chains)
    return out.select(MATCH, TS, "team_id", passes.chain_text(F.col("chain")).alias("passes"))


@match_query
def set_play(m):
    return m.set_plays


@match_query
def offside_line(m):
    out = offside.offside_line(m.states, m.changes, m.kickoffs, m.p)
    return out.select(MATCH, TS, SEQ, "player_id", "offside_x", text(F.sort_array("players_in_offside")).alias("players_in_offside"))


@match_query
def pressing_index(m):
    return pressing.pressing_index(m.states, m.changes, m.p)


@match_query
def pressing_state(m):
    return m.pressing


@match_query
def under_pressure(m):
    return m.pressure


@match_query
def speed_level_change(m):
    return m.speed_changes


@match_query
def dribbling_event(m):
    return m.dribblings


@match_query
def team_area_mbr(m):
    points = teamarea.team_points(m.states, m.p)
    return points.select(MATCH, SEQ, "team_id", teamarea.mbr_surface(F.col("xs"), F.col("ys")).alias("mbr_surface"))


@match_query
def team_area_hull(m):
    points = teamarea.team_points(m.states, m.p)
    return points.select(MATCH, SEQ, "team_id", teamarea.hull_surface("xs", "ys").alias("hull_surface"))


@match_query
def team_area_state(m):
    return teamarea.team_area_state(m.states, m.p)


@match_query
def train_ball_side(m):
    return ballside.train_ball_side(ballside.samples(m.states, m.p), m.p)[1]


@match_query
def ball_field_side(m):
    made = ballside.made_samples(m.states.sparkSession, ballside.MAX_SAMPLES, m.p)
    return ballside.ball_field_side(m.states, ballside.train_ball_side(made, m.p)[0], m.p)


# --- statistics ----------------------------------------------------------------------------------


@match_query
def ball_possession_statistics(m):
    return possession.ball_possession_statistics(m.states, m.changes, m.p)


@match_query
def pass_statistics(m):
    return passes.pass_statistics(m.passes, m.p)


@match_query
def shot_statistics(m):
    return passes.shot_statistics(m.passes, m.p)


@match_query
def pass_sequence_statistics(m):
    return passes.pass_sequence_statistics(m.chains, m.p)


@match_query
def set_play_statistics(m):
    return setplay.set_play_statistics(m.set_plays, m.p)


@match_query
def speed_level_statistics(m):
    out = speed.speed_level_statistics(m.speed_changes, m.p)
    shares = F.transform("percentages", lambda v: F.round(v, 6))
    return out.select(
        MATCH, TS, SEQ, "item", text(F.col("times_s")).alias("times_s"),
        *[shares[i].alias(f"share_{i}") for i in range(len(m.p.speed_levels) + 1)],
    )


@match_query
def dribbling_statistics(m):
    return speed.dribbling_statistics(m.dribblings, m.p)


@match_query
def distance_statistics(m):
    return speed.distance_statistics(m.states, m.p)


@match_query
def heatmap_cell(m):
    return m.cells


@match_query
def heatmap_second(m):
    return m.cell_seconds


@match_query
def heatmap_interval(m):
    return m.intervals


@match_query
def heatmap_rle(m):
    return heatmap.heatmap_rle(m.intervals, m.spans, m.p)


# --- the same rules on streams: micro-batches over the files of the given table ------------------


BATCHES, FILES = 4, 4


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of BATCHES micro-batches in the order of their ids, FILES files each, or more if rows need them."""
    rows = event_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))
    low, high = rows.agg(F.coalesce(F.min(SEQ), F.lit(0)), F.coalesce(F.max(SEQ), F.lit(0))).first()
    path, step = f"{work_dir(spark)}/streams/events-{uuid.uuid4().hex}", (high - low) // BATCHES + 1
    batch = F.floor((F.col(SEQ) - low) / step)
    counts = dict(rows.filter(F.col(SEQ).isNotNull()).groupBy(batch).count().collect()) or {0: 0}
    # a file without rows would shift the files of later micro-batches
    files = max(1, min(max(FILES, max(counts.values()) // FILE_ROWS), min(counts.values())))
    for k in sorted(counts):
        rows.filter(batch == k).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query
def stream_debounce(spark, sf_dir):
    rows = live.debounce_stream(_event_stream(spark, sf_dir), USER, 6 * HOUR)
    return run_available(rows, "debounce").select("user_id", TS, SEQ)


@query
def stream_deadband(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select("user_id", TS, SEQ, "value", F.col("k").cast("double").alias("level"))
    return run_available(live.deadband_stream(rows, USER, ["value", "level"], 30.0), "deadband")


@query
def stream_emit_on_change(spark, sf_dir):
    rows = live.emit_on_change_stream(_event_stream(spark, sf_dir), USER, ORDER, "event_type")
    return run_available(rows, "changes").select("user_id", SEQ, "event_type")


@query
def stream_phase_events(spark, sf_dir):
    who = F.when(F.col("value") >= 20, F.when(F.col("k") < 50, "low").otherwise("high"))
    rows = _event_stream(spark, sf_dir).select("user_id", TS, SEQ, who.alias("who"))
    out = run_available(live.phase_events_stream(rows, USER, ORDER, "who"), "phases")
    return out.select("user_id", SEQ, "identity", "phase", "event_no")


#: Streams below arrive up to this much out of order; the key of the row that ends them is no key of the data.
LATE_MS, END = 1500, {MATCH: "end", SEQ: 0}


@query
def stream_asof_join(spark, sf_dir):
    e = ev(spark, sf_dir).select("user_id", TS, SEQ, "event_type", "value")
    mixed = out_of_order(e, "events", 2 * HOUR, end={"user_id": -1, SEQ: 0, "event_type": "purchase"})
    clicks = mixed.filter("event_type = 'click'")
    bought = mixed.filter("event_type = 'purchase'").select("user_id", TS, SEQ, "value")
    out = ordered_live.asof_join_stream(bought, clicks, USER, {"click_seq": F.col(SEQ), "click_value": F.col("value")}, late_ms=2 * HOUR)
    return run_available(out, "asof").filter("user_id >= 0")


@match_query
def stream_snapshot_asof(m):
    rows = m.states.select(MATCH, TS, SEQ, "object_id", "x", "y", "z")
    source = out_of_order(rows, "states", LATE_MS, end=END)
    out = ordered_live.snapshot_stream(source, m.p.roster, ["x", "y", "z"], trigger=F.col("object_id") == m.p.ball, late_ms=LATE_MS)
    return run_available(out, "snapshots").select(MATCH, TS, SEQ, F.explode("objects").alias("o")).select(MATCH, TS, SEQ, "o.*")


@match_query
def stream_pass_shot_match(m):
    marks = {"changes": {"player_id": "end"}, "areas": {"object_id": m.p.ball, "in_area": True, "area_id": passes.OUTSIDE_AREAS[0]}}
    tables = {"kicks": m.kicks, "changes": m.changes, "areas": m.areas, "kickoffs": m.kickoffs}
    sources = [out_of_order(t, n, LATE_MS, end={**END, **marks.get(n, {})}) for n, t in tables.items()]
    out = run_available(ordered_live.pass_shot_match_stream(*sources, m.p, late_ms=LATE_MS), "passes")
    return out.filter(F.col(MATCH) != "end").select(MATCH, TS, SEQ, "kick_ts", "kicker", "receiver", "area_id")


@match_query
def stream_heatmap_interval(m):
    rows = m.states.select(MATCH, TS, SEQ, "object_id", "team_id", "x", "y", "field_length", "field_width")
    inside = {"object_id": m.p.roster[0][0], "team_id": "end", "x": 0.0, "y": 0.0, "field_length": 105.0, "field_width": 68.0}
    source = out_of_order(rows, "states", LATE_MS, end={**END, **inside})
    out = run_available(ordered_live.heatmap_interval_stream(source, m.p, late_ms=LATE_MS), "intervals")
    return out.filter(F.col(MATCH) != "end")


@match_query
def stream_heatmap_second(m):
    rows = live.heatmap_stream(as_stream(m.states, files_per_trigger=2), m.p, late=None)
    keys = [MATCH, "second", "item", "cell_x", "cell_y"]
    return run_available(rows, "heatmap", keys=keys)
