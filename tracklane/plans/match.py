"""All movement operators chained: each stage table is written once and read by the stages after it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tracklane.operators import heatmap, passes, possession, prepare, pressing, setplay, speed
from tracklane.params import Params
from tracklane.session import materialize
from tracklane.sources import trace


class Match:
    """Lazily built stage tables over one input of raw readings and metadata."""

    def __init__(self, raw: DataFrame, metadata: DataFrame, params: Params):
        self.raw, self.metadata, self.p = raw, metadata, params

    @classmethod
    def from_events(cls, spark: SparkSession, sf_dir: str, params: Params) -> "Match":
        raw = materialize(trace.positions(spark, sf_dir), "raw")
        return cls(raw, materialize(trace.metadata(raw), "metadata"), params)

    @cached_property
    def states(self) -> DataFrame:
        return materialize(prepare.field_object_state(self.raw, self.metadata, self.p), "states")

    @cached_property
    def areas(self) -> DataFrame:
        return materialize(prepare.area_event(self.states, self.p), "areas")

    @cached_property
    def frames(self) -> DataFrame:
        return materialize(possession.ball_frames(self.states, self.p), "frames")

    @cached_property
    def kickoffs(self) -> DataFrame:
        return materialize(possession.kickoff_event(self.frames, self.p), "kickoffs")

    @cached_property
    def possession(self) -> DataFrame:
        return materialize(possession.possession_frames(self.frames, self.kickoffs, self.p), "possession")

    @cached_property
    def changes(self) -> DataFrame:
        return possession.ball_possession_change(self.possession)

    @cached_property
    def duels(self) -> DataFrame:
        return materialize(possession.duel_event(self.possession, self.p), "duels")

    @cached_property
    def pressing(self) -> DataFrame:
        return materialize(pressing.pressing_state(self.states, self.changes, self.p), "pressing")

    @cached_property
    def pressure(self) -> DataFrame:
        return materialize(pressing.under_pressure(self.pressing, self.p), "pressure")

    @cached_property
    def kicks(self) -> DataFrame:
        return materialize(passes.kick_event(self.possession, self.duels, self.pressure, self.p), "kicks")

    @cached_property
    def passes(self) -> DataFrame:
        matched = passes.pass_shot_match(self.kicks, self.changes, self.areas, self.kickoffs, self.p)
        return materialize(passes.pass_events(matched, self.p), "passes")

    @cached_property
    def chains(self) -> DataFrame:
        return materialize(passes.pass_chains(self.passes, self.areas, self.p), "chains")

    @cached_property
    def set_plays(self) -> DataFrame:
        return materialize(setplay.set_play(self.frames, self.areas, self.kickoffs, self.p), "set-plays")

    @cached_property
    def speed_changes(self) -> DataFrame:
        return materialize(speed.speed_level_change(self.states, self.p), "speed-changes")

    @cached_property
    def dribblings(self) -> DataFrame:
        return materialize(speed.dribbling_event(self.states, self.changes, self.p), "dribblings")

    @cached_property
    def cells(self) -> DataFrame:
        return heatmap.heatmap_cell(self.states, self.p)

    @cached_property
    def cell_seconds(self) -> DataFrame:
        return materialize(heatmap.heatmap_second(self.cells), "cell-seconds")

    @cached_property
    def spans(self) -> DataFrame:
        return materialize(heatmap.item_seconds(self.cells, self.p), "spans")

    @cached_property
    def intervals(self) -> DataFrame:
        return materialize(heatmap.heatmap_interval(self.cell_seconds, self.spans, self.p), "intervals")
