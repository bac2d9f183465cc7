"""Operators that need rows in event-time order, on streams whose rows arrive out of order.

Rows of a key wait in list state until the watermark has passed them; a timer then releases all that are due, in order,
to the rule of the operator, whose memory is state of its own. So a result does not depend on the order of arrival as
long as no row is later than the stated lateness; later ones are dropped. What waits is bounded by the lateness, and with
`forget` the memory of a key that has been silent for so long is removed as well.

The watermark is one clock for all keys. These operators need the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracklane.operators.asof import MATCH, SEQ, TS
from tracklane.operators.heatmap import heatmap_cell
from tracklane.operators.passes import SECOND_COLUMNS, matched_columns, second_events
from tracklane.params import Params

EVENT_TIME = "event_time"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Waiting rows that are kept as one element of state.
BLOCK = 1000

#: Rows in order and memory (None at first) in, output rows and memory out.
Rule = Callable[[list[Row], Any], tuple[list[tuple], Any]]


def use_state_store(spark: SparkSession) -> None:
    """Let the session's streams keep state in RocksDB, which the operators here need."""
    spark.conf.set(_STORE, _ROCKS)


def clock(time: str) -> Column:
    """Event time of a column in ms, one later: the clock starts at 0, and what is not after it counts as late."""
    return F.timestamp_millis(F.col(time) + 1)


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then hands them in order to `rule`."""

    def __init__(self, schema: T.StructType, order: list[str], rule: Rule, forget: int | None):
        self.schema, self.order, self.rule, self.forget = schema, order, rule, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # nested rows are beyond the schemas of state
        self.memory = handle.getValueState("memory", "memory binary")
        self.clock = handle.getValueState("clock", "timer long, newest long")

    @staticmethod
    def _packed(rows: list[tuple]) -> list[tuple]:
        """An element of list state for each block of rows: elements cost more than rows."""
        return [(pickle.dumps(rows[i:i + BLOCK]),) for i in range(0, len(rows), BLOCK)]

    def _set_timer(self, timer: int | None, newest: int, at: int | None) -> None:
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        self.clock.update((at, newest))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, passed = self.schema.names.index(self.order[0]), timerValues.getCurrentWatermarkInMs()
        new = [tuple(r[f] for f in self.schema.names) for r in rows if r[self.order[0]] + 1 > passed]
        if not new:
            return iter(())
        times = [r[at] + 1 for r in new]
        self.waiting.appendList(self._packed(new))
        timer, newest = self.clock.get() if self.clock.exists() else (None, None)
        newest = max(times) if newest is None else max(newest, *times)
        # rows may be waiting already, or the key may be waiting to be forgotten
        soonest = min(times)
        self._set_timer(timer, newest, soonest if timer is None else min(timer, soonest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        newest = self.clock.get()[1]
        row = Row(*self.schema.names)
        held = [row(*r) for block in self.waiting.get() for r in pickle.loads(block[0])] if self.waiting.exists() else []
        due = sorted((r for r in held if r[self.order[0]] < now), key=lambda r: tuple(r[c] for c in self.order))
        rest = [r for r in held if r[self.order[0]] >= now]
        out = []
        if due:
            memory = pickle.loads(self.memory.get()[0]) if self.memory.exists() else None
            out, memory = self.rule(due, memory)
            if memory is not None:
                self.memory.update((pickle.dumps(memory),))
            if rest:
                self.waiting.put(self._packed([tuple(r) for r in rest]))
            else:
                self.waiting.clear()
        if rest:
            self._set_timer(None, newest, min(r[self.order[0]] + 1 for r in rest))
        elif self.forget is None:
            self._set_timer(None, newest, None)
        elif newest + self.forget > now:
            self._set_timer(None, newest, newest + self.forget)
        else:
            self.memory.clear()
            self.clock.clear()
        return iter([Row(*self.names)(*r) for r in out])

    def close(self) -> None:
        pass


def in_order(
    df: DataFrame, keys: list[str], order: list[str], rule: Rule, schema: T.StructType, *, late_ms: int | None, forget_ms: int | None = None
) -> DataFrame:
    """Run `rule` over the rows of each key in `order` (the first column is event time in ms, all are not null).

    Rows that arrive more than `late_ms` behind the newest time of the whole stream are dropped; None if `df` has a
    watermark on `event_time` already. `forget_ms` after its last row a key starts from nothing.
    """
    use_state_store(df.sparkSession)
    if late_ms is not None:
        df = df.withColumn(EVENT_TIME, clock(order[0])).withWatermark(EVENT_TIME, f"{late_ms} milliseconds")
    held = T.StructType([f for f in df.schema.fields if f.name != EVENT_TIME])
    processor = InOrder(held, order, rule, forget_ms)
    processor.names = schema.names
    return df.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


def asof_join_stream(
    left: DataFrame, right: DataFrame, keys: list[str], values: dict[str, Column], *, late_ms: int, time: str = TS, seq: str = SEQ,
    inclusive: bool = True, forget_ms: int | None = None,
) -> DataFrame:
    """Each left row with the `values` of the latest right row at (or strictly before) its time, as in the batch operator."""
    found = right.select(*keys, time, seq, F.struct(*[v.alias(n) for n, v in values.items()]).alias("__r"), F.lit(0 if inclusive else 2).alias("__rank"))
    both = left.withColumn("__rank", F.lit(1)).unionByName(found, allowMissingColumns=True)
    schema = T.StructType([*left.schema.fields, *found.schema["__r"].dataType.fields])
    names, fields = left.columns, list(values)

    def rule(rows: list[Row], memory):
        out = []
        for r in rows:
            if r["__rank"] == 1:
                out.append((*(r[n] for n in names), *(memory[f] if memory else None for f in fields)))
            else:
                memory = r["__r"]
        return out, memory

    return in_order(both, keys, [time, "__rank", seq], rule, schema, late_ms=late_ms, forget_ms=forget_ms)


class Snapshots(InOrder):
    """As `InOrder`, with the latest fields of every object in map state: a release writes the objects that moved only."""

    def __init__(self, schema: T.StructType, order: list[str], trigger: str, fields: list[str], roster, forget: int | None):
        super().__init__(schema, order, self._snapshots, forget)
        self.trigger, self.fields, self.roster = trigger, fields, roster

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.latest = handle.getMapState("latest", "object_id string", T.StructType([self.schema[f] for f in self.fields]))

    def _snapshots(self, rows: list[Row], memory):
        known = {k[0]: tuple(v) for k, v in self.latest.iterator()}
        moved, out, ids = set(), [], {o for o, _ in self.roster}
        for r in rows:
            if r["object_id"] in ids:
                known[r["object_id"]] = tuple(r[f] for f in self.fields)
                moved.add(r["object_id"])
            if r[self.trigger] and len(known) == len(ids):
                out.append((*(r[n] for n in self.schema.names if n != self.trigger), [(o, t, *known[o]) for o, t in self.roster]))
        for o in moved:
            self.latest.updateValue((o,), known[o])
        return out, memory

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out = super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if not self.clock.exists():
            self.latest.clear()
        return out


def snapshot_stream(
    states: DataFrame, roster, fields: list[str], *, trigger: Column, late_ms: int, name: str = "objects", forget_ms: int | None = None
) -> DataFrame:
    """Latest `fields` of every roster object at each row of `states` that is a trigger, as in the batch operator.

    Rows for which an object of the roster has not been seen yet give none.
    """
    marked = states.withColumn("__trigger", F.coalesce(trigger, F.lit(False)))
    one = T.StructType([T.StructField("object_id", T.StringType()), T.StructField("team_id", T.StringType()), *[states.schema[f] for f in fields]])
    schema = T.StructType([*states.schema.fields, T.StructField(name, T.ArrayType(one))])
    timed = marked.withColumn(EVENT_TIME, clock(TS)).withWatermark(EVENT_TIME, f"{late_ms} milliseconds")
    use_state_store(states.sparkSession)
    processor = Snapshots(marked.schema, [TS, SEQ], "__trigger", fields, list(roster), forget_ms)
    processor.names = schema.names
    return timed.groupBy(MATCH).transformWithState(processor, schema, "Append", "EventTime")


def pass_shot_match_stream(
    kicks: DataFrame, changes: DataFrame, areas: DataFrame, kickoffs: DataFrame, p: Params, *, late_ms: int, forget_ms: int | None = None
) -> DataFrame:
    """Each kick with the first receipt or outside entry that follows within the time of a pass, as in the batch operator.

    The clock is that of kicks, sides and second events: other rows of `changes` and `areas` do not move it.
    A watermarked join of both streams over that time gives every second event its kicks, and kicks are forgotten once it is
    over. Behind it the pairs of a match are put in order, together with the sides of kickoffs: a second event belongs to its
    latest kick, and the first of a kick counts.
    """
    delay = f"{late_ms} milliseconds"
    kick_cols = [c for c in kicks.columns if c != MATCH]
    kick = kicks.select(F.col(MATCH).alias("__match"), F.struct(*kick_cols).alias("kick"), clock(TS).alias("__kick_time"))
    timed = lambda df: df.withColumn(EVENT_TIME, clock(TS)).withWatermark(EVENT_TIME, delay)
    second = timed(second_events(changes, areas, p))
    kick = kick.withWatermark("__kick_time", delay)
    longest = F.expr(f"interval {p.pass_max_ms} milliseconds")
    pairs = second.join(
        kick, (F.col(MATCH) == F.col("__match")) & (F.col(EVENT_TIME) > F.col("__kick_time")) & (F.col(EVENT_TIME) <= F.col("__kick_time") + longest)
    ).drop("__match", "__kick_time").withColumn("__rank", F.lit(1))
    sides = timed(kickoffs).select(MATCH, TS, SEQ, "left_team", F.lit(0).alias("__rank"), EVENT_TIME)
    both = pairs.unionByName(sides, allowMissingColumns=True)
    names = [MATCH, *SECOND_COLUMNS[:-1]]
    schema = T.StructType([*[pairs.schema[n] for n in names], T.StructField("left_team", T.StringType()), pairs.schema["kick"]])

    def rule(rows: list[Row], memory):
        side, last = memory or [None, None]
        out, at, pair = [], None, None

        def settle():
            nonlocal last
            if pair is None or side is None:
                return
            kick = [pair["kick"][TS], pair["kick"][SEQ]]
            if kick != last:
                last = kick
                out.append((*(pair[n] for n in names), side, pair["kick"]))

        for r in rows:
            if (r[TS], r["__rank"], r[SEQ]) != at:  # all pairs of one second event are next to each other
                settle()
                at, pair = (r[TS], r["__rank"], r[SEQ]), None
            if r["__rank"] == 0:
                side = r["left_team"] or side
            elif pair is None or (r["kick"][TS], r["kick"][SEQ]) > (pair["kick"][TS], pair["kick"][SEQ]):
                pair = r
        settle()
        return out, [side, last]

    found = in_order(both, [MATCH], [TS, "__rank", SEQ, "kind", "area_id"], rule, schema, late_ms=None, forget_ms=forget_ms)
    return found.select(*matched_columns())


def heatmap_interval_stream(states: DataFrame, p: Params, *, late_ms: int, forget_ms: int | None = None) -> DataFrame:
    """Cells of the last n seconds at every second of a match, per item and interval (0: whole match), as in the batch operator.

    The state of a match is a ring of the counts of its last seconds, as many as the longest interval has, and the running
    counts of each interval: a second adds its counts, and they leave an interval when it is over. A match has at most one
    grid per item and interval, whatever its length.
    """
    longest = max(p.intervals_s)
    cells = heatmap_cell(states, p).withColumn("second", F.floor(F.col(TS) / 1000))
    # a second is released as a whole, when it has ended
    whole = cells.select(MATCH, ((F.col("second") + 1) * 1000 - 1).alias("due"), "second", "object_id", "team_id", "cell_x", "cell_y")

    def rule(rows: list[Row], memory):
        last, ring, running = memory or (None, {}, {i: Counter() for i in p.intervals_s})
        out, match, counts = [], rows[0][MATCH], {}
        for r in rows:
            here = counts.setdefault(r["second"], Counter())
            for item in (r["object_id"], r["team_id"]):
                here[item, r["cell_x"], r["cell_y"]] += 1
        for second in range(min(counts) if last is None else last + 1, max(counts) + 1):
            new = counts.get(second, Counter())
            for i, run in running.items():
                for cell, n in ring.get(second - i, Counter()).items() if i else ():
                    run[cell] -= n
                    if not run[cell]:
                        del run[cell]
                run.update(new)
                out.extend((match, item, i, x, y, second, n) for (item, x, y), n in run.items())
            if new:
                ring[second] = new
            ring.pop(second - longest, None)
        return out, (max(counts), ring, running)

    schema = T.StructType([states.schema[MATCH], T.StructField("item", T.StringType()), *[
        T.StructField(c, T.LongType()) for c in ("interval_s", "cell_x", "cell_y", "second", "n")]])
    return in_order(whole, [MATCH], ["due"], rule, schema, late_ms=late_ms + 1000, forget_ms=forget_ms)
