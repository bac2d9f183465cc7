"""The keyed operators on unbounded streams.

Sequential rules are the same step functions the batch operators use; their state lives in Spark's state
store, one entry per key, and a micro-batch hands over the new rows of a key only. Windowed counts use
event-time windows with a watermark.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklane.operators.heatmap import heatmap_cell
from tracklane.operators.stateful import Step, deadband_step, debounce_step
from tracklane.params import Params

_STATE = T.StructType([T.StructField("state", T.StringType())])


def in_order(rows: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """`rows` sorted as by `sort_values`, which costs more than most keys' rows in a micro-batch are worth."""
    by = [rows[c].to_numpy() for c in order]
    if any(v.dtype.kind not in "iuf" for v in by):
        return rows.sort_values(order, kind="stable")
    if len(rows) < 2 or (by[0][1:] > by[0][:-1]).all():
        return rows
    return rows.take(np.lexsort(by[::-1]))


def stateful_stream(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: T.StructType) -> DataFrame:
    """Run `step` over the rows of each key as they arrive, ordered inside each micro-batch."""
    names = schema.fieldNames()

    def run(key, batches, state: GroupState):
        parts = list(batches)
        rows = in_order(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True), order)
        out, left = step(rows, json.loads(state.get[0]) if state.exists else None)
        if left is not None:
            state.update((json.dumps(left),))
        yield out if list(out.columns) == names else out[names]

    return df.groupBy(*keys).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def debounce_stream(df: DataFrame, keys: list[str], gap: int, *, time: str = "generation_ts", seq: str = "seq") -> DataFrame:
    return stateful_stream(df, keys, [time, seq], debounce_step(gap, time), df.schema)


def deadband_stream(
    df: DataFrame, keys: list[str], measures: list[str], epsilon: float, *, time: str = "generation_ts", seq: str = "seq"
) -> DataFrame:
    return stateful_stream(df, keys, [time, seq], deadband_step(measures, epsilon), df.schema)


def emit_on_change_stream(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before; the first row counts."""

    def step(pdf, state):
        values = [None if v is None or v != v else v for v in pdf[value].tolist()]  # a null number arrives as NaN
        before = [state[0] if state else None, *values[:-1]]
        known = [state is not None] + [True] * (len(values) - 1)
        return pdf[[not k or b != v for k, b, v in zip(known, before, values)]], [values[-1]]

    return stateful_stream(df, keys, order, step, df.schema)


def phase_step(identity: str) -> Step:
    """START / ACTIVE / END of a non-atomic event; a change of identity ends it, the next row may start it."""

    def step(pdf, state):
        current, number = state or [None, 0]
        out = []
        for x in pdf[identity].tolist():
            x = None if x is None or x != x else x
            if current is None:
                phase, who = (None, None) if x is None else ("START", x)
                number += phase is not None
                current = x
            elif x == current:
                phase, who = "ACTIVE", x
            else:
                phase, who, current = "END", current, None
            out.append((phase, who, number))
        kept = [o[0] is not None for o in out]
        phases, who, numbers = zip(*[o for o in out if o[0] is not None]) if any(kept) else ([], [], [])
        return pd.DataFrame({
            **{c: pdf[c].to_numpy()[kept] for c in pdf.columns}, "phase": list(phases), "identity": list(who), "event_no": list(numbers),
        }), [current, number]

    return step


def phase_events_stream(df: DataFrame, keys: list[str], order: list[str], identity: str) -> DataFrame:
    """Rows of `df` with identity, phase and event number, as in the batch operator."""
    kept = [f for f in df.schema.fields if f.name not in ("identity", "phase", "event_no")]
    schema = T.StructType(kept + [
        T.StructField("identity", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("event_no", T.LongType()),
    ])
    return stateful_stream(df, keys, order, phase_step(identity), schema)


def velocity_stream(raw: DataFrame, p: Params) -> DataFrame:
    """Velocities of raw readings from the last two samples of each object (0 for the first)."""
    schema = T.StructType(raw.schema.fields + [T.StructField(c, T.DoubleType()) for c in ("vx", "vy", "vz", "vabs")])

    def step(pdf, state):
        last, out = state, []
        for row in zip(*[pdf[c].tolist() for c in ("generation_ts", "x", "y", "z")]):
            dt = row[0] - last[0] if last else 0
            out.append([(b - a) / dt * p.velocity_scale if dt else 0.0 for a, b in zip((last or row)[1:], row[1:])])
            last = list(row)
        v = list(zip(*out))
        return pdf.assign(vx=v[0], vy=v[1], vz=v[2], vabs=[math.sqrt(sum(c * c for c in o)) for o in out]), last

    return stateful_stream(raw, ["match_id", "object_id"], ["generation_ts", "seq"], step, schema)


def active_key_ticks_stream(df: DataFrame, key: str, period: int, threshold: int, *, time: str = "generation_ts") -> DataFrame:
    """Ticks of active keys, as in the batch operator; `df` needs a watermark on a timestamp column.

    A tick is known once a later reading of the key arrives, or once the watermark passes it: the timer
    then emits the tick that covers the key's last reading and forgets the key when it became inactive.
    """
    schema = T.StructType([
        df.schema[key], T.StructField("tick_ts", T.LongType()), T.StructField("max_generation_ts", T.LongType()),
    ])
    memory = T.StructType([T.StructField("last", T.LongType()), T.StructField("next", T.LongType())])

    def run(group, batches, state: GroupState):
        last, upcoming = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            if upcoming * period - last <= threshold:
                out.append((group[0], upcoming * period, last))
            if state.getCurrentWatermarkMs() - last > threshold:
                state.remove()
            else:
                state.update((last, upcoming + 1))
                state.setTimeoutTimestamp(max((upcoming + 1) * period, state.getCurrentWatermarkMs() + 1))
        else:
            for ts in sorted(t for b in batches for t in b[time].tolist()):
                if last is None:
                    upcoming = -(-ts // period)
                while upcoming * period < ts and upcoming * period - last <= threshold:
                    out.append((group[0], upcoming * period, last))
                    upcoming += 1
                upcoming = max(upcoming, -(-ts // period))
                last = ts if last is None else max(last, ts)
            state.update((last, upcoming))
            state.setTimeoutTimestamp(max(upcoming * period, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=schema.fieldNames())

    return df.groupBy(key).applyInPandasWithState(run, schema, memory, "append", GroupStateTimeout.EventTimeTimeout)


def heatmap_stream(states: DataFrame, p: Params, *, late: str | None, seconds: int = 1) -> DataFrame:
    """Cell counts per player and team over tumbling seconds, or over the last `seconds` every second.

    The watermark is one clock for all matches: with `late`, readings that are older than that by the clock of the match
    furthest on are dropped. None keeps every reading, in any order of matches, and state for as long as the stream runs.
    """
    cells = heatmap_cell(states, p).withColumn("event_time", F.timestamp_millis(F.col("generation_ts")))
    item = F.explode(F.array("object_id", "team_id")).alias("item")
    span = F.window("event_time", f"{seconds} seconds", "1 second")
    timed = cells if late is None else cells.withWatermark("event_time", late)
    counts = timed.select("match_id", "event_time", item, "cell_x", "cell_y").groupBy(
        "match_id", span.alias("w"), "item", "cell_x", "cell_y"
    ).agg(F.count("*").alias("n"))
    return counts.select("match_id", (F.unix_seconds("w.end") - 1).alias("second"), "item", "cell_x", "cell_y", "n")
