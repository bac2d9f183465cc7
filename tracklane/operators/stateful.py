"""Greedy sequential rules (the next result depends on the last accepted row) over keyed rows.

Keys of at most MAX_KEY_ROWS rows run whole. Larger ones are cut into time chunks that run side by side; chunks of more rows
than that are cut finer. A chunk does not know the state it starts from, so a first pass describes it as a function of that
state; a second composes these descriptions in order, key by key, as they stream through a task, one in memory at a time; a
third runs the rule in each chunk from the state that is now known. That is exact and three passes for any number of chunks, without rounds.
A description holds what a state at the chunk's start can reach first and no more, so it is bounded by a chunk. Nulls in
keys are a key of their own; rows without a time take no part.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.operators.ordered import CHUNK, null_safe_join, split_hot
from tracklane.session import materialize

MAX_KEY_ROWS = 50_000

Step = Callable[[pd.DataFrame, list | None], tuple[pd.DataFrame, list | None]]


def chunked_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    width: int,
    step: Step,
    describe: Callable[[pd.DataFrame], list | dict],
    follow: Callable[[list | None, list | dict], list | None],
    *,
    schema: T.StructType | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """What `step` makes of the rows of `df`: rows of `schema`, that of `df` if none is given.

    `describe(rows of a chunk)` is JSON-able, and `follow(state, description)` is the state in which the chunk leaves `state`.
    """
    schema, max_rows = schema or df.schema, max_rows or MAX_KEY_ROWS
    # stored once: the rows are read several times, and a plan joined to itself would be optimized as a whole
    rows = materialize(df.filter(F.col(order[0]).isNotNull()), "scan-rows")
    parts, names = [*keys, CHUNK], schema.fieldNames()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(order, kind="stable"), None)[0][names]

    hot = rows.groupBy(*keys).count().filter(F.col("count") > max_rows).select(*keys)
    if hot.isEmpty():
        return rows.groupBy(*keys).applyInPandas(whole, schema)
    marked = null_safe_join(rows, materialize(hot, "hot-keys").withColumn("__hot", F.lit(True)), keys, "left")
    calm = marked.filter("__hot is null").drop("__hot").groupBy(*keys).applyInPandas(whole, schema)
    rows = split_hot(materialize(marked.filter("__hot").drop("__hot"), "hot-rows"), keys, order[0], width, max_rows)
    fields = [rows.schema[c] for c in parts]
    text_of = lambda name: T.StructType([*fields, T.StructField(name, T.StringType())])

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        said = json.dumps(describe(pdf.sort_values(order, kind="stable")))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in parts}, "__said": [said]})

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for pdf in frames:
            before = []
            for *values, said in zip(*[pdf[c] for c in keys], pdf["__said"]):
                now = tuple(None if pd.isna(v) else v for v in values)
                if now != key:
                    key, state = now, None
                before.append(None if state is None else json.dumps(state))
                state = follow(state, json.loads(said))
            yield pdf[parts].assign(__in=before)

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf["__in"].iloc[0]
        state = json.loads(text) if isinstance(text, str) else None
        return step(pdf.drop(columns="__in").sort_values(order, kind="stable"), state)[0][names]

    said = rows.groupBy(*parts).applyInPandas(summary, text_of("__said"))
    states = said.repartition(*keys).sortWithinPartitions(*parts).mapInPandas(compose, text_of("__in"))
    return null_safe_join(rows, states, parts).groupBy(*parts).applyInPandas(emit, schema).unionByName(calm)


def debounce_step(gap: int, time: str = "generation_ts") -> Step:
    """Keep a candidate only if more than `gap` after the last kept one, or if the clock went back."""

    def step(pdf, state):
        last = state[0] if state else None
        keep = []
        for ts in pdf[time].tolist():
            ok = last is None or ts - last > gap or last > ts
            keep.append(ok)
            if ok:
                last = ts
        return pdf[keep], None if last is None else [last]

    return step


def debounce_chunk(gap: int, time: str = "generation_ts"):
    """A chunk of candidates as the pairs (first kept, last kept) for every candidate that can be the first.

    The state is the last kept time t. Candidates are sorted, so t is at most the chunk's first time, and the first
    kept one is at most the one that follows the first candidate: later ones cannot be first.
    """

    def describe(pdf: pd.DataFrame) -> list:
        ts = pdf[time].to_numpy()
        following = np.searchsorted(ts, ts + gap, "right").tolist()
        last = ts.tolist()
        for i in range(len(ts) - 1, -1, -1):
            if following[i] < len(ts):
                last[i] = last[following[i]]
        n = min(len(ts), following[0] + 1)
        return [ts[:n].tolist(), last[:n]]

    def follow(state: list | None, said: list) -> list | None:
        first, last = said
        i = 0 if state is None else bisect.bisect_right(first, state[0] + gap)
        return [last[i]] if i < len(first) else state

    return describe, follow


def _known(v) -> bool:
    return v is not None and v == v


def deadband_step(measures: list[str], epsilon: float) -> Step:
    """Keep a row when a measure moved more than `epsilon` from its stored value; only those are replaced.

    A null or NaN measure has not moved and stores nothing; the first known value of a measure counts as moved.
    """

    def step(pdf, state):
        last = list(state) if state else [None] * len(measures)
        keep = []
        for row in zip(*[pdf[m].tolist() for m in measures]):
            moved = [_known(v) and (old is None or abs(old - v) > epsilon) for old, v in zip(last, row)]
            last = [v if m else old for m, old, v in zip(moved, last, row)]
            keep.append(any(moved))
        return pdf[keep], last

    return step


def deadband_chunk(measures: list[str], epsilon: float):
    """A chunk as, for each measure, its records and where the rule ends if it first moves there.

    From a stored value s the first move is to the first value above s + epsilon or below s - epsilon, which is always a
    new maximum or minimum of the chunk; the first known value v is both. Either v itself is the first move, or s is within
    epsilon of it, so records up to the first that is more than 2 epsilon from v tell all.
    """

    def reach(known: np.ndarray, records: np.ndarray) -> np.ndarray:
        beyond = np.flatnonzero(np.abs(known[records] - known[0]) > 2 * epsilon)
        return records[:beyond[0] + 1] if len(beyond) else records

    def one(values: list) -> list:
        known = np.array([v for v in values if _known(v)], float)
        if not len(known):
            return [[], [], [], []]
        high = np.flatnonzero(known > np.concatenate([[-np.inf], np.maximum.accumulate(known)[:-1]]))
        low = np.flatnonzero(known < np.concatenate([[np.inf], np.minimum.accumulate(known)[:-1]]))
        high, low = reach(known, high), reach(known, low)
        ends: dict[int, float] = {}

        def end_of(i: int) -> float:
            path = []
            while i not in ends:
                path.append(i)
                at, size, found = i + 1, 16, -1
                while at < len(known) and found < 0:
                    far = np.flatnonzero(np.abs(known[at:at + size] - known[i]) > epsilon)
                    found = at + int(far[0]) if len(far) else -1
                    at, size = at + size, 2 * size
                if found < 0:
                    ends[i] = float(known[i])
                else:
                    i = found
            for j in path:
                ends[j] = ends[i]
            return ends[i]

        # records in order: value, position, end
        return [known[high].tolist(), [[int(i), end_of(int(i))] for i in high], (-known[low]).tolist(), [[int(i), end_of(int(i))] for i in low]]

    def describe(pdf: pd.DataFrame) -> list:
        return [one(pdf[m].tolist()) for m in measures]

    def follow(state: list | None, said: list) -> list:
        state = list(state) if state else [None] * len(measures)
        for k, (high, high_at, low, low_at) in enumerate(said):
            if not high:
                continue
            if state[k] is None:
                state[k] = high_at[0][1]
                continue
            s = state[k]
            i = next((j for j in range(bisect.bisect_left(high, s), len(high)) if abs(s - high[j]) > epsilon), len(high))
            j = next((j for j in range(bisect.bisect_left(low, -s), len(low)) if abs(s + low[j]) > epsilon), len(low))
            found = [x[y] for x, y in ((high_at, i), (low_at, j)) if y < len(x)]
            if found:
                state[k] = min(found)[1]
        return state

    return describe, follow


def debounce(
    df: DataFrame, keys: list[str], gap: int, width: int, *, time: str = "generation_ts", seq: str = "seq"
) -> DataFrame:
    """Candidates that survive `debounce_step` per key."""
    return chunked_scan(df, keys, [time, seq], width, debounce_step(gap, time), *debounce_chunk(gap, time))


def deadband(
    df: DataFrame,
    keys: list[str],
    measures: list[str],
    epsilon: float,
    width: int,
    *,
    time: str = "generation_ts",
    seq: str = "seq",
) -> DataFrame:
    """Rows that survive `deadband_step` per key."""
    return chunked_scan(df, keys, [time, seq], width, deadband_step(measures, epsilon), *deadband_chunk(measures, epsilon))
