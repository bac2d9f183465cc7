"""Generic keyed-stream operators: state look-ups, change detection, ticks and phases.

Their keys may have any rate, so chunks are cut finer where a key is crowded before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions.extract import extract
from tracklane.operators.ordered import High, History, Last, Prev, Total, done, scan, split_hot
from tracklane.session import materialize


def latest_value(df, keys, order, width, value: Column, name: str, default=None) -> DataFrame:
    """Running last non-null value per key; an unset value reads as `default`."""
    out = done(scan(split_hot(df, keys, order[0], width), keys, order, width, Last(name, value)))
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def running_increase(df, keys, order, width, delta: Column, name: str) -> DataFrame:
    """Running sum of deltas per key."""
    return done(scan(split_hot(df, keys, order[0], width), keys, order, width, Total(name, delta)))


def history_n(df, keys, order, width, value: Column, n: int, name: str) -> DataFrame:
    """The last `n` values per key, newest first."""
    return done(scan(split_hot(df, keys, order[0], width), keys, order, width, History(name, value, n)))


def store_many(df, keys, order, width, entries: list[tuple[str, str, int | None, str]], forward: bool = True) -> DataFrame:
    """Apply several store entries (name, extractor, history length or None, type) in one pass.

    The declared type of an entry must match the type its extractor yields.
    """
    specs = []
    for name, spec, n, kind in entries:
        value = extract(df, spec)
        found = df.select(value.alias("v")).schema["v"].dataType.simpleString()
        if found != kind:
            raise TypeError(f"entry {name}: extractor {spec} yields {found}, not {kind}")
        specs.append(History(name, value, n) if n else Last(name, value))
    out = done(scan(split_hot(df, keys, order[0], width), keys, order, width, *specs))
    return out if forward else out.select(*keys, *order, *[s.name for s in specs])


def emit_on_change(df, keys, order, width, value: Column, *, first: bool = True) -> DataFrame:
    """Rows whose value differs from the row before; the first row of a key counts if `first`."""
    out = scan(split_hot(df, keys, order[0], width), keys, order, width, Prev("__p", F.struct(value.alias("v"))))
    changed = F.col("__p").isNull() if first else F.lit(False)
    return done(out.filter(changed | (F.col("__p").isNotNull() & ~F.col("__p.v").eqNullSafe(value))))


def active_keys(df: DataFrame, key: str, processing: Column, generation: Column) -> DataFrame:
    """Per key the last processing time and the newest generation time seen."""
    return df.groupBy(key).agg(F.max(processing).alias("last_processing_ts"), F.max(generation).alias("max_generation_ts"))


def active_key_ticks(
    df: DataFrame, key: str, period: int, threshold: int, width: int, *, time: str = "generation_ts"
) -> DataFrame:
    """Every multiple of `period` while a key is active: (key, tick_ts, max_generation_ts).

    A tick is emitted when the latest reading at or before it is at most `threshold` old, from the first
    reading to the tick that covers the last one. Readings are reduced to one row per (key, period)
    before anything is ordered; silent periods are filled from the reading before, `threshold` at most.
    """
    bucket = F.ceil(F.col(time) / F.lit(period))
    seen = df.groupBy(key, bucket.alias("__b")).agg(F.max(time).alias("__ts"))
    seen = scan(seen, [key], ["__b"], max(1, width // period), Prev("__p", F.struct("__b", "__ts")))
    last_fill = F.least(F.col("__b") - 1, F.floor((F.col("__p.__ts") + threshold) / F.lit(period)))
    first_fill = F.col("__p.__b") + 1
    fills = F.when(
        F.col("__p").isNotNull() & (first_fill <= last_fill),
        F.transform(
            F.sequence(first_fill, last_fill),
            lambda b: F.struct(b.alias("b"), F.col("__p.__ts").alias("ts")),
        ),
    )
    own = F.when(
        F.col("__b") * period - F.col("__ts") <= threshold,
        F.array(F.struct(F.col("__b").alias("b"), F.col("__ts").alias("ts"))),
    )
    ticks = F.concat(*[F.coalesce(a, F.array().cast("array<struct<b:bigint,ts:bigint>>")) for a in (fills, own)])
    return seen.select(key, F.explode(ticks).alias("__k")).select(
        key, (F.col("__k.b") * period).alias("tick_ts"), F.col("__k.ts").alias("max_generation_ts")
    )


def phase_events(
    df: DataFrame, keys: list[str], order: list[str], width: int, identity: Column, payload: list[str]
) -> DataFrame:
    """START / ACTIVE / END rows of a non-atomic event whose identity (null: none) is known per row.

    A change of identity first ends the event; the new one starts on a later row. So a row either sets
    the state (no identity: off; same identity as before: on) or toggles it (new identity). The state
    before a row is the last set value, flipped once per toggle since: two running sums, no row loop.
    END rows carry the identity that ends.
    """
    df = split_hot(df, keys, order[0], width).withColumn("__x", identity)
    rows = scan(df, keys, order, width, Prev("__px", F.col("__x")))
    sparse = rows.filter(F.col("__x").isNotNull() | F.col("__px").isNotNull())
    toggle = F.col("__x").isNotNull() & ~F.col("__x").eqNullSafe(F.col("__px"))
    sparse = materialize(sparse.withColumn("__toggle", toggle.cast("int")), "phase-rows")
    counted = scan(sparse, keys, order, width, Total("__t", F.col("__toggle")))
    set_here = F.when(
        F.col("__toggle") == 0, F.struct(F.col("__x").isNotNull().alias("on"), F.col("__t").alias("t"))
    )
    known = scan(counted, keys, order, width, Last("__set", set_here, inclusive=False))
    flips = F.col("__t") - F.col("__toggle") - F.coalesce("__set.t", F.lit(0))
    was_on = F.coalesce("__set.on", F.lit(False)) != (flips % 2 == 1)
    phase = (
        F.when(F.col("__x").isNull() | (F.col("__toggle") == 1), F.when(was_on, "END").when(F.col("__x").isNotNull(), "START"))
        .when(was_on, "ACTIVE").otherwise("START")
    )
    phases = known.withColumn("phase", phase).filter(F.col("phase").isNotNull())
    phases = phases.withColumn("identity", F.when(F.col("phase") == "END", F.col("__px")).otherwise(F.col("__x")))
    numbered = scan(phases, keys, order, width, Total("event_no", (F.col("phase") == "START").cast("bigint")))
    return numbered.select(*keys, *order, *payload, "identity", "phase", "event_no")


def item_rollup(df: DataFrame, player: str, team: str, name: str = "item") -> DataFrame:
    """Count each row for its player and its team."""
    return df.withColumn(name, F.explode(F.array(player, team)))


def initial_statistics(df: DataFrame, key: str, items, statistics: str, *, time: str = "generation_ts") -> DataFrame:
    """The first element of each key also emits a zero row for every item."""
    return df.groupBy(key).agg(F.min(time).alias(time)).select(
        key, time, F.lit(statistics).alias("statistics"), F.explode(F.array(*[F.lit(i) for i in items])).alias("item")
    )


def running_high(df, keys, order, width, value: Column, name: str) -> DataFrame:
    """Running maximum per key."""
    return done(scan(split_hot(df, keys, order[0], width), keys, order, width, High(name, value)))


def union_streams(*streams: DataFrame) -> DataFrame:
    """All rows of several streams; columns a stream lacks are null."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
