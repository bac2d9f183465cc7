"""Running computations over keyed, ordered rows that stay parallel inside one key.

A plain window over a key puts the whole key into one task. Here every key is cut into time chunks:
windows run inside (key, chunk); one summary row per chunk is carried forward over the key; a join
brings the carry back. Only the summaries (key's time span / chunk width rows) meet per key, so one
key holding a third of all rows is still spread over its chunks. All specs given to one `scan` share
one exchange and one sort, and successive scans with the same keys reuse that partitioning.

Keys must not be null and `order` must be a total order whose first column is a number (time), the last a whole number
in [0, 10^18) and those between single digits; rows that break this end the job with an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.session import materialize

CHUNK = "__chunk"
MAX_CHUNK_ROWS = 5_000_000


@dataclass(frozen=True)
class Last:
    """Latest non-null value up to the row (or up to the row before it)."""

    name: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Total:
    """Running sum, 0 before the first value."""

    name: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class High:
    """Running maximum."""

    name: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Low:
    """Running minimum."""

    name: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Prev:
    """Value of the row before, null included; pass a struct to tell 'no row' from 'null value'."""

    name: str
    value: Column


@dataclass(frozen=True)
class History:
    """The last `n` non-null values, newest first, the row's own included."""

    name: str
    value: Column
    n: int


@dataclass(frozen=True)
class Slots:
    """Latest `fields` of each listed id, one column `prefix + position` per id."""

    prefix: str
    id: str
    ids: tuple[str, ...]
    fields: tuple[str, ...]

    @property
    def lasts(self) -> list[Last]:
        return [Last(f"{self.prefix}{i}", F.when(F.col(self.id) == o, F.struct(*self.fields))) for i, o in enumerate(self.ids)]


def with_chunk(df: DataFrame, time: str, width: int) -> DataFrame:
    """Add the chunk number, unless an earlier scan of the same plan already did."""
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, F.floor(F.col(time) / F.lit(width)))


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equality that takes nulls for equal; columns of `on` come from the left."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"__r_{c}"]) for c in on])
    return left.join(other, same, how).drop(*[f"__r_{c}" for c in on])


def split_hot(df: DataFrame, keys: list[str], time: str, width: int, max_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """Add chunks of `width`, cut finer wherever a key has more than `max_rows` rows in one.

    Counting needs the key and time columns only. The table of crowded chunks has at most rows / max_rows entries.
    A chunk number is the start of its time range, so finer chunks keep the order.
    """
    if CHUNK in df.columns:
        return df
    at = F.col(time)
    out = df.withColumn(CHUNK, F.floor(at / F.lit(width)) * width).withColumn("__w", F.lit(width).cast("bigint"))
    while True:
        crowded = out.groupBy(*keys, CHUNK, "__w").count().filter((F.col("count") > max_rows) & (F.col("__w") > 1))
        if crowded.isEmpty():
            return out.drop("__w")
        finer = F.greatest(F.lit(1), F.floor(F.col("__w") / F.ceil(F.col("count") / max_rows)))
        crowded = materialize(crowded.select(*keys, CHUNK, finer.alias("__n")), "crowded-chunks")
        out = null_safe_join(out, crowded, [*keys, CHUNK], "left").withColumn(
            CHUNK, F.col(CHUNK) + F.when(F.col("__n").isNull(), 0).otherwise(F.floor((at - F.col(CHUNK)) / F.col("__n")) * F.col("__n"))
        ).withColumn("__w", F.coalesce("__n", "__w")).drop("__n")


def _local(spec, v: Column, w, upto, before):
    frame = upto if getattr(spec, "inclusive", True) else before
    match spec:
        case Last():
            return F.last(v, ignorenulls=True).over(frame)
        case Total():
            return F.sum(v).over(frame)
        case High():
            return F.max(v).over(frame)
        case Low():
            return F.min(v).over(frame)
        case Prev():
            return F.lag(F.struct(v.alias("v")), 1).over(w)
        case History():
            return F.count(v).over(upto)


def _position(order: list[str]) -> Column:
    """The order as one number (the middle columns are single digits, the last is below 10^18): unlike a
    struct it is a fixed-width aggregation buffer, so the summary is a hash aggregation without a sort."""
    if len(order) == 1:
        return F.col(order[0])
    whole = lambda c: c.cast("decimal(38,0)")
    scale = lambda n: whole(F.lit(str(10**n)))
    at = whole(F.col(order[-1]))
    for i, c in enumerate(reversed(order[:-1])):
        at = at + whole(F.col(c)) * scale(18 + i)
    return at


_FIXED_WIDTH = (T.NumericType, T.BooleanType)


def _pick(v: Column, dtype: T.DataType, at: Column) -> Column:
    """`v` at the greatest position; structs of fixed-width fields are taken field by field."""
    if isinstance(dtype, T.StructType) and all(isinstance(f.dataType, _FIXED_WIDTH) for f in dtype):
        parts = F.struct(*[F.max_by(v[f.name], at).alias(f.name) for f in dtype])
        return F.when(F.max(at).isNotNull(), parts)
    return F.max_by(v, at)


def _summary(spec, v: Column, local: Column, dtype: T.DataType, at: Column):
    match spec:
        case Last():
            return _pick(v, dtype, F.when(v.isNotNull(), at))
        case Total():
            return F.sum(v)
        case High():
            return F.max(v)
        case Low():
            return F.min(v)
        case Prev():
            if isinstance(dtype, T.StructType):  # a null struct must stay apart from a struct of nulls
                there = F.max_by(v.isNotNull(), at)
                return F.struct(F.when(there, _pick(v, dtype, at)).alias("v"))
            return F.struct(F.max_by(v, at).alias("v"))
        case History():
            return F.max_by(local, at)


def _slot_summary(base: DataFrame, keys: list[str], spec: Slots, names: list[str], at: Column) -> DataFrame:
    """Last values per chunk and id first, then side by side: one update per row instead of one per slot."""
    per_id = base.groupBy(*keys, CHUNK, spec.id).agg(*[F.max_by(f, at).alias(f"__f_{f}") for f in spec.fields])
    value = F.struct(*[F.col(f"__f_{f}").alias(f) for f in spec.fields])
    return per_id.groupBy(*keys, CHUNK).agg(
        *[F.max(F.when(F.col(spec.id) == o, value)).alias(n) for o, n in zip(spec.ids, names)]
    )


def _carry(spec, s: Column, w):
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    match spec:
        case Last() | Prev():
            return F.last(s, ignorenulls=True).over(before)
        case Total():
            return F.sum(s).over(before)
        case High():
            return F.max(s).over(before)
        case Low():
            return F.min(s).over(before)


def _tail(carry: DataFrame, spec: History, value: str, name: str, across) -> DataFrame:
    """Add the last `n` values of the chunks before: n chunks that hold a value hold at least n of them,
    so the frame reaches back n such chunks; chunks without a value take no place in it."""
    has = F.size(value) > 0
    filled = F.sum(F.when(has, 1).otherwise(0)).over(across.rowsBetween(Window.unboundedPreceding, 0))
    reach = Window.partitionBy(*[F.col(k) for k in carry.columns[: carry.columns.index(CHUNK)]])
    reach = reach.orderBy("__filled").rangeBetween(-spec.n, 0)
    near = F.sort_array(F.collect_list(F.when(has, F.struct(F.col(CHUNK).alias("c"), F.col(value).alias("v")))).over(reach))
    earlier = F.flatten(F.transform(F.filter(near, lambda t: t["c"] < F.col(CHUNK)), lambda t: t["v"]))
    return (
        carry.withColumn("__filled", filled)
        .withColumn("__tail", earlier)
        .withColumn(name, F.slice("__tail", F.greatest(F.lit(1), F.size("__tail") - spec.n + 1), spec.n))
        .drop("__filled", "__tail")
    )


def _combine(spec, local: Column, carry: Column) -> Column:
    match spec:
        case Last():
            return F.coalesce(local, carry)
        case Total():
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        case High():
            return F.greatest(local, carry)
        case Low():
            return F.least(local, carry)
        case Prev():
            return F.coalesce(local, carry)["v"]
        case History():
            whole = F.when(F.size(local) < spec.n, F.concat(F.coalesce(carry, F.slice(local, 1, 0)), local)).otherwise(local)
            return F.slice(F.reverse(whole), 1, spec.n)


def allowed(keys: list[str], order: list[str]) -> Column:
    """True, or an error: null keys would lose their carry, and other orders would not fit one number."""
    bad = F.lit(False)
    for c in (*keys, *order):
        bad = bad | F.col(c).isNull()
    for c in order[1:-1]:
        bad = bad | ~F.col(c).between(0, 9)
    if len(order) > 1:
        bad = bad | (F.col(order[-1]) < 0) | (F.col(order[-1]) >= 10**18)
    return F.when(bad, F.raise_error("null key or time, or an order that is out of range").cast("boolean")).otherwise(True)


def scan(df: DataFrame, keys: list[str], order: list[str], width: int, *specs) -> DataFrame:
    """Add one column per spec, each running over `keys` in `order`; see the module text."""
    plain = df.columns
    df = with_chunk(df, order[0], width).filter(allowed(keys, order))
    groups = [s for s in specs if isinstance(s, Slots)]
    specs = [s for s in specs if not isinstance(s, Slots)]
    single = len(specs)
    specs += [last for g in groups for last in g.lasts]
    values = [f"__v{i}" for i in range(len(specs))]
    local = [f"__l{i}" for i in range(len(specs))]
    carried = [f"__c{i}" for i in range(len(specs))]
    at = _position(order)

    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = df.select("*", *[s.value.alias(v) for s, v in zip(specs, values)])
    rows = base.select(
        "*", *[_local(s, F.col(v), w, upto, before).alias(c) for s, v, c in zip(specs, values, local)]
    )

    windowed = False
    for s, v, c in zip(specs, values, local):
        if isinstance(s, History):  # frames count values, not rows: null rows take no place
            windowed = True
            counted = Window.partitionBy(*keys, CHUNK).orderBy(c).rangeBetween(-(s.n - 1), 0)
            rows = rows.withColumn(c, F.collect_list(v).over(counted))
    summary, used = None, single
    if single:
        types = [base.schema[v].dataType for v in values[:single]]
        summary = (rows if windowed else base).groupBy(*keys, CHUNK).agg(*[
            _summary(s, F.col(v), F.col(c), t, at).alias(v)
            for s, v, c, t in zip(specs[:single], values, local, types)
        ])
    for g in groups:
        part = _slot_summary(df, keys, g, values[used:used + len(g.ids)], at)
        summary = part if summary is None else summary.join(part, [*keys, CHUNK])
        used += len(g.ids)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    direct = [(s, v, c) for s, v, c in zip(specs, values, carried) if not isinstance(s, History)]
    carry = summary.select(*keys, CHUNK, *values, *[_carry(s, F.col(v), across).alias(c) for s, v, c in direct])
    for s, v, c in zip(specs, values, carried):
        if isinstance(s, History):
            carry = _tail(carry, s, v, c, across)
    carry = carry.drop(*values)

    # a carry grows with the input and is often far larger than estimated: it must not pass through the driver
    joined = rows.join(carry.hint("merge"), [*keys, CHUNK], "left")
    return joined.select(
        *[F.col(c) for c in plain],
        *([F.col(CHUNK)] if CHUNK not in plain else []),
        *[_combine(s, F.col(a), F.col(b)).alias(s.name) for s, a, b in zip(specs, local, carried)],
    )


def done(df: DataFrame) -> DataFrame:
    """Drop the helper columns a chain of scans leaves."""
    return df.drop(*[c for c in df.columns if c.startswith("__")])
