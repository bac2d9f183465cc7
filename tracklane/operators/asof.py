"""As-of look-ups: the latest row of another stream, and the latest state of every roster object."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.operators.ordered import Last, Slots, scan, split_hot

TS, SEQ, MATCH = "generation_ts", "seq", "match_id"
ORDER = [TS, SEQ]


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    width: int,
    *,
    time: str = TS,
    seq: str = SEQ,
    inclusive: bool = True,
    crowded: bool = True,
) -> DataFrame:
    """Each left row with the `values` of the latest right row at (or strictly before) its time.

    One union and one scan instead of an inequality join: no pair of rows is ever built. Among right
    rows of one time the highest `seq` counts. Keys of bounded rate (sensors) may switch off `crowded`,
    the count that cuts chunks with too many rows.
    """
    other = right.select(
        *keys, time, seq, F.struct(*[v.alias(n) for n, v in values.items()]).alias("__r"),
        F.lit(0 if inclusive else 2).alias("__rank"),
    )
    both = left.withColumn("__rank", F.lit(1)).unionByName(other, allowMissingColumns=True)
    if crowded:
        both = split_hot(both, keys, time, width)
    found = scan(both, keys, [time, "__rank", seq], width, Last("__m", F.col("__r"))).filter("__rank = 1")
    return found.select(*left.columns, *[F.col(f"__m.{n}").alias(n) for n in values])


def slot_specs(roster, fields: list[str], object_id: str = "object_id") -> list[Slots]:
    """One running latest value per roster object: all of them share a single sort."""
    return [Slots("__s", object_id, tuple(o for o, _ in roster), tuple(fields))]


def slots(roster, fields: list[str]) -> Column:
    """The slots as array<struct<object_id, team_id, fields>>."""
    return F.array(*[
        F.struct(F.lit(o).alias("object_id"), F.lit(t).alias("team_id"), *[F.col(f"__s{i}.{f}").alias(f) for f in fields])
        for i, (o, t) in enumerate(roster)
    ])


def slots_complete(roster) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"__s{i}").isNotNull() for i in range(len(roster))])


def snapshot_asof(
    states: DataFrame,
    roster,
    fields: list[str],
    width: int,
    *,
    trigger: Column | None = None,
    triggers: DataFrame | None = None,
    name: str = "objects",
    others: dict[str, tuple[DataFrame, Column]] | None = None,
    complete: bool = True,
) -> DataFrame:
    """Latest `fields` of every roster object at each trigger row, as one array column.

    Triggers are rows of `states` itself (`trigger`) or of another table (`triggers`, after the states of
    the same time). Rows are not multiplied by the roster: one running value per object is kept in one
    pass, and the latest rows of `others` (name: table, value) come along. Snapshots that lack an object are dropped, or null if `complete` is off.
    """
    keep = F.col("__rank") == 1 if triggers is None else F.col("__rank") == 2
    if triggers is None:
        keep, out = keep & trigger, states.columns
        both = states.withColumn("__rank", F.lit(1))
    else:
        lean = list(dict.fromkeys([MATCH, TS, SEQ, "object_id", *fields]))
        out = triggers.columns
        both = states.select(*lean).withColumn("__rank", F.lit(1)).unionByName(
            triggers.withColumn("__rank", F.lit(2)), allowMissingColumns=True
        )
    others = others or {}
    for n, (df, value) in others.items():
        both = both.unionByName(
            df.select(MATCH, TS, SEQ, value.alias(f"__o_{n}"), F.lit(0).alias("__rank")), allowMissingColumns=True
        )
    latest = [Last(n, F.col(f"__o_{n}")) for n in others]
    found = scan(both, [MATCH], [TS, "__rank", SEQ], width, *slot_specs(roster, fields), *latest).filter(keep)
    full = slots_complete(roster)
    if complete:
        found = found.filter(full)
    objects = slots(roster, fields) if complete else F.when(full, slots(roster, fields))
    return found.select(*out, objects.alias(name), *others)

