import random

from pyspark.sql import functions as F

from tracklane.operators import areagrid
from tracklane.params import Params
from tracklane.sources import streams

BOX = "match_id string, area_id string, min_x double, max_x double, min_y double, max_y double"
STATE = "match_id string, generation_ts long, seq long, object_id string, team_id string, x double, y double, z double"


def test_many_areas(spark):
    """100 000 areas of all sizes, on borders, in points and inside out, against a loop."""
    rnd = random.Random(3)
    areas = []
    for i in range(100_000):
        x, y = rnd.uniform(-60, 60), rnd.uniform(-40, 40)
        w = rnd.choice([0.0, 0.01, 0.1, 0.3, -1.0]) if i % 5000 else rnd.choice([10.0, 150.0])
        areas.append(("m0", f"r{i}", x, x + w, y, y + w))
    areas += [("m0", "edge", 0.0, 5.0, 0.0, 5.0), ("m0", "edge", 0.0, 5.0, 0.0, 5.0), ("m9", "elsewhere", -99.0, 99.0, -99.0, 99.0)]
    at = {o: (rnd.uniform(-50, 50), rnd.uniform(-30, 30)) for o in "abc"}
    rows = []
    for seq in range(150):
        o = "abc"[seq % 3]
        at[o] = (at[o][0] + rnd.uniform(-2, 2), at[o][1] + rnd.uniform(-2, 2)) if seq % 10 else rnd.choice([(0.0, 0.0), (5.0, 5.0), (5.0, 0.0)])
        rows.append((f"m{seq % 2}" if seq % 7 == 0 else "m0", 100 * seq, seq, o, "T", *at[o], 0.0))
    want, was = [], {}
    mine = [a for a in areas[:-2] if a[2] <= a[3]]  # the repeated edge once
    for m, ts, seq, o, _, x, y, _ in rows:
        now = {a[1] for a in mine if a[2] <= x <= a[3] and a[4] <= y <= a[5]} if m == "m0" else set()
        before = was.get((m, o), set())
        want += [(seq, True, a) for a in now - before] + [(seq, False, a) for a in before - now]
        was[m, o] = now
    out = areagrid.area_event_grid(spark.createDataFrame(rows, STATE), spark.createDataFrame(areas, BOX), Params(), cell=0.5)
    assert len(want) > 100 and sorted(want) == sorted(tuple(r) for r in out.select("seq", "in_area", "area_id").collect())
    assert areagrid.area_cells(spark.createDataFrame(areas, BOX), 0.5).groupBy("match_id", "area_id").count().agg(F.max("count")).first()[0] <= 8


def test_merged_sketches_bound_the_rank_error(spark):
    """Sketches of 40 periods, merged, against exact ranks; a hot match, and one without a latency."""
    n, k = 200_000, 512
    rows = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("match_id"), (F.col("id") % 4000).alias("generation_ts"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("latency_ms"))
    rows = rows.unionByName(spark.createDataFrame([("none", 1, None)], rows.schema))
    sketches = streams.latency_sketches(rows, 100, k)
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    got = {r.match_id: r for r in streams.latency_percentiles(sketches, (0.01, 0.5, 0.95, 0.99), k).collect()}
    assert got.keys() == {"hot", "small"}
    for m, r in got.items():
        exact = sorted(x.latency_ms for x in rows.where(F.col("match_id") == m).select("latency_ms").collect())
        assert r.n == len(exact)
        for q in (0.01, 0.5, 0.95, 0.99):
            rank = sum(v <= r[f"p{round(q * 100)}"] for v in exact) / len(exact)
            assert abs(rank - q) < 2 * 2.3 / k ** 0.9
