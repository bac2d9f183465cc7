"""Surfaces covered by the teams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.operators.asof import MATCH, ORDER, SEQ, TS, slot_specs
from tracklane.operators.ordered import scan
from tracklane.operators.speed import players
from tracklane.operators.stateful import deadband
from tracklane.params import Params


@F.pandas_udf(T.DoubleType())
def hull_surface(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Surface of the convex hull of each row's points, whole Arrow batches at a time.

    A directed pair is a hull edge if every other point lies to its left; points on its line must lie
    between the two. The surface is half the sum of the edges' cross products.
    """
    if not len(xs):
        return pd.Series([], dtype="float64")
    x, y = np.stack(xs.to_numpy()), np.stack(ys.to_numpy())
    n = x.shape[1]
    # copies of one point would give the same edge more than once: only the first of them counts
    first = np.stack([~((x[:, :a] == x[:, [a]]) & (y[:, :a] == y[:, [a]])).any(axis=1) for a in range(n)], axis=1)
    area = np.zeros(len(x))
    for a in range(n):
        rx, ry = x - x[:, [a]], y - y[:, [a]]
        for b in range(n):
            dx, dy = rx[:, [b]], ry[:, [b]]
            left = (dx * ry - dy * rx >= 0).all(axis=1) & first[:, a] & first[:, b] & ((dx != 0) | (dy != 0))[:, 0]
            rows = np.flatnonzero(left)  # few pairs get here: only they are checked for points on their line
            px, py, ex, ey = rx[rows], ry[rows], dx[rows], dy[rows]
            along = ex * px + ey * py
            on_line = ex * py - ey * px == 0
            edge = rows[(~on_line | ((along >= 0) & (along <= ex * ex + ey * ey))).all(axis=1)]
            area[edge] += (x[edge, a] * y[edge, b] - x[edge, b] * y[edge, a]) / 2
    return pd.Series(area)


def mbr_surface(xs: Column, ys: Column, quirks: bool = False) -> Column:
    """Surface of the bounding rectangle; `quirks` starts both maxima at the smallest positive double."""
    top = (lambda c: F.greatest(F.array_max(c), F.lit(5e-324))) if quirks else F.array_max
    return (top(xs) - F.array_min(xs)) * (top(ys) - F.array_min(ys))


def team_points(states: DataFrame, p: Params) -> DataFrame:
    """Player rows with the latest x and y of the whole own team (rows of incomplete teams are left out)."""
    rows = players(states, p).select(MATCH, TS, SEQ, "object_id", "team_id", "x", "y")
    run = scan(rows, [MATCH], ORDER, p.chunk_ms, *slot_specs(p.roster, ["x", "y"]))
    team = {t: [i for i, (_, o) in enumerate(p.roster) if o == t] for t in p.teams}

    def coords(c: str) -> Column:
        first, second = ([F.col(f"__s{i}.{c}") for i in team[t]] for t in p.teams)
        return F.when(F.col("team_id") == p.teams[0], F.array(*first)).otherwise(F.array(*second))

    out = run.select(MATCH, TS, SEQ, "team_id", coords("x").alias("xs"), coords("y").alias("ys"))
    return out.filter(F.forall("xs", lambda v: v.isNotNull()))


def team_surfaces(states: DataFrame, p: Params) -> DataFrame:
    points = team_points(states, p)
    return points.select(
        MATCH, TS, SEQ, "team_id", mbr_surface(F.col("xs"), F.col("ys"), p.quirks).alias("mbr_surface"),
        hull_surface("xs", "ys").alias("hull_surface"),
    )


def team_area_state(states: DataFrame, p: Params) -> DataFrame:
    """Both surfaces whenever one of them moved."""
    return deadband(
        team_surfaces(states, p), [MATCH, "team_id"], ["mbr_surface", "hull_surface"], p.area_epsilon, p.chunk_ms
    )
