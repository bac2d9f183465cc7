"""Connected components of a table of links, in rounds of hooking on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (u, v: long), label being the smallest node that can be reached.

    Each round every node takes the smallest of itself and its neighbours as its new name, links are renamed and those
    within one name drop out, until none is left. A renamed graph connects what the old one did. Names are local
    minima, so their number falls by a constant factor a round on average. Minima are pre-aggregated before their
    shuffle; the joins are plain, so adaptive execution can split the links of a hot node. Null ends and links of a
    node to itself are ignored; repeated links count once. No links: no rows.
    """
    edges = materialize(links.where("u <> v").select("u", "v").unionByName(links.where("u <> v").select(
        F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    names = None
    while not edges.isEmpty():
        hook = materialize(edges.groupBy("u").agg(F.min("v").alias("least"))
                           .select(F.col("u").alias("node"), F.least("u", "least").alias("name")), "hook")
        a, b = hook.toDF("u", "nu"), hook.toDF("v", "nv")
        edges = materialize(edges.join(a, "u").join(b, "v").where("nu <> nv")
                            .select(F.col("nu").alias("u"), F.col("nv").alias("v")).distinct(), "links")
        names = hook if names is None else materialize(
            names.join(hook.toDF("name", "next"), "name", "left")
            .select("node", F.coalesce("next", "name").alias("name")), "names")
    if names is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return names.withColumnRenamed("name", "label")
