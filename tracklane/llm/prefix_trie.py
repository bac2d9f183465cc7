"""Trie of conversation prefixes, rolled up by depth bands.

A node is a distinct sequence of first turns. Its key is the exclusive-or, over its turns, of 128 bits of a hash of
(position, 128 bits of the turn's SHA-256), so keys run over the turns of a conversation in any number of pieces; two sequences that
differ share a key with a chance of about 2^-128.

Totals of subtrees come from bands of BAND depths. A node gives its values to itself and to its ancestors in its own band
only, which are the rows of one member conversation in that band: BAND at most. What the root of a band then holds is
complete but for the bands below. Band roots are a trie themselves, BAND times less deep, and are rolled up in the same way;
their completed totals go to the ancestors in the band above. So a node makes at most 2 BAND rows a level, and there are
log(depth) / log(BAND) levels, one level for conversations of fewer than BAND turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.llm.common import materialize, partitions


BAND = 16
#: Turns of one conversation that one window holds.
CHUNK = 1024
#: At most this many parents can have more than one in HOT_SHARE of all nodes for children.
HOT_SHARE = 1024
#: conv_ids in a piece of text that is hashed at once.
PIECE_IDS = 4096
KEY = ["ka", "kb"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and bytes of every turn, and `length`, the turns of its conversation.

    Turns are ordered by turn, null first; turns of equal number by role and digest. Null roles and texts are empty; rows
    without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.octet_length(text).cast("long").alias("bytes"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("digest"),
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("chunk"))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    per = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    across = Window.partitionBy("conv_id").orderBy("chunk")
    before = per.select(
        "conv_id", "chunk", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("length"))
    here = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(*order)) - 1
    return rows.withColumn("here", here).join(before, ["conv_id", "chunk"]).select(
        "conv_id", (F.col("before") + F.col("here")).alias("pos"), "digest", "bytes", "length")


def shared(turns: DataFrame, group: int, head: Column, most: int) -> DataFrame:
    """`numbered` turns of conversations that begin like the first of their group.

    Conversation c gets the first `head` (a whole number up to `most`, of conv_id) turns of conversation c - c % `group`,
    all if it has fewer and none if it is absent, then its own turns after its first `head`.
    """
    turns, first = materialize(turns, "trie-turns"), F.col("conv_id") % group == 0
    sizes = turns.groupBy("conv_id").agg(F.max("length").alias("length"))
    others = sizes.where(~first).withColumn("head", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = sizes.where(first).select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    plan = others.join(bases, "base", "left").select(
        "conv_id", "base", "head", "length", F.least("head", F.coalesce("base_length", F.lit(0))).alias("taken"))
    taken = turns.where(first & (F.col("pos") < most)).withColumnRenamed("conv_id", "base").drop("length").join(
        plan.drop("length"), "base").where("pos < taken").select("conv_id", "pos", "digest", "bytes")
    # only where the base is too short do own turns move up; they meet that by pieces of a conversation
    piece = lambda pos: F.floor(pos / CHUNK)
    short = plan.where("taken < head and length > head").select(
        "conv_id", (F.col("head") - F.col("taken")).alias("less"), F.explode(F.sequence(F.lit(0).cast("long"), piece(F.col("length")))).alias("piece"))
    kept = turns.where(first | (F.col("pos") >= head)).withColumn("piece", piece(F.col("pos")))
    moved = kept.join(short, ["conv_id", "piece"], "left").select(
        "conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "digest", "bytes")
    rows = moved.unionByName(taken)
    # conversations of which nothing is left stay, as members of the root
    return rows.unionByName(sizes.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                                         F.lit(0).cast("long").alias("bytes")))


def prefixes(rows: DataFrame) -> DataFrame:
    """A row per conversation and prefix: depth, key, key of the prefix one turn shorter, bytes of the last turn, and whether
    the conversation ends there. `rows` hold turns by pos, and one row of pos -1 per conversation for the root."""
    lane = [F.when(F.col("digest").isNull(), 0).otherwise(F.xxhash64(F.lit(salt), F.col("pos"), F.col("digest"))) for salt in (1, 2)]
    rows = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes", *[x.cast("long").alias(k) for x, k in zip(lane, ("la", "lb"))])
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    per = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("la").alias("xa"), F.bit_xor("lb").alias("xb"), F.max("depth").alias("deepest"))
    across = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(x).over(across), F.lit(0)).alias(c) for x, c in (("xa", "ca"), ("xb", "cb"))],
                       F.max("deepest").over(Window.partitionBy("conv_id")).alias("end"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"r{x}": F.bit_xor(f"l{x}").over(inside) for x in "ab"}).join(carry, ["conv_id", "chunk"])
    key = {f"k{x}": F.col(f"r{x}").bitwiseXOR(F.col(f"c{x}")) for x in "ab"}
    run = run.withColumns(key)
    return run.select("conv_id", "depth", *KEY, *[F.when(F.col("depth") > 0, F.col(f"k{x}").bitwiseXOR(F.col(f"l{x}"))).alias(f"p{x}") for x in "ab"],
                      "bytes", (F.col("depth") == F.col("end")).alias("is_end"))


def _given_up(values: DataFrame, members: DataFrame, step: int, above: bool) -> DataFrame:
    """Sums of `values` (conv_id, depth, leaves, saved) at the nodes of `members` in the band of each (up to its own depth), or
    in the band above it. Bands are of BAND nodes whose depths are multiples of `step`."""
    height = step * BAND
    band = F.floor(F.col("depth") / height)
    low = values.select("conv_id", "depth", (band - int(above)).alias("band"), "leaves", "saved")
    path = members.where(F.col("depth") % step == 0).select("conv_id", F.col("depth").alias("up"), band.alias("band"), *KEY)
    met = low.join(path, ["conv_id", "band"])
    if not above:
        met = met.where("up <= depth")
    return met.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rollup(nodes: DataFrame, members: DataFrame, deepest: int, step: int = 1) -> DataFrame:
    """Sums of leaves and saved over the subtree of every one of `nodes` (key, conv_id of a member, depth a multiple of `step`,
    leaves, saved); `members` has a row (conv_id, depth, key) for each prefix of those conversations."""
    partial = _given_up(nodes, members, step, above=False)
    height = step * BAND
    if deepest < height:
        return partial
    partial = materialize(partial, "trie-partial")
    is_root = F.col("depth") % height == 0
    roots = nodes.where(is_root).drop("leaves", "saved").join(partial, KEY)
    complete = materialize(rollup(roots, members, deepest, height), "trie-roots")
    passed = roots.where("depth > 0").drop("leaves", "saved").join(complete, KEY)
    return partial.unionByName(_given_up(passed, members, step, above=True)).groupBy(*KEY).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of the conv_ids that end at a node, ascending, joined by commas.

    Ids are first joined in pieces of a range of PIECE_IDS ids; a task then hashes the pieces of a node as they come in order
    and holds one at a time.
    """
    pieces = members.where("is_end").groupBy(*KEY, F.floor(F.col("conv_id") / PIECE_IDS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for b in batches:
            for a, k, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
                if (a, k) != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (a, k), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), x)) for x in out])
                out = []
        if at:
            out.append((*at, digest.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), x)) for x in out])

    met = pieces.repartition(partitions(members.sparkSession), *KEY).sortWithinPartitions(*KEY, "piece")
    return met.select(*KEY, "ids").mapInArrow(run, "ka long, kb long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations.

    `rows` has conv_id, pos, digest and bytes per turn, and one row of pos -1 without a digest per conversation. Columns:
    ka, kb (key), conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (sum over the subtree of the members beyond the first times the
    bytes of the last turn), ends_sha256. Repeated rows are turns of their own. No conversation: no rows, not even a root.
    """
    members = materialize(prefixes(rows), "trie-members")
    nodes = members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
        F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum(F.col("is_end").cast("long")).alias("n_ends"))
    nodes = materialize(nodes, "trie-nodes")
    total, deepest = nodes.agg(F.count("*"), F.max("depth")).first()
    values = nodes.select(*KEY, "conv_id", "depth", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = rollup(values, members.select("conv_id", "depth", *KEY), deepest or 0)
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    whole = nodes.drop("n_ends", "bytes").join(children, KEY, "left").join(sums, KEY).join(ends(members), KEY, "left").select(
        *KEY, "conv_id", "depth", "pa", "pb", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    whole = materialize(whole, "trie")
    # parents of very many children, HOT_SHARE at most, go to every task; the children of others meet them by key
    parent = whole.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    is_hot = F.col("n_children") > (total or 0) // HOT_SHARE
    hot = parent.where(is_hot).select("pa", "pb", F.col("parent_conv_id").alias("hot"))
    known = whole.join(F.broadcast(hot), ["pa", "pb"], "left")
    rest = known.where("hot is null").drop("hot").join(parent.where(~is_hot & (F.col("n_children") > 0)).drop("n_children"), ["pa", "pb"], "left")
    out = known.where("hot is not null").withColumnRenamed("hot", "parent_conv_id").unionByName(rest)
    return out.select(*KEY, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
