"""Quality rules: statistics of whole texts and a decision list learned from labels, all as column expressions.

The list is learned by sequential covering. A rule is a conjunction of thresholds on the statistics of a document. It is
grown on two thirds of the labelled documents by FOIL's information gain, pruned on the rest by dropping conditions from
its end, and kept while it is precise enough there; the documents it covers are set aside, and the next rule
starts. Thresholds are quantiles, so labelled documents are first counted by cell of binned statistics: every step after
that is one aggregation over at most as many rows as there are cells, whatever the number of labels.
The result is an ordered chain of conditional expressions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import materialize, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
POSITION_BITS = 21
FEATURES = {
    "n_words": F.col,
    "word_length": lambda _: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbol_share": lambda _: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_lines": lambda _: F.col("n_dup_lines").cast("double"),
    "repeat_share": lambda _: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
}
NAMES = list(FEATURES)


class Settings(NamedTuple):
    """bins: quantiles per statistic; the rest bounds the list and says how sure a rule must be."""

    bins: int = 24
    max_rules: int = 12
    max_conditions: int = 4
    min_covered: int = 5
    min_precision: float = 0.9


class Condition(NamedTuple):
    feature: str
    above: bool
    edge: int
    value: float

    def test(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)

    def cell_test(self) -> Column:
        c = F.col("b_" + self.feature)
        return c > self.edge if self.above else c <= self.edge


Rule = list[Condition]


def all_of(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the `carried` columns and the counts of every row of `docs` (doc_id, text); a null text has no words.

    n_repeat_words: three-word windows are hashed; (hash, position) pairs are sorted as one number each, so that equal
    windows lie side by side, and the positions of those found more than once are put in order to count the words they
    cover. The upper bits of a hash stand for it while sorting; where two hashes agree in these only, or a
    text has more positions than fit, full hashes are sorted instead.
    """
    low = (1 << POSITION_BITS) - 1
    words = docs.select("doc_id", *carried, text_of("text").alias("text")).withColumn("w", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        "doc_id", *carried, "w", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"), lines.alias("lines"))
    hashed = counted.select(
        "doc_id", *carried, F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("n") - 3),
                        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("h"))
    once = F.size("h") == F.size(F.array_distinct("h"))
    sorted_ = hashed.withColumn("s", F.when(once, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(
        "h", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))))
    near = lambda i, j: F.get("s", i).bitwiseXOR(F.get("s", j)).bitwiseAND(F.lit(~low)) == 0
    at = lambda i: F.get("h", F.get("s", i).bitwiseAND(F.lit(low)).cast("int"))
    m = F.size("s")
    packed = sorted_.withColumn("r", F.filter(F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>")),
                                              lambda i: F.coalesce(near(i, i - 1), F.lit(False)) | F.coalesce(near(i, i + 1), F.lit(False))))
    unsure = (F.size("h") > low) | F.exists("r", lambda i: (i > 0) & near(i, i - 1) & (at(i) != at(i - 1)))
    full = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    slow = packed.withColumn("unsure", F.when(m > 0, unsure).otherwise(F.lit(False))).withColumn(
        "f", F.when(F.col("unsure"), full).otherwise(F.lit(None)))
    twin = lambda i, j: F.get("f", i)["x"] == F.get("f", j)["x"]
    exact = F.transform(F.filter(F.sequence(F.lit(0), F.size("f") - 1), lambda i: F.coalesce(
        twin(i, i - 1), F.lit(False)) | F.coalesce(twin(i, i + 1), F.lit(False))), lambda i: F.get("f", i)["i"])
    quick = F.transform("r", lambda i: F.get("s", i).bitwiseAND(F.lit(low)).cast("int"))
    placed = slow.withColumn("p", F.sort_array(F.when(F.col("unsure"), exact).otherwise(quick)))
    covered = F.aggregate("p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")), lambda a, x: F.struct(
        x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"])).alias("sum")), lambda a: a["sum"])
    out = placed.select("doc_id", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    # a generated row keeps later filters above the statistics; pushed down, they would compute them again for each use
    return out.select(F.explode(F.array(F.struct("*"))).alias("x")).select("x.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: f(k).cast("double") for k, f in FEATURES.items() if k != "n_words"})


def learn(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[Rule]:
    """Rules for documents to reject, from `labels` (doc_id, quality: 0 is bad) and statistics of the documents.

    Documents that fail the base rules are left out. Labels without an id or quality are ignored; of several labels of
    one document the worst counts. Without bad or good labels there are no rules.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = with_features(stats).where(~base_failed()).join(marks, "doc_id")
    known = materialize(known.select("doc_id", "quality", *NAMES), "labelled")
    cuts = [i / settings.bins for i in range(1, settings.bins)]
    edges = known.agg(*(F.percentile_approx(k, cuts, 10_000).alias(k) for k in NAMES)).first()
    edges = {k: sorted(set(edges[k] or [])) for k in NAMES}
    cells = known.groupBy(
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"),
        *(sum((F.when(F.col(k) > F.lit(e), 1).otherwise(0) for e in edges[k]), F.lit(0)).alias("b_" + k) for k in NAMES),
    ).agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("quality") == 0, 0).otherwise(1)).alias("good"))
    left = materialize(cells, "cells")
    rules: list[Rule] = []
    while len(rules) < settings.max_rules:
        rule = _prune(left, _grow(left, edges, settings), settings)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~all_of([c.cell_test() for c in rule]))
    return rules


def _grow(cells: DataFrame, edges: dict[str, list[float]], settings: Settings) -> Rule:
    rule: Rule = []
    while len(rule) < settings.max_conditions:
        inside = cells.where(~F.col("held") & all_of([c.cell_test() for c in rule]))
        pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col("b_" + k).alias("b")) for k in NAMES))
        by_bin = inside.select(F.explode(pairs).alias("x"), "bad", "good").groupBy("x.k", "x.b").agg(
            F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()  # statistics x bins rows at most
        bad, good = (sum(r[c] for r in by_bin if r.k == NAMES[0]) for c in ("bad", "good"))
        if not bad or not good:
            break
        best, gain = None, 0.0
        for k in NAMES:
            for edge, value in enumerate(edges[k]):
                for above in (True, False):
                    rows = [r for r in by_bin if r.k == k and (r.b > edge) == above]
                    p, n = sum(r.bad for r in rows), sum(r.good for r in rows)
                    if p >= settings.min_covered and n < good:
                        g = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                        if g > gain:
                            best, gain = Condition(k, above, edge, value), g
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(cells: DataFrame, rule: Rule, settings: Settings) -> Rule:
    """The start of the rule that is worth most on documents it was not grown on; none if that is not precise enough."""
    if not rule:
        return []
    starts = [rule[:i + 1] for i in range(len(rule))]
    got = cells.where("held").agg(*(F.coalesce(F.sum(F.when(all_of([c.cell_test() for c in s]), F.col(x)).otherwise(0)), F.lit(0))
                                    for s in starts for x in ("bad", "good"))).first()
    worth = [((p - n) / (p + n) if p + n else -1.0, p, s) for p, n, s in zip(got[::2], got[1::2], starts)]
    value, p, start = max(worth, key=lambda x: (x[0], x[1]))
    return start if p and (value + 1) / 2 >= settings.min_precision else []


def verdict(rules: list[Rule]) -> Column:
    """True for documents that no rule rejects, asked in the order they were learned."""
    out = None
    for r in rules:
        test = all_of([c.test() for c in r])
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Statistics, base_failed and kept of every row of `docs`; rules are learned from `labels` on these documents.

    Null, empty and blank texts fail. Repeated rows are judged alike, and a labelled one counts as often as it is
    there. No rows: no rows. Other columns of either table are ignored.
    """
    stats = materialize(statistics(docs), "quality")
    rules = learn(stats, labels.select("doc_id", "quality"), settings)
    return with_features(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.value:g}" for c in r) for r in rules]


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` without the rows that `judge` rejects; its columns may be any, so statistics are joined to none of them."""
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")  # rules need the statistics of these only
    rules = learn(materialize(statistics(labelled), "quality"), labels.select("doc_id", "quality"), settings)
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).alias("_row"), "doc_id", "text")
    return with_features(statistics(held, "_row")).where(~base_failed() & verdict(rules)).select(*(F.col(f"_row.{n}").alias(c) for c, n in names.items()))
