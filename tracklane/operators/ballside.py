"""A small learned model that tells on which side of the field the ball is."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.operators.asof import MATCH, ORDER, SEQ, TS, snapshot_asof
from tracklane.operators.keyed import emit_on_change
from tracklane.operators.pressing import everybody
from tracklane.params import Params
from tracklane.session import materialize

HIDDEN = 64
MAX_SAMPLES = 102_400  # labelled rows that a model is fitted on, about; the rest only counts and tests


def features(objects: Column, length: Column, width: Column) -> Column:
    """x and y of the ball and every player, scaled to [-1, 1], and z as 0."""
    triples = F.transform(objects, lambda o: F.array(o["x"] / (length / 2), o["y"] / (width / 2), F.lit(0.0)))
    return array_to_vector(F.flatten(triples))


def samples(states: DataFrame, p: Params, trigger: Column | None = None) -> DataFrame:
    """Feature vectors of the snapshots, labelled 1 when the ball is on the right side."""
    snap = snapshot_asof(
        states.select(MATCH, TS, SEQ, "object_id", "x", "y", "field_length", "field_width"), everybody(p), ["x", "y"],
        p.chunk_ms, trigger=F.lit(True) if trigger is None else trigger,
    )
    return snap.select(
        MATCH, TS, SEQ, features(F.col("objects"), F.col("field_length"), F.col("field_width")).alias("features"),
        (F.col("objects")[0]["x"] >= 0).cast("double").alias("label"),
    )


def made_samples(spark: SparkSession, n: int, p: Params, *, seed: int = 7) -> DataFrame:
    """`n` labelled feature vectors with every x and y anywhere on the field, in the columns of `samples`.

    Each coordinate is a hash of its row number, its place and the seed, so a row is the same whichever task makes it, and
    again when a task runs anew.
    """
    def uniform(i: int) -> Column:  # 53 bits of a hash in [-1, 1)
        return F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(i), F.lit(seed)), 11) / F.lit(float(1 << 52)) - 1

    places = [uniform(i) if i % 3 < 2 else F.lit(0.0) for i in range(3 * len(everybody(p)))]
    rows = spark.range(n).withColumn("__f", F.array(*places))
    return rows.select(
        F.lit("made").alias(MATCH), F.col("id").alias(TS), F.col("id").alias(SEQ), array_to_vector("__f").alias("features"),
        (F.col("__f")[0] >= 0).cast("double").alias("label"),
    )


def train_ball_side(
    labelled: DataFrame, p: Params, *, epochs: int = 20, seed: int = 7, max_samples: int = MAX_SAMPLES
) -> tuple[MultilayerPerceptronClassificationModel, DataFrame]:
    """Train one hidden layer on 80 %, keep 10 % aside and report the accuracy on the last 10 %.

    The split is by a hash of the row's identity: rows stay in their part when a task runs again. Of more than
    `max_samples` training rows the model is fitted on as many, about, chosen by another hash.
    """
    part = F.pmod(F.xxhash64(MATCH, TS, SEQ, F.lit(seed)), F.lit(10))
    rows = materialize(labelled.withColumn("part", part), "ball-side-samples")
    inputs = 3 * len(everybody(p))
    trainer = MultilayerPerceptronClassifier(
        layers=[inputs, HIDDEN, 2], maxIter=epochs, blockSize=512, seed=seed, featuresCol="features", labelCol="label"
    )
    training = rows.filter("part < 8")
    share = min(1.0, max_samples / max(1, training.count()))
    chosen = F.pmod(F.xxhash64(F.lit(seed + 1), MATCH, TS, SEQ), F.lit(1_000_000)) < F.lit(share * 1_000_000)
    model = trainer.fit(training.filter(chosen))
    test = model.transform(rows.filter("part = 9"))
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(test)
    sizes = rows.groupBy().agg(
        F.sum((F.col("part") < 8).cast("bigint")).alias("training_rows"),
        F.sum((F.col("part") == 8).cast("bigint")).alias("validation_rows"),
        F.sum((F.col("part") == 9).cast("bigint")).alias("test_rows"),
    )
    return model, sizes.withColumn("test_accuracy", F.lit(float(accuracy)))


def ball_field_side(states: DataFrame, model: MultilayerPerceptronClassificationModel, p: Params) -> DataFrame:
    """The predicted side after each reading, emitted when it changes."""
    side = model.transform(samples(states, p)).select(MATCH, TS, SEQ, (F.col("prediction") < 0.5).alias("ball_on_left"))
    side = materialize(side, "ball-side")
    return emit_on_change(side, [MATCH], ORDER, p.chunk_ms, F.col("ball_on_left"))
