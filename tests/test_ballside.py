from pyspark.sql import functions as F

from tracklane.operators import ballside
from tracklane.plans import catalog


def test_made_samples_and_the_side_of_given_readings(spark):
    p = catalog.PARAMS
    rows = ballside.made_samples(spark, 6000, p)
    read = lambda df: {r.seq: (list(r.features), r.label) for r in df.collect()}
    made = read(rows)
    assert made == read(rows.repartition(7).filter("seq % 1 = 0"))  # a rerun in other tasks gives the same rows
    assert 0.47 < sum(label for _, label in made.values()) / len(made) < 0.53
    for features, label in made.values():
        assert len(features) == 69 and label == (features[0] >= 0)
        assert all(-1 <= x < 1 for x in features) and not any(features[2::3])
    spread = [f[0] for f, _ in made.values()]
    assert min(spread) < -0.99 and max(spread) > 0.99 and abs(sum(spread)) / len(spread) < 0.05

    model, report = ballside.train_ball_side(rows, p, epochs=40)
    report = report.first()
    assert report.training_rows + report.validation_rows + report.test_rows == 6000 and report.test_accuracy > 0.9

    m = catalog.match(spark, "/root/testdata/sf0.001")
    shown = model.transform(ballside.samples(m.states, p)).select("match_id", "generation_ts", "seq", "prediction").collect()
    want, last = [], {}
    for r in sorted(shown, key=lambda r: (r.match_id, r.generation_ts, r.seq)):
        left = r.prediction < 0.5
        if last.get(r.match_id) != left:
            want.append((r.match_id, r.seq, left))
        last[r.match_id] = left
    got = ballside.ball_field_side(m.states, model, p).select("match_id", "seq", "ball_on_left").collect()
    assert want and sorted(want) == sorted(map(tuple, got))
