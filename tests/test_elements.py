"""Field extraction, filters and stores on small hand-made elements."""

import pytest
from pyspark.sql import functions as F

from tracklane.functions.extract import extract, extract_all
from tracklane.operators import filters, keyed
from tracklane.schemas import ELEMENT

O = ["match_id", "seq"]


@pytest.fixture(scope="module")
def el(spark):
    data = [
        ("dummy", "key", 1, 0, True, None, ["objId1"], ["groupId1"], [(1.0, 2.0, 3.0)], (1337, True, "helloWorld", 42.21, [100])),
        ("dummy", "key", 2, 1, False, "ACTIVE", ["objId2", "objId3"], [], [(4.0, 5.0, 6.0), (7.0, 8.0, 9.0)], (42, False, "hello", 1.5, [200, 300])),
        ("other", "key2", 3, 2, False, "END", ["objId1"], ["groupId2", "groupId3"], [], (0, True, "world", 0.0, [])),
    ]
    return spark.createDataFrame(data, ELEMENT)


def one(el, spec, seq, strict=True):
    return el.filter(F.col("seq") == seq).select(extract(el, spec, strict).alias("v")).first()["v"]


@pytest.mark.parametrize("spec,seq,value", [
    ("static{hello}", 0, "hello"),
    ("fieldValue{longValue,true}", 0, 1337),
    ("fieldValue{boolValue,true}", 1, False),
    ("fieldValue{stringValue,true}", 2, "world"),
    ("fieldValue{doubleValue,true}", 0, 42.21),
    ("fieldValue{generation_ts,false}", 1, 2),
    ("arrayValue{object_identifiers,1,false}", 1, "objId3"),
    ("arrayValue{repeatedValue,0,true}", 0, 100),
    ("arraySize{object_identifiers,false}", 1, 2),
    ("arraySize{repeatedValue,true}", 2, 0),
    ("phase", 1, "ACTIVE"),
    ("key", 2, "key2"),
    ("streamName", 2, "other"),
])
def test_extract(el, spec, seq, value):
    assert one(el, spec, seq) == value


def test_extract_position(el):
    assert tuple(one(el, "positionValue{1}", 1)) == (7.0, 8.0, 9.0)


@pytest.mark.parametrize("spec,seq", [
    ("arrayValue{object_identifiers,1,false}", 0), ("arrayValue{repeatedValue,2,true}", 1), ("positionValue{0}", 2), ("phase", 0),
])
def test_extract_errors_at_run_time(el, spec, seq):
    with pytest.raises(Exception):
        one(el, spec, seq)
    assert one(el, spec, seq, strict=False) is None


@pytest.mark.parametrize("spec", [
    "no", "nonsense", "fieldValue{missing,true}", "fieldValue{longValue}", "arrayValue{missing,0,false}", "arraySize{}", "phase{1}", "",
])
def test_extract_errors_at_plan_time(el, spec):
    with pytest.raises(ValueError):
        extract(el, spec)


def test_extract_all_leaves_out_absent(el):
    assert extract_all(el, {"a": "key", "b": "no"}).columns == ["match_id", "seq", "a"]


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_filters(el):
    long = "fieldValue{longValue,true}"
    assert seqs(filters.filter_all(el, filters.eq(el, long, 42))) == [1]
    assert seqs(filters.filter_all(el, filters.ne(el, long, 42))) == [0, 2]
    assert seqs(filters.filter_all(el, filters.is_in(el, long, [0, 42]))) == [1, 2]
    assert seqs(filters.filter_all(el, filters.eq(el, "key", "key"), filters.eq(el, long, 42))) == [1]
    assert seqs(filters.filter_any(el, filters.eq(el, "key", "key2"), filters.eq(el, long, 42))) == [1, 2]
    assert seqs(filters.filter_all(el)) == seqs(filters.filter_any(el)) == [0, 1, 2]
    assert seqs(filters.filter_all(el, filters.eq(el, "phase", "END"))) == [2]


def test_filter_drops_unreadable(el):
    group = filters.ne(el, "arrayValue{group_identifiers,0,false}", "groupId2")
    assert seqs(filters.filter_all(el, group)) == [0]
    assert seqs(filters.filter_any(el, filters.eq(el, "key", "key"), group)) == [0, 1]
    assert seqs(filters.filter_any(el, group, filters.eq(el, "key", "key"))) == [0]


def test_filters_reject_floats(el):
    for build in (filters.eq, filters.ne):
        with pytest.raises(TypeError):
            build(el, "fieldValue{doubleValue,true}", 42.21)
    with pytest.raises(TypeError):
        filters.is_in(el, "fieldValue{doubleValue,true}", [1, 2.5])


def test_store_many(el, rows):
    entries = [
        ("last_long", "fieldValue{longValue,true}", None, "bigint"),
        ("last_phase", "fieldValue{phase,false}", None, "string"),
        ("history", "fieldValue{longValue,true}", 2, "bigint"),
    ]
    out = keyed.store_many(el, ["match_id"], ["generation_ts", "seq"], 2, entries, forward=False)
    assert out.columns == ["match_id", "generation_ts", "seq", "last_long", "last_phase", "history"]
    assert rows(out) == sorted([
        ("key", 1, 0, 1337, None, [1337]), ("key", 2, 1, 42, "ACTIVE", [42, 1337]), ("key2", 3, 2, 0, "END", [0]),
    ], key=repr)
    with pytest.raises(TypeError):
        keyed.store_many(el, ["match_id"], ["generation_ts", "seq"], 2, [("x", "key", None, "bigint")])


def test_history_is_capped_and_newest_first(spark):
    df = spark.createDataFrame([("k", i, i, i) for i in range(3)] + [("k2", 0, 0, 9)], "key string, generation_ts bigint, seq bigint, v bigint")
    out = keyed.history_n(df, ["key"], ["generation_ts", "seq"], 1, F.col("v"), 2, "h")
    got = {(r["key"], r["seq"]): r["h"] for r in out.collect()}
    assert got == {("k", 0): [0], ("k", 1): [1, 0], ("k", 2): [2, 1], ("k2", 0): [9]}


def test_latest_value_defaults_and_composite_key(spark):
    df = spark.createDataFrame(
        [("k", "a", 1, None), ("k", "b", 2, 5), ("k", "a", 3, 7), ("k2", "a", 4, None)], "key string, inner string, generation_ts bigint, v bigint"
    )
    out = keyed.latest_value(df, ["key", "inner"], ["generation_ts"], 2, F.col("v"), "l", default=0)
    assert {r["generation_ts"]: r["l"] for r in out.collect()} == {1: 0, 2: 5, 3: 7, 4: 0}
    total = keyed.running_increase(df, ["key"], ["generation_ts"], 2, F.col("v"), "t")
    assert {r["generation_ts"]: r["t"] for r in total.collect()} == {1: 0, 2: 5, 3: 12, 4: 0}
