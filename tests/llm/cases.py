"""Rows that every operator has to take: nulls, blanks, long texts, repeated rows, ids that repeat."""

from pyspark.sql import functions as F

LONG = "The quick brown fox, it jumps; over 12 lazy dogs.\n" * 4000
PASSAGE = " ".join(f"wort{i} und noch {i * 7} mehr" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "é ß 日本 😀 x"), (6, "same text here again and again"), (6, "same text here again and again"),
    (7, "other text under one id"), (7, "one id, but another text"), (None, "no id at all"), (None, None), (8, PASSAGE + " tail one"),
    (9, "head two " + PASSAGE), (10, "x" * 50_000), (11, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is said'),
    (12, "<|endoftext|>a <|endoftext|> b\x1cc d"),
]
CLASH = ["fp", "label", "key", "n", "words", "h", "s", "text_hash", "_fp", "_id", "host", "block", "piece", "uri", "start", "quality"]


def documents(spark, rows=TEXTS, clash=True):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({c: F.lit("clash") for c in CLASH}) if clash else d


def plain(rows):
    return [(d, t or "") for d, t in rows]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
