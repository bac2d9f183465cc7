"""Column types of the input streams and of generic stream elements."""

from pyspark.sql import types as T

STRING, LONG, DOUBLE, FLAG = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


VECTOR = struct(x=DOUBLE, y=DOUBLE, z=DOUBLE)

RAW_POSITION = struct(
    match_id=STRING, generation_ts=LONG, seq=LONG, object_id=STRING, team_id=STRING, x=DOUBLE, y=DOUBLE, z=DOUBLE
)

MATCH_METADATA = struct(
    match_id=STRING, field_length=DOUBLE, field_width=DOUBLE, mirrored_x=FLAG, mirrored_y=FLAG,
    object_rename_map=STRING, team_rename_map=STRING, areas=STRING,
)

ELEMENT = struct(
    stream_name=STRING, match_id=STRING, generation_ts=LONG, seq=LONG, atomic=FLAG, phase=STRING,
    object_identifiers=T.ArrayType(STRING), group_identifiers=T.ArrayType(STRING), positions=T.ArrayType(VECTOR),
    payload=struct(
        longValue=LONG, boolValue=FLAG, stringValue=STRING, doubleValue=DOUBLE, repeatedValue=T.ArrayType(LONG)
    ),
)

# Streams that only ever come in: operators may not write them.
INPUT_STREAMS = ("raw_position", "match_metadata")
