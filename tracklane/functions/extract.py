"""Field extraction by short specification texts, resolved to columns when the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPEC = re.compile(r"^(\w+)(?:\{(.*)\})?$")


def _field(df: DataFrame, name: str, in_payload: str) -> Column:
    path = f"payload.{name}" if in_payload.strip().lower() == "true" else name
    try:
        df.select(path)
    except Exception as e:
        raise ValueError(f"no field {path}") from e
    return F.col(path)


def extract(df: DataFrame, spec: str, strict: bool = True) -> Column:
    """Column for one specification.

    `static{v}`, `fieldValue{name,inPayload}`, `arrayValue{name,i,inPayload}`, `arraySize{name,inPayload}`,
    `positionValue{i}`, `phase`, `key`, `streamName`. `no` marks an absent extractor: using it is an error.
    Strict columns fail on an index that is too high and on the phase of an atomic element; lenient ones
    are null there.
    """
    m = _SPEC.match(spec.strip())
    if not m:
        raise ValueError(f"cannot read specification {spec!r}")
    kind, args = m.group(1), [a.strip() for a in m.group(2).split(",")] if m.group(2) is not None else []
    pick = F.element_at if strict else F.try_element_at
    match kind, len(args):
        case "static", n if n >= 1:
            return F.lit(m.group(2))
        case "fieldValue", 2:
            return _field(df, *args)
        case "arrayValue", 3:
            return pick(_field(df, args[0], args[2]), F.lit(int(args[1]) + 1))
        case "arraySize", 2:
            return F.size(_field(df, *args))
        case "positionValue", 1:
            return pick(_field(df, "positions", "false"), F.lit(int(args[0]) + 1))
        case "phase", 0:
            phase = _field(df, "phase", "false")
            if not strict:
                return phase
            return F.when(phase.isNull(), F.raise_error(F.lit("an atomic element has no phase")).cast("string")).otherwise(phase)
        case "key", 0:
            return _field(df, "match_id", "false")
        case "streamName", 0:
            return _field(df, "stream_name", "false")
        case "no", 0:
            raise ValueError("this element has no extractor")
    raise ValueError(f"cannot read specification {spec!r}")


def extract_all(df: DataFrame, specs: dict[str, str], strict: bool = True) -> DataFrame:
    """One column per named specification; entries without an extractor (`no`) have no column."""
    return df.select("match_id", "seq", *[extract(df, s, strict).alias(n) for n, s in specs.items() if s.strip() != "no"])
