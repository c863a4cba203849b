"""Records that remember how each part was written: STRUCT<value STRING, flags BIGINT>.

A part set through ``set`` is read as it was given, even if it looks like an escape; one that
came from parsing is decoded if it holds an escape. A bit of flags for each part tells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexaloc.functions import codec

KIND = "struct<value:string,flags:bigint>"


def exact_parse(record: Column) -> Column:
    return F.struct(record.alias("value"), codec.fmt_flags(record).alias("flags"))


def exact_new(n: int) -> Column:
    return F.struct(codec.fmt_new(n).alias("value"), F.lit(0).cast("long").alias("flags"))


def exact_get(record: Column, i: int) -> Column:
    part = F.get(codec.parts(record["value"]), F.lit(i))
    return F.when(F.getbit(record["flags"], F.lit(i)) == 1, codec.percent_decode(part)).otherwise(part)


def try_exact_set(record: Column, i: int, value: Column) -> Column:
    """Null if too long. A single byte that needs encoding is not marked, and reads back encoded."""
    encoded = codec.percent_encode(value)
    marked = value.rlike(codec.UNSAFE) & (F.octet_length(value) > 1)
    others = record["flags"].bitwiseAND(F.lit(~(1 << i)))
    flags = others.bitwiseOR(F.when(marked, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return F.when(
        codec.set_error(record["value"], i, encoded).isNull(),
        F.struct(codec.placed(record["value"], i, encoded).alias("value"), flags.alias("flags")),
    )
