"""Colon-separated string records: percent codec, parts, flags, spans, get and set.

All functions take and return columns and use Spark's built-in expressions only. Limits are in
bytes of the encoded text. A fallible function has a ``try_`` form that gives null and a
strict form that raises; ``*_error`` functions give a code instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: separator, limits in bytes, error codes.
SEPARATOR = ":"
MAX_BYTES = 65_535
MAX_VALUE_BYTES = 32_767
MAX_PARTS = 64
BACKSLASH, LENGTH, CARDINALITY, PREFIX = "backslash", "length", "cardinality", "prefix"
ROOT_DIR, PARENT_DIR = "root_dir", "parent_dir"

#: What is percent-encoded: controls, DEL, the separator, and every byte beyond ASCII.
UNSAFE = r"[^\x20-9;-\x7E]"
#: The same with the two characters that would not read back as themselves.
UNSAFE_STRICT = r"[^\x20-$&-9;-\[\]-\x7E]"

#: The escapes of these, among those that url_encode writes.
KEPT, KEPT_STRICT = "%(?=[018-9A-F]|3A|7F)", "%(?=[018-9A-F]|3A|7F|25|5C)"

ESCAPED = "%[0-9A-Fa-f]{2}"


def _encoded(c: Column, unsafe: str, kept: str) -> Column:
    # url_encode escapes more than is wanted; the escapes that stay are escaped once more, then all are decoded once
    whole = F.url_decode(F.regexp_replace(F.url_encode(c), kept, "%25"))
    # clean values, the usual ones, are left as they are
    return F.when(c.rlike(unsafe), whole).otherwise(c)


def percent_encode(c: Column) -> Column:
    """Percent-encode controls, DEL, colons and non-ASCII bytes, upper-case hex."""
    return _encoded(c, UNSAFE, KEPT)


def percent_encode_strict(c: Column) -> Column:
    """Also encodes % and backslash, so that the next parse reads the value back unchanged."""
    return _encoded(c, UNSAFE_STRICT, KEPT_STRICT)


def percent_decode(c: Column) -> Column:
    """Decode %HH, keep any other %, replace invalid UTF-8. A plus sign stays a plus sign."""
    whole = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(F.contains(c, F.lit("%")), F.url_decode(whole)).otherwise(c)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, whatever reads it.

    The optimizer would put the expression itself in each place of a filter that it pushes
    below; it doesn't push through a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def parts(record: Column) -> Column:
    """The encoded parts of a record, empty ones included."""
    return F.split(record, SEPARATOR, -1)


def fmt_new(n: int) -> Column:
    """a record of n empty parts."""
    if not 1 <= n <= MAX_PARTS:
        raise ValueError(f"a record has 1 to {MAX_PARTS} parts, not {n}")
    return F.lit(SEPARATOR * (n - 1))


def fmt_error(record: Column, n: int) -> Column:
    """null for a record of n parts, else ``length`` or ``cardinality`` (too few and too many alike)."""
    return F.when(F.octet_length(record) > MAX_BYTES, F.lit(LENGTH)).when(F.size(parts(record)) != n, F.lit(CARDINALITY))


def fmt_get(record: Column, i: int) -> Column:
    """part i, decoded; null beyond the last."""
    return percent_decode(F.get(parts(record), F.lit(i)))


def fmt_flags(record: Column) -> Column:
    """bit i is set if part i holds an escape."""
    def add(state: Column, part: Column) -> Column:
        flag = F.when(part.rlike(ESCAPED), state["bit"]).otherwise(F.lit(0).cast("long"))
        return F.struct((state["flags"] + flag).alias("flags"), F.shiftleft(state["bit"], 1).alias("bit"))

    first = F.struct(F.lit(0).cast("long").alias("flags"), F.lit(1).cast("long").alias("bit"))
    return F.aggregate(parts(record), first, add, lambda state: state["flags"])


def fmt_spans(record: Column) -> Column:
    """Array of (start, end) of the parts, in bytes, end exclusive."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, part: Column) -> Column:
        start = F.coalesce(F.get(done, F.size(done) - 1)["end"] + 1, F.lit(0))
        return F.concat(done, F.array(F.struct(start.cast("int").alias("start"), (start + F.octet_length(part)).cast("int").alias("end"))))

    return F.aggregate(parts(record), empty, add)


def fmt_debug(record: Column) -> Column:
    """value, parts and flags as JSON."""
    return F.to_json(F.struct(record.alias("value"), parts(record).alias("parts"), fmt_flags(record).alias("flags")))


def set_error(record: Column, i: int, encoded: Column) -> Column:
    """null, or ``cardinality`` if the record has no part i, ``length`` if the encoded value or
    the record that it gives is too long. Null for a null record or value."""
    new = F.octet_length(encoded)
    change = new - F.octet_length(F.get(parts(record), F.lit(i)))
    too_long = (new > MAX_VALUE_BYTES) | (change < -MAX_VALUE_BYTES - 1) | (change > MAX_VALUE_BYTES) | (F.octet_length(record) + change > MAX_BYTES)
    return F.when(encoded.isNotNull() & (F.size(parts(record)) <= i), F.lit(CARDINALITY)).when(too_long, F.lit(LENGTH))


def placed(record: Column, i: int, encoded: Column) -> Column:
    """The record with part i replaced; null if the record or the value is."""
    p = parts(record)
    new = F.concat(F.slice(p, F.lit(1), F.lit(i)), F.array(encoded), F.slice(p, F.lit(i + 2), F.greatest(F.size(p), F.lit(0))))
    return F.when(record.isNotNull() & encoded.isNotNull(), F.array_join(new, SEPARATOR))


def try_fmt_set(record: Column, i: int, value: Column) -> Column:
    """The record with part i replaced by the encoded value, or null (for a null value, too)."""
    encoded = percent_encode(value)
    return F.when(set_error(record, i, encoded).isNull(), placed(record, i, encoded))


def fmt_set(record: Column, i: int, value: Column) -> Column:
    encoded = percent_encode(value)
    return or_raise(set_error(record, i, encoded), placed(record, i, encoded))


def or_raise(error: Column, value: Column) -> Column:
    return F.when(error.isNull(), value).otherwise(F.raise_error(error).cast("string"))


# spans (S1-S8): structs of start and end, 0 to 65,535


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _shifted(s: Column, start: int | Column, end: int | Column) -> Column:
    a, b = s["start"] + start, s["end"] + end
    return F.when(a.between(0, MAX_BYTES) & b.between(0, MAX_BYTES), span(a, b))


def span_shift(s: Column, by: int | Column) -> Column:
    """Both ends moved; null beyond the limits."""
    return _shifted(s, by, by)


def span_shift_start(s: Column, by: int | Column) -> Column:
    return _shifted(s, by, 0)


def span_shift_end(s: Column, by: int | Column) -> Column:
    return _shifted(s, 0, by)


def span_len(s: Column) -> Column:
    return s["end"] - s["start"]


def span_is_empty(s: Column) -> Column:
    return s["end"] == s["start"]


def spans_init(n: int) -> Column:
    """Span i is i to i."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: span(i, i))
