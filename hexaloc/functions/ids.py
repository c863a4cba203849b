"""Resource identifiers: prefix, scheme, binding, context, path and fragment, joined by colons.

An identifier is a string column; equality, grouping, joins and order are those of the
encoded string. Components are decoded when read. Binding and fragment are null if empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexaloc.functions import codec

# Fixed values of the format: the prefixes and the order of the components.
ID_PREFIX, SELECTOR_PREFIX = "zri", "zrs"
COMPONENTS = ("scheme", "binding", "context", "path", "fragment")
PLACE = {name: i + 1 for i, name in enumerate(COMPONENTS)}
REQUIRED = ("scheme", "context", "path")
OPTIONAL = ("binding", "fragment")
PARTS = 6


def has_backslash(c: Column) -> Column:
    """A backslash in the raw value (an escaped one passes)."""
    return F.contains(c, F.lit("\\"))


def id_error(s: Column) -> Column:
    """Null for a valid identifier, else the first of backslash, length, cardinality,
    prefix, scheme, context, path (the last three: that component is missing)."""
    p = codec.parts(s)
    error = F.when(has_backslash(s), F.lit(codec.BACKSLASH)).when(F.octet_length(s) > codec.MAX_BYTES, F.lit(codec.LENGTH))
    error = error.when(F.size(p) != PARTS, F.lit(codec.CARDINALITY)).when(codec.percent_decode(F.get(p, F.lit(0))) != ID_PREFIX, F.lit(codec.PREFIX))
    for name in REQUIRED:
        error = error.when(F.get(p, F.lit(PLACE[name])) == "", F.lit(name))
    return error


def id_is_valid(s: Column) -> Column:
    return s.isNotNull() & id_error(s).isNull()


def component(s: Column, name: str) -> Column:
    """A component, decoded. Empty binding and fragment are null."""
    value = codec.fmt_get(s, PLACE[name])
    return F.nullif(value, F.lit("")) if name in OPTIONAL else value


def components(s: Column) -> Column:
    return F.struct(*(component(s, name).alias(name) for name in COMPONENTS))


def try_id_parse(s: Column) -> Column:
    """The struct of components, or null for what is no identifier."""
    return F.when(id_is_valid(s), components(s))


def id_parse(s: Column) -> Column:
    """The same; what is no identifier raises its error code. Null stays null."""
    error = id_error(s)
    kind = "struct<scheme:string,binding:string,context:string,path:string,fragment:string>"
    return F.when(s.isNull(), F.lit(None)).when(error.isNull(), components(s)).otherwise(F.raise_error(error).cast(kind))


def _joined(scheme: Column, context: Column, path: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX + ":"), codec.percent_encode(scheme), F.lit("::"), codec.percent_encode(context), F.lit(":"), codec.percent_encode(path), F.lit(":"))


def id_new_error(scheme: Column, context: Column, path: Column) -> Column:
    """Null, backslash or length. Empty components are accepted here, though not by a parse."""
    bad = has_backslash(scheme) | has_backslash(context) | has_backslash(path)
    return F.when(bad, F.lit(codec.BACKSLASH)).when(F.octet_length(_joined(scheme, context, path)) > codec.MAX_BYTES, F.lit(codec.LENGTH))


def try_id_new(scheme: Column, context: Column, path: Column) -> Column:
    """An identifier without binding and fragment, or null."""
    return F.when(id_new_error(scheme, context, path).isNull(), _joined(scheme, context, path))


def id_new(scheme: Column, context: Column, path: Column) -> Column:
    return codec.or_raise(id_new_error(scheme, context, path), _joined(scheme, context, path))


def shape_error(s: Column) -> Column:
    """Null for what ``id_new``, a setter or a selector may hold: six parts, some of them empty,
    behind either prefix or none; else backslash, length, cardinality or prefix."""
    p = codec.parts(s)
    error = F.when(has_backslash(s), F.lit(codec.BACKSLASH)).when(F.octet_length(s) > codec.MAX_BYTES, F.lit(codec.LENGTH))
    error = error.when(F.size(p) != PARTS, F.lit(codec.CARDINALITY))
    return error.when(~codec.percent_decode(F.get(p, F.lit(0))).isin(ID_PREFIX, SELECTOR_PREFIX, ""), F.lit(codec.PREFIX))


def set_error(s: Column, name: str, value: Column) -> Column:
    """Null, or the error of what is no identifier or selector, else that of the value."""
    of_value = F.when(has_backslash(value), F.lit(codec.BACKSLASH)).otherwise(codec.set_error(s, PLACE[name], codec.percent_encode(value)))
    return F.coalesce(shape_error(s), of_value)


def try_id_set(s: Column, name: str, value: Column) -> Column:
    """With one component replaced (by an empty one, too), or null.

    A null identifier or value gives null, here and in the strict form."""
    return F.when(set_error(s, name, value).isNull(), codec.placed(s, PLACE[name], codec.percent_encode(value)))


def id_set(s: Column, name: str, value: Column) -> Column:
    return codec.or_raise(set_error(s, name, value), codec.placed(s, PLACE[name], codec.percent_encode(value)))


def id_format(parsed: Column) -> Column:
    """I16: the identifier of a struct of components; it parses to the same struct."""
    return F.concat(F.lit(ID_PREFIX), *(F.concat(F.lit(":"), codec.percent_encode_strict(F.coalesce(parsed[name], F.lit("")))) for name in COMPONENTS))


def id_canonicalize(s: Column) -> Column:
    """The one spelling of all identifiers with these components; null for what is no identifier."""
    return F.when(id_is_valid(s), F.concat(F.lit(ID_PREFIX), *(F.concat(F.lit(":"), codec.percent_encode_strict(codec.fmt_get(s, PLACE[name]))) for name in COMPONENTS)))


def id_debug_json(s: Column) -> Column:
    """The components, decoded, as JSON; absent ones are left out. Null for what is
    neither identifier nor selector."""
    return F.when(s.isNotNull() & shape_error(s).isNull(), F.to_json(components(s)))


def scheme_prefix(s: Column, scheme: str) -> Column:
    """A test of the scheme that is pushed down to the scan as StringStartsWith.

    Sound only for canonical identifiers: others may spell the same scheme with escapes."""
    return s.startswith(f"{ID_PREFIX}:{scheme}:")


# selectors as columns; hexaloc.operators.matching compiles them


def selector_error(s: Column) -> Column:
    """Null for a valid selector, else backslash, length, cardinality or prefix."""
    p = codec.parts(s)
    error = F.when(has_backslash(s), F.lit(codec.BACKSLASH)).when(F.octet_length(s) > codec.MAX_BYTES, F.lit(codec.LENGTH))
    return error.when(F.size(p) != PARTS, F.lit(codec.CARDINALITY)).when(codec.percent_decode(F.get(p, F.lit(0))) != SELECTOR_PREFIX, F.lit(codec.PREFIX))


def try_selector_parse(s: Column) -> Column:
    """The struct of components, empty ones null, or null for what is no selector."""
    fields = (F.nullif(codec.fmt_get(s, i), F.lit("")).alias(name) for name, i in PLACE.items())
    return F.when(s.isNotNull() & selector_error(s).isNull(), F.struct(*fields))


#: L1: a selector of everything. L2: the one without a prefix, which doesn't parse.
SELECTOR_NEW, SELECTOR_DEFAULT = SELECTOR_PREFIX + ":::::", ":::::"
