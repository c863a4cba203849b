"""The identifier functions in SQL. The optimizer inlines them, so they cost what columns cost."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hexaloc.functions import codec, ids

UNSAFE = codec.UNSAFE.replace("\\", "\\\\")


def _encode(x: str) -> str:
    return f"CASE WHEN {x} RLIKE '{UNSAFE}' THEN url_decode(regexp_replace(url_encode({x}), '{codec.KEPT}', '%25')) ELSE {x} END"


def _decode(x: str) -> str:
    return f"CASE WHEN contains({x}, '%') THEN url_decode(regexp_replace(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'), '\\\\+', '%2B')) ELSE {x} END"


def _part(i: int) -> str:
    return f"get(split(s, ':', -1), {i})"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> parameters, result, body."""
    out = {"id_encode": ("s STRING", "STRING", _encode("s")), "id_decode": ("s STRING", "STRING", _decode("s"))}
    for name, i in ids.PLACE.items():
        value = _decode(_part(i))
        out[f"id_{name}"] = ("s STRING", "STRING", f"nullif({value}, '')" if name in ids.OPTIONAL else value)
    missing = " ".join(f"WHEN {_part(ids.PLACE[n])} = '' THEN '{n}'" for n in ids.REQUIRED)
    error = (
        f"CASE WHEN contains(s, '\\\\') THEN '{codec.BACKSLASH}' WHEN octet_length(s) > {codec.MAX_BYTES} THEN '{codec.LENGTH}' "
        f"WHEN size(split(s, ':', -1)) <> {ids.PARTS} THEN '{codec.CARDINALITY}' WHEN {_decode(_part(0))} <> '{ids.ID_PREFIX}' THEN '{codec.PREFIX}' {missing} END"
    )
    out["id_error"] = ("s STRING", "STRING", error)
    out["id_is_valid"] = ("s STRING", "BOOLEAN", f"s IS NOT NULL AND ({error}) IS NULL")
    fields = ", ".join(f"'{name}', {out[f'id_{name}'][2]}" for name in ids.COMPONENTS)
    kind = ", ".join(f"{name}: STRING" for name in ids.COMPONENTS)
    out["id_parse"] = ("s STRING", f"STRUCT<{kind}>", f"CASE WHEN s IS NOT NULL AND ({error}) IS NULL THEN named_struct({fields}) END")
    shape = (
        f"NOT contains(s, '\\\\') AND octet_length(s) <= {codec.MAX_BYTES} AND size(split(s, ':', -1)) = {ids.PARTS} "
        f"AND {_decode(_part(0))} IN ('{ids.ID_PREFIX}', '{ids.SELECTOR_PREFIX}', '')"
    )
    for name, i in ids.PLACE.items():
        new = _encode("value")
        made = f"array_join(concat(slice(split(s, ':', -1), 1, {i}), array({new}), slice(split(s, ':', -1), {i + 2}, {ids.PARTS})), ':')"
        fits = f"NOT contains(value, '\\\\') AND octet_length({new}) <= {codec.MAX_VALUE_BYTES} AND octet_length({_part(i)}) - octet_length({new}) <= {codec.MAX_VALUE_BYTES + 1}"
        out[f"id_set_{name}"] = ("s STRING, value STRING", "STRING", f"CASE WHEN {shape} AND {fits} AND octet_length({made}) <= {codec.MAX_BYTES} THEN {made} END")
    joined = f"concat('{ids.ID_PREFIX}:', {_encode('scheme')}, '::', {_encode('context')}, ':', {_encode('path')}, ':')"
    bad = "contains(scheme, '\\\\') OR contains(context, '\\\\') OR contains(path, '\\\\')"
    out["id_new"] = ("scheme STRING, context STRING, path STRING", "STRING", f"CASE WHEN {bad} OR octet_length({joined}) > {codec.MAX_BYTES} THEN NULL ELSE {joined} END")
    context, path = _decode(_part(ids.PLACE["context"])), _decode(_part(ids.PLACE["path"]))
    segments = f"split(concat_ws('/', {context}, {path}), '/')"
    out["id_to_path"] = (
        "s STRING",
        "STRING",
        f"CASE WHEN s IS NULL OR ({error}) IS NOT NULL OR startswith({context}, '/') OR startswith({path}, '/') OR array_contains({segments}, '..') THEN NULL ELSE array_join(filter({segments}, x -> x <> '' AND x <> '.'), '/') END",
    )
    return out


def register(spark: SparkSession) -> None:
    """Create the functions in the session. Fallible ones give null (id_error tells why)."""
    for name, (parameters, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
