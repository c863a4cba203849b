"""Safe relative paths of identifiers (Unix rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexaloc.functions import codec, ids


def _segments(context: Column, path: Column) -> Column:
    return F.split(F.concat_ws("/", context, path), "/")


def path_error(s: Column) -> Column:
    """id_error's code for what is no identifier, root_dir for an absolute context or path,
    parent_dir for a .. segment, else null. Null for null.

    An absolute path would replace the context, so roots are looked for first."""
    context, path = ids.component(s, "context"), ids.component(s, "path")
    root = F.startswith(context, F.lit("/")) | F.startswith(path, F.lit("/"))
    unsafe = F.when(root, F.lit(codec.ROOT_DIR)).when(F.array_contains(_segments(context, path), ".."), F.lit(codec.PARENT_DIR))
    return F.coalesce(ids.id_error(s), unsafe)


def _joined(s: Column) -> Column:
    segments = _segments(ids.component(s, "context"), ids.component(s, "path"))
    return F.when(s.isNotNull(), F.array_join(F.filter(segments, lambda x: (x != "") & (x != ".")), "/"))


def try_id_to_path(s: Column) -> Column:
    """Context and path as one relative path without . and empty segments, or null."""
    return F.when(path_error(s).isNull(), _joined(s))


def id_to_path(s: Column) -> Column:
    return codec.or_raise(path_error(s), _joined(s))
