"""Reading and writing tables of identifiers, and identifiers of common tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexaloc.functions import ids
from hexaloc.functions.codec import once
from hexaloc.shipping import ship


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of parquet, orc, json, csv or text files (text: one identifier a line, column value)."""
    ship(spark)
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_by_scheme(df: DataFrame, path: str, identifier: str = "id", kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write with a folder for each scheme, so that reads of one scheme prune the others."""
    df.withColumn("scheme", ids.component(F.col(identifier), "scheme")).write.format(kind).partitionBy("scheme").mode(mode).save(path)


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, context (host), path without its first slash, and fragment of an http address."""
    return {
        "scheme": F.regexp_extract(url, "^(https?)", 1),
        "context": F.regexp_extract(url, "^https?://([^/#]*)", 1),
        "path": F.regexp_extract(url, "^https?://[^/#]*/?([^#]*)", 1),
        "fragment": F.regexp_extract(url, "#(.*)$", 1),
    }


def page_ids(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with id: the identifier of each address; null where none can be made."""
    p = url_parts(F.col(url))
    made = ids.try_id_new(p["scheme"], p["context"], p["path"])
    made = once(pages, "id", made)
    return once(made, "id", F.when(p["fragment"] == "", F.col("id")).otherwise(ids.try_id_set(F.col("id"), "fragment", p["fragment"])))


def document_ids(documents: DataFrame) -> DataFrame:
    """documents with id: file, source, and language and number as a path."""
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return once(documents, "id", ids.try_id_new(F.lit("file"), F.col("source"), path))
