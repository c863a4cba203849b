"""Two-pass external shuffle into shards of equal row counts, in DataFrame functions alone.

Pass 1 scatters whole records uniformly into buckets of bounded size: the bucket is a
seeded hash of the record, and bucket b becomes partition b. Pass 2 gathers each bucket
in memory, puts it in a canonical order and shuffles it by Fisher-Yates (Spark's
``shuffle``, whose generator starts from the seed and the partition's number, so a task
that runs again gives the same order). The buckets' counts give each record its place in
the whole order; place p goes to shard p mod n, slot p div n.

Law ``rows``: the shards' counts differ by one at most, slots have no gaps.

Defined results: a null text is an empty one; rows equal in all columns are kept, each
with its own place; no rows give no rows; extra columns travel with their record. Copies
of a text scatter by their other columns too, so a hot text does not meet in one bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 32 << 20
#: Buckets whose offsets are broadcast, 16 bytes each; beyond that a shuffled join brings them.
BROADCAST_BUCKETS = 250_000


def buckets_for(df: DataFrame, text: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    size = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 64)).first()[0] or 0
    return max(1, math.ceil(size / bucket_bytes))


def external_shuffle(df: DataFrame, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's rows as structs __row, and __place: their places, 0 to n - 1, in a seeded random order."""
    n = buckets_for(df, text, bucket_bytes)
    scattered = df.select(F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(n)).cast("int").alias("__bucket"), F.struct(*df.columns).alias("__row"))
    counts = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    gathered = scattered.repartitionById(n, F.col("__bucket")).groupBy("__bucket").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    shuffled = gathered.select("__bucket", F.shuffle("__rows", F.lit(seed)).alias("__rows"))
    placed = shuffled.join(F.broadcast(offsets) if n <= BROADCAST_BUCKETS else offsets, F.col("__bucket") == F.col("__b"))
    rows = placed.select("__offset", F.posexplode("__rows").alias("__pos", "__row"))
    return rows.select("__row", (F.col("__offset") + F.col("__pos")).alias("__place"))


def shard(df: DataFrame, shards: int = 40, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's rows with shard (int) and slot (long); columns of these names give way."""
    rows = external_shuffle(df.drop("shard", "slot"), text, seed, bucket_bytes)
    return rows.select("__row.*", F.expr(f"cast(__place % {shards} AS int)").alias("shard"), F.expr(f"__place div {shards}").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 40, **options) -> None:
    """Write the shards as folders shard=0, shard=1, ..., each in the order of its slots."""
    placed = shard(df, shards, **options)
    parts = placed.repartition("shard").sortWithinPartitions("shard", "slot")
    parts.write.partitionBy("shard").parquet(path)
