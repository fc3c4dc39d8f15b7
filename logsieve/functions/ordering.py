"""Order-dependent columns that stay spread out when one key holds most of the rows.

A plain ``row_number() over (partition by key)`` sends a whole key to one task. The functions here
cut each key into consecutive *buckets* (an hour of a timestamp, a block of a sequence number),
work inside (key, bucket), and carry one small row per bucket across. ``bucket`` must not decrease
in the order given, and key columns must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"


def time_bucket(ts: str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(ts))


def block_bucket(sequence: str, size: int = 65536) -> Column:
    return F.floor(F.col(sequence) / size)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key. Spark cuts to ``n`` per key before the shuffle and after it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "position") -> DataFrame:
    """1-based position of each row in its key."""
    return running_sum(df, keys, order, bucket, F.lit(1), name)


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    tagged = df.withColumn(_BUCKET, bucket).withColumn("_value", value.cast("long"))
    totals = tagged.groupBy(*keys, _BUCKET).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, _BUCKET, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
    inside = (
        Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.withColumn(name, F.sum("_value").over(inside))
        .join(carried, [*keys, _BUCKET])
        .withColumn(name, F.col(name) + F.col("_carried"))
        .drop(_BUCKET, "_value", "_carried")
    )


def running_max(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Largest ``value`` over the rows of the key up to and including this one; nulls are passed over."""
    tagged = df.withColumn(_BUCKET, bucket).withColumn("_value", value)
    largest = tagged.groupBy(*keys, _BUCKET).agg(F.max("_value").alias("_largest"))
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = largest.select(*keys, _BUCKET, F.max("_largest").over(earlier).alias("_carried"))
    inside = (
        Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.withColumn(name, F.max("_value").over(inside))
        .join(carried, [*keys, _BUCKET])
        .withColumn(name, F.greatest(name, "_carried"))
        .drop(_BUCKET, "_value", "_carried")
    )


def previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """``value`` of the row before this one in its key, null on the first."""
    return _neighbour(df, keys, order, bucket, value, name, backward=True)


def following(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """``value`` of the row after this one in its key, null on the last."""
    return _neighbour(df, keys, order, bucket, value, name, backward=False)


def _neighbour(df, keys, order, bucket, value, name, backward):
    step = F.lag if backward else F.lead
    edge = F.max_by if backward else F.min_by
    tagged = df.withColumn(_BUCKET, bucket).withColumn("_value", value)
    # a single order column lets the partial step hash instead of sort
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    edges = tagged.groupBy(*keys, _BUCKET).agg(edge("_value", at).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    carried = edges.select(*keys, _BUCKET, step("_edge").over(across).alias("_carried"))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    outermost = step(F.lit(1)).over(inside).isNull()
    return (
        tagged.withColumn("_outermost", outermost)
        .withColumn(name, step("_value").over(inside))
        .join(carried, [*keys, _BUCKET])
        .withColumn(name, F.when(F.col("_outermost"), F.col("_carried")).otherwise(F.col(name)))
        .drop(_BUCKET, "_value", "_carried", "_outermost")
    )
