"""As-of join: for each left row the latest right row at or before its time, within a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Time buckets of the plan that cuts partitions up.
BUCKETS = 200


def asof(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, left_by: list[str], right_by: list[str], right_key: str,
    cut: bool = False,
) -> DataFrame:
    """Inner as-of matches: all left and right columns (names must differ).

    One shuffle on the partition keys: both sides are unioned and a running last() carries the
    latest right row forward. Rows with a null time or key match nothing; ties in time go to the
    smaller right key.

    Without partition keys, or with `cut` for keys that may hold a large share of all rows, time is
    cut into `BUCKETS` at quantiles first: the running last() works within a bucket, and the last
    right row of each key and bucket (one row each) is carried on to later buckets. So no task holds
    more than one bucket of one key.
    """
    for n in (left_time, *left_by):
        left = left.where(F.col(f"`{n}`").isNotNull())
    for n in (right_time, *right_by):
        right = right.where(F.col(f"`{n}`").isNotNull())
    whole = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keys = [f"_k{i}" for i in range(len(left_by))]
    key = lambda names: [F.col(f"`{n}`").alias(k) for n, k in zip(names, keys, strict=True)]
    null = lambda df: F.lit(None).cast(df.select(whole(df).alias("s")).schema["s"].dataType)
    l = left.select(*key(left_by), F.col(f"`{left_time}`").alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast(right.schema[right_key].dataType).alias("_o"), whole(left).alias("_l"), null(right).alias("_r"))
    r = right.select(*key(right_by), F.col(f"`{right_time}`").alias("_t"), F.lit(0).alias("_s"), F.col(f"`{right_key}`").alias("_o"), null(left).alias("_l"), whole(right).alias("_r"))
    # at equal times right rows come first, the smallest key last among them
    order: list[Column] = [F.col("_t"), F.col("_s"), F.col("_o").desc()]
    both = l.unionByName(r)
    if keys and not cut:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carried = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
        return carried.where((F.col("_s") == 1) & F.col("_m").isNotNull()).select("_l.*", "_m.*")
    at = F.col("_t").cast("double") if not isinstance(both.schema["_t"].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.unix_micros(F.col("_t").cast("timestamp")).cast("double")
    cuts = both.agg(F.percentile_approx(at, [i / BUCKETS for i in range(1, BUCKETS)], F.lit(100 * BUCKETS)).alias("c")).first()["c"] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    both = both.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= at)))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    # the latest right row of each key and bucket: the greatest time, then the smallest right key
    newest = r.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= at))).groupBy(*keys, "_b", "_t").agg(F.min_by("_r", "_o").alias("_r"))
    newest = newest.groupBy(*keys, "_b").agg(F.max_by("_r", "_t").alias("_r"))
    spans = both.select(*keys, "_b").distinct().join(newest, [*keys, "_b"], "left")
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    spans = spans.select(*keys, "_b", F.last("_r", ignorenulls=True).over(earlier).alias("_e"))
    found = inside.where("_s = 1").join(spans, [*keys, "_b"]).withColumn("_m", F.coalesce("_m", "_e"))
    return found.where(F.col("_m").isNotNull()).select("_l.*", "_m.*")
