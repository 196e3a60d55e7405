"""As-of joins and previous-row lookups that survive hot keys.

One address may own a third of all rows, so no window here is partitioned by the address alone. Rows are put into
(key, time bucket) groups; inside a group a running window finds the neighbour, and what crosses a bucket border is
carried by one summary row per (key, bucket). A key has at most as many summary rows as the history has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.columns import micros
from tracewell.session import stage

BUCKET_US = 3_600_000_000  # one hour


def asof(left: DataFrame, marks: DataFrame, key: str, left_ts: str, mark_ts: str, payload: list[str],
         direction: str = "forward", strict: bool = True, bucket_us: int = BUCKET_US, how: str = "left") -> DataFrame:
    """Add to every ``left`` row the nearest later (or earlier) row of ``marks`` with the same key.

    The result has ``left``'s columns plus ``m_ts`` and ``m_<payload>``. Marks at the same instant are reduced to the
    smallest payload first. With ``strict`` equal times do not match.
    """
    forward = direction == "forward"
    left_cols = left.columns
    pay = [F.col(c) for c in payload]
    collapsed = (marks.where(F.col(key).isNotNull() & F.col(mark_ts).isNotNull())
                 .groupBy(F.col(key), micros(mark_ts).alias("__t"))
                 .agg(F.min(F.struct(*pay)).alias("__pay")))
    events = (left.withColumn("__t", micros(left_ts)).withColumn("__probe", F.lit(True))
              .unionByName(collapsed.withColumn("__probe", F.lit(False)), allowMissingColumns=True)
              .withColumn("__b", F.floor(F.col("__t") / bucket_us).cast("long")))
    mark = F.when(~F.col("__probe"), F.struct(F.col("__t"), F.col("__pay")))
    pick = F.min if forward else F.max

    order = -F.col("__t") if forward else F.col("__t")
    inside = W.partitionBy(key, "__b").orderBy(order).rangeBetween(W.unboundedPreceding, -1 if strict else 0)
    border = (events.groupBy(key, "__b").agg(pick(mark).alias("__edge")))
    far = W.partitionBy(key).orderBy(-F.col("__b") if forward else F.col("__b")).rowsBetween(W.unboundedPreceding, -1)
    carry = border.select(key, "__b", pick("__edge").over(far).alias("__carry")).where(F.col("__carry").isNotNull())
    found = (events.withColumn("__near", pick(mark).over(inside)).where("__probe")
             .join(carry, [key, "__b"], "left")
             .withColumn("__m", F.coalesce("__near", "__carry")))
    if how == "inner":
        found = found.where(F.col("__m").isNotNull())
    return found.select(*left_cols, F.timestamp_micros(F.col("__m.__t")).alias("m_ts"),
                        *[F.col(f"__m.__pay.{c}").alias(f"m_{c}") for c in payload])


def previous_row(df: DataFrame, key: str, ts: str, tie: list[str], values: list[str],
                 bucket_us: int = BUCKET_US) -> DataFrame:
    """Add ``prev``: the struct (ts, tie..., values...) of the row just before this one for the same key."""
    row = F.struct(micros(ts).alias("t"), *[F.col(c) for c in tie], *[F.col(c) for c in values if c not in tie])
    base = (df.withColumn("__row", row).withColumn("__b", F.floor(micros(ts) / bucket_us).cast("long")))
    inside = W.partitionBy(key, "__b").orderBy("__row")
    border = base.groupBy(key, "__b").agg(F.max("__row").alias("__last"))
    carry = border.select(key, "__b", F.lag("__last").over(W.partitionBy(key).orderBy("__b")).alias("__carry"))
    return (base.withColumn("__lag", F.lag("__row").over(inside)).join(carry, [key, "__b"], "left")
            .withColumn("prev", F.coalesce("__lag", "__carry")).drop("__row", "__b", "__lag", "__carry"))


def running_totals(df: DataFrame, order: str, sums: list[str], partitions: int | None = None) -> DataFrame:
    """Running totals (``run_*``) and grand totals (``total_*``) of ``sums`` in ascending ``order`` over the whole table, without a one-task window.

    ``order`` must be unique (reduce to distinct values first). Rows are range-partitioned and written with their
    partition number; each partition's totals give the offsets of the ones after it.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(df.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()), "running-totals")
    offsets = parts.groupBy("__p").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    # the offsets table has one row per partition, so these two windows are tiny
    before = W.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    offsets = offsets.select(
        "__p", *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums],
        *[F.sum(f"__s_{c}").over(whole).alias(f"total_{c}") for c in sums])
    inside = W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (parts.join(offsets, "__p")
            .select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"__o_{c}")).alias(f"run_{c}") for c in sums],
                    *[f"total_{c}" for c in sums]))


def percent_rank_average(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank of ``value`` in (0, 1]; tied values share the mean of their ranks."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_totals(counts, value, ["__n"])
    ranked = ranked.select(value, ((F.col("run___n") - (F.col("__n") - 1) / 2) / F.col("total___n")).alias(out))
    return df.join(ranked, value)


def exact_quantiles(df: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """One row with the exact quantiles (linear interpolation) of a column too large for one task."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    spans = running_totals(counts, column, ["__n"])
    aggs: list[Column] = []
    for i, q in enumerate(quantiles):
        at = F.lit(q) * (F.col("total___n") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        first = F.col("run___n") - F.col("__n")
        low = F.max(F.when((first <= lo) & (lo < F.col("run___n")), F.col(column)))
        high = F.max(F.when((first <= hi) & (hi < F.col("run___n")), F.col(column)))
        aggs += [low.alias(f"__l{i}"), high.alias(f"__h{i}"), F.max(at - lo).alias(f"__f{i}")]
    one = spans.agg(*aggs)
    return one.select(*[(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * F.col(f"__f{i}")).alias(f"q{i}")
                        for i in range(len(quantiles))])
