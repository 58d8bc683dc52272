"""Percentiles of very large numeric columns by radix selection, and summaries that can be combined.

Values become order-preserving 64-bit integers (a double's bits, with the
negative half flipped).  Each pass histograms the next digit of those integers
and keeps only the digit that holds a target rank, so after ``ceil(bits / 16)``
passes the exact value is known without sorting.  The leading digits alone form
a summary with a bounded relative error; summaries add up.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.runtime import MAX_BROADCAST_ROWS, broadcast_if_small, cut

#: Bits of a digit: a group's histogram has at most 2**16 rows a pass.
DIGIT_BITS = 16
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@F.pandas_udf(T.LongType())
def double_code(values: pd.Series) -> pd.Series:
    bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)  # + 0.0: -0.0 becomes 0.0
    return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(T.DoubleType())
def double_value(codes: pd.Series) -> pd.Series:
    bits = codes.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64))


def _coded(df: DataFrame, groups: dict[str, Column], value: str) -> tuple[DataFrame, bool]:
    """The groups and ``code`` of all rows that hold a number; whether it is a whole-number column."""
    kind = df.schema[value].dataType
    whole = isinstance(kind, _INTEGRAL)
    number = F.col(value).cast("bigint") if whole else F.col(value).cast("double")
    rows = df.select(*(c.alias(k) for k, c in groups.items()), number.alias("_v")).filter(F.col("_v").isNotNull())
    rows = rows if whole else rows.filter(~F.isnan("_v"))
    return rows.select(*groups, (F.col("_v") if whole else double_code("_v")).alias("_code")), whole


def rank_of(q: float, n: Column) -> Column:
    """The rank of the percentile ``q`` among ``n`` rows, ``ceil(q * n)`` and 1 at least, in whole numbers.

    ``q`` counts as the decimal fraction it is written as, so no rounding of doubles moves a rank.
    """
    share = Fraction(str(q))
    if not 0 <= share <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    top, bottom = (F.lit(x).cast("decimal(18,0)") for x in (share.numerator, share.denominator))
    return F.greatest(F.call_function("div", n.cast("decimal(19,0)") * top + bottom - 1, bottom).cast("bigint"), F.lit(1).cast("bigint"))


def radix_percentiles(df: DataFrame, groups: dict[str, Column], value: str, quantiles: Sequence[float]) -> DataFrame:
    """Exact percentiles of ``value`` per group by radix selection over all rows.

    The percentile q is the smallest value with at least the share q of the
    group's rows at or below it.  ``groups`` maps new column names to columns.
    Result: the groups, ``n`` (rows counted), ``q`` and ``value``, one row per
    group and quantile.

    Null and NaN values are not counted; infinities are ordinary values; -0.0
    equals 0.0; a null group is a group; ties and repeated rows count each; an
    empty table gives no rows.  Work: one scan for the common prefix and one a
    digit; each digit's counts are combined in the map tasks, so a group that
    holds a third of all rows sends at most 2**16 counts a task.
    """
    names = list(groups)
    base, whole = _coded(df, groups, value)
    base = cut(base)
    low, high = base.agg(F.min("_code"), F.max("_code")).first()
    spark = df.sparkSession
    out = T.StructType([*base.select(*names).schema.fields, T.StructField("n", T.LongType()), T.StructField("q", T.DoubleType()), T.StructField("value", T.LongType() if whole else T.DoubleType())])
    if low is None:
        return spark.createDataFrame([], out)
    bits = 64 if low < 0 <= high else (low ^ high).bit_length()
    passes = max(1, -(-bits // DIGIT_BITS))
    width = max(1, -(-bits // passes))

    targets, count = None, 0
    for step in range(passes):
        shift = max(0, bits - (step + 1) * width) if bits else 0
        above = max(0, bits - step * width)
        rows = base.withColumn("_digit", F.shiftright("_code", shift))
        if targets is not None and count <= MAX_BROADCAST_ROWS:
            # rows of no target are dropped before they are counted; with more targets the counts are joined below, never the rows
            wanted = targets.select(*(F.col(k).alias(f"_{k}") for k in names), "_prefix").distinct()
            on = _all([*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names), F.shiftright("_code", above) == F.col("_prefix")])
            rows = rows.join(broadcast_if_small(wanted, count), on, "left_semi")
        histogram = rows.groupBy(*names, "_digit").agg(F.count("*").alias("_c"))
        histogram = histogram.withColumn("_up", F.shiftright("_digit", above - shift) if targets is not None else F.lit(0).cast("bigint"))
        w = Window.partitionBy(*names, "_up")
        counted = histogram.withColumn("_to", F.sum("_c").over(w.orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)))
        if targets is None:
            n = F.sum("_c").over(w)
            ranks = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), rank_of(q, F.col("n")).alias("_rank")) for q in quantiles)))
            found = counted.withColumn("n", n).select("*", ranks.alias("_t")).select("*", "_t.*")
        else:
            right = targets.select(*(F.col(k).alias(f"_{k}") for k in names), "_prefix", "n", "q", "_rank")
            on = _all([*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names), F.col("_up") == F.col("_prefix")])
            found = counted.join(broadcast_if_small(right, count), on)
        hit = found.filter((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_c") < F.col("_rank")))
        targets = cut(hit.select(*names, "n", "q", F.col("_digit").alias("_prefix"), (F.col("_rank") - F.col("_to") + F.col("_c")).alias("_rank")))
        count = targets.count()
    return targets.select(*names, "n", "q", (F.col("_prefix") if whole else double_value("_prefix")).alias("value"))


def _all(conditions) -> Column:
    result = None
    for c in conditions:
        result = c if result is None else result & c
    return result


def percentile_summary(df: DataFrame, groups: dict[str, Column], value: str, error: float = 1 / 128) -> DataFrame:
    """A summary that can be stored a partition or day at a time: counts of the values' leading bits.

    Result: the groups, ``bucket`` (the value's order-preserving integer
    without its low bits), ``bits_dropped`` and ``n``.  A bucket spans at most
    the share ``error`` of its values.  Nulls and NaN are not counted.
    """
    dropped = 52 - max(1, int(np.ceil(-np.log2(error))))
    coded, _ = _coded(df.withColumn("_number", F.col(value).cast("double")), groups, "_number")
    return (
        coded.groupBy(*groups, F.shiftright("_code", dropped).alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select(*groups, "bucket", F.lit(dropped).alias("bits_dropped"), "n")
    )


def merge_summaries(summaries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add up summaries of separate days or partitions; the error bound stays the same."""
    return summaries.groupBy(*groups, "bucket", "bits_dropped").agg(F.sum("n").alias("n"))


def summary_percentiles(summary: DataFrame, groups: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Percentiles from a merged summary: the exact percentile lies in ``[low, high]``.

    One row per group and quantile: the groups, ``n``, ``q``, ``low``, ``high``.
    """
    # a window holds a row per bucket: at most 2**12 / error of them for each sign, however many values there are
    w = Window.partitionBy(*groups)
    counted = summary.withColumns({"_to": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(w)})
    ranks = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), rank_of(q, F.col("_all")).alias("rank")) for q in quantiles)))
    hit = counted.select("*", ranks.alias("_t")).filter((F.col("_to") >= F.col("_t.rank")) & (F.col("_to") - F.col("n") < F.col("_t.rank")))
    first = F.expr("shiftleft(bucket, bits_dropped)")
    last = first + F.expr("shiftleft(1L, bits_dropped)") - 1
    return hit.select(*groups, F.col("_all").alias("n"), F.col("_t.q").alias("q"), double_value(first).alias("low"), double_value(last).alias("high"))
