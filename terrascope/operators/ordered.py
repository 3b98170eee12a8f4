"""Order-dependent work without one task per key.

A plain window puts every row of a key into one task. These helpers cut a key
into buckets, work inside each bucket in parallel, reduce each bucket to one row,
order those few rows, and add the result back. Time buckets get their width from the
number of rows and the time they span; buckets of scores follow the leading bits of a
float, so values that crowd near 0 are told apart as well as others. Rows that share one
instant, or one float, are the least that a task can hold.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions.single import attach

_BEFORE = (Window.unboundedPreceding, -1)
_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


#: Rows that a time bucket holds where they are spread evenly.
ROWS_PER_BUCKET = 8192


def bucket_width(rows: DataFrame, value: Column, rows_per_bucket: int | None = None) -> int:
    """Width of buckets over ``value`` that follows the table: one pass for its count and range."""
    n, low, high = rows.agg(F.count(value), F.min(value), F.max(value)).first()
    return max(1, -(-(high - low + 1) * (rows_per_bucket or ROWS_PER_BUCKET) // n)) if n else 1


#: Rows that a task sorts or groups where they are dealt out by their number.
ROWS_PER_TASK = 1 << 19


def least_parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_of(rows: DataFrame) -> int:
    """How many parts to deal ``rows`` out to, so that a task's memory does not grow with the table."""
    return max(least_parts(rows), -(-rows.count() // ROWS_PER_TASK))


def float_bucket(value: Column, per_octave: int = 8192) -> Column:
    """A number that grows with ``value``, with ``per_octave`` steps between a power of two and the next.

    At 8,192 steps no more than 1,024 different FLOAT values share a number.
    """
    size = F.abs(value).cast("double")
    power = F.greatest(F.floor(F.log2(size)), F.lit(-40))
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1) * per_octave)
    number = (power + 41) * per_octave + F.least(F.greatest(step, F.lit(0)), F.lit(per_octave - 1))
    return (F.signum(value.cast("double")) * F.when(size > 2.0**-40, number).otherwise(0)).cast("bigint")


def _series(keys: Sequence[str], order: Sequence[Column]) -> Window:
    # The bucket table has one row per bucket; without keys it is ordered as one series.
    partition = [F.col(k) for k in keys] or [F.lit(0)]
    return Window.partitionBy(*partition).orderBy(*order)


def with_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums per key; ``sums`` maps output name to input column.

    ``bucket`` must be monotone in the order (ascending, or descending when asked).
    """
    parts = list(keys) + [bucket]
    bucket_order = F.col(bucket).desc() if descending else F.col(bucket).asc()
    totals = df.groupBy(*parts).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    carried = totals.select(
        *_carried_keys(parts),
        *[
            F.coalesce(
                F.sum(f"_t_{o}").over(_series(keys, [bucket_order]).rowsBetween(*_BEFORE)), F.lit(0)
            ).alias(f"_c_{o}")
            for o in sums
        ],
    )
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(*_TO_HERE)
    local = df
    for output, column in sums.items():
        local = local.withColumn(f"_l_{output}", F.sum(column).over(inside))
    joined = local.join(carried, _same_part(parts), "inner")
    return joined.select(*df.columns, *[(F.col(f"_l_{o}") + F.col(f"_c_{o}")).alias(o) for o in sums])


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    output: str = "position",
) -> DataFrame:
    """Zero-based dense position of each row within its key."""
    marked = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (
        with_running_sums(marked, keys, bucket, order, {output: "_one"})
        .withColumn(output, F.col(output) - 1)
        .drop("_one")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], column: str, output: str
) -> DataFrame:
    """Value of ``column`` on the preceding row of the key, null on the first."""
    parts = list(keys) + [bucket]
    inside = Window.partitionBy(*parts).orderBy(*order)
    boxed = F.struct(F.col(column).alias("value"))
    local = df.withColumn("_prev", F.lag(boxed).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    local = local.withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    ends = local.where("_last").select(*parts, boxed.alias("_end"))
    carried = ends.select(
        *_carried_keys(parts), F.lag("_end").over(_series(keys, [F.col(bucket).asc()])).alias("_carry")
    )
    joined = local.join(carried, _same_part(parts), "left")
    value = F.when(F.col("_first"), F.col("_carry.value")).otherwise(F.col("_prev.value"))
    return joined.select(*df.columns, value.alias(output))


def _carried_keys(parts: Sequence[str]) -> list[Column]:
    return [F.col(p).alias(f"_key_{p}") for p in parts]


def _same_part(parts: Sequence[str]) -> Column:
    condition = F.col(parts[0]).eqNullSafe(F.col(f"_key_{parts[0]}"))
    for part in parts[1:]:
        condition = condition & F.col(part).eqNullSafe(F.col(f"_key_{part}"))
    return condition


def bracket_in_time(
    asked: DataFrame, events: DataFrame, width_us: int, low: str = "low", high: str = "high"
) -> DataFrame:
    """For every asked instant, the last event before it and the first at or after it.

    ``asked`` has a column ``us``; ``events`` has ``us`` and two structs: ``low`` is
    reported to later instants, ``high`` to the same or earlier ones. Both inputs
    must be distinct on ``us``. Buckets are ``width_us`` wide; the table of bucket
    ends carries values over empty buckets, so gaps of any length are bridged.
    Result: us, before(us, low), after(us, high).
    """
    bucket = F.floor(F.col("us") / F.lit(float(width_us))).cast("bigint")
    boxed_low = F.struct(F.col("us"), F.col(low).alias("payload"))
    boxed_high = F.struct(F.col("us"), F.col(high).alias("payload"))
    marks = events.select("us", boxed_low.alias("_low"), boxed_high.alias("_high"), F.lit(False).alias("_asked"))
    merged = (
        marks.unionByName(asked.select("us", F.lit(True).alias("_asked")), allowMissingColumns=True)
        .groupBy("us")
        .agg(
            F.max("_low").alias("_low"),
            F.max("_high").alias("_high"),
            F.max("_asked").alias("_asked"),
        )
        .withColumn("_bucket", bucket)
    )
    ends = merged.groupBy("_bucket").agg(
        F.max_by("_low", F.when(F.col("_low").isNotNull(), F.col("us"))).alias("_end_low"),
        F.min_by("_high", F.when(F.col("_high").isNotNull(), F.col("us"))).alias("_end_high"),
    )
    upward = _series([], [F.col("_bucket").asc()]).rowsBetween(*_BEFORE)
    downward = _series([], [F.col("_bucket").desc()]).rowsBetween(*_BEFORE)
    carried = ends.select(
        "_bucket",
        F.last("_end_low", ignorenulls=True).over(upward).alias("_carry_low"),
        F.last("_end_high", ignorenulls=True).over(downward).alias("_carry_high"),
    )
    # Two ordered passes with growing frames stay linear; a frame reaching to the
    # end of the partition would be evaluated anew for every row.
    forward = Window.partitionBy("_bucket").orderBy(F.col("us").asc()).rowsBetween(*_BEFORE)
    backward = Window.partitionBy("_bucket").orderBy(F.col("us").desc()).rowsBetween(*_TO_HERE)
    local = merged.withColumn("_before", F.last("_low", ignorenulls=True).over(forward)).withColumn(
        "_after", F.last("_high", ignorenulls=True).over(backward)
    )
    return (
        local.where("_asked")
        .join(carried, "_bucket", "left")
        .select(
            "us",
            F.coalesce("_before", "_carry_low").alias("before"),
            F.coalesce("_after", "_carry_high").alias("after"),
        )
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], column: str, probabilities: dict[str, float], bucket: Column
) -> DataFrame:
    """Linear-interpolation percentiles per key without gathering a key in one task.

    Equal values collapse to one row; running counts then locate the two ranks around
    each requested position. ``bucket`` is an expression over ``_value``, monotone in it.
    """
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_seen"))
    )
    bucketed = counted.withColumn("_bucket", bucket)
    running = with_running_sums(bucketed, keys, "_bucket", [F.col("_value")], {"_upto": "_seen"})
    totals = counted.groupBy(*keys).agg(F.sum("_seen").alias("_n"))
    located = running.join(totals, list(keys)) if keys else attach(running, totals)
    start = F.col("_upto") - F.col("_seen")
    sums = []
    for name, q in probabilities.items():
        rank = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(rank), F.ceil(rank)
        holds_low = (start <= low) & (low < F.col("_upto"))
        holds_high = (start <= high) & (high < F.col("_upto"))
        share = rank - low
        sums.append(
            F.sum(
                F.when(holds_low, F.col("_value") * (1.0 - share)).otherwise(0.0)
                + F.when(holds_high, F.col("_value") * share).otherwise(0.0)
            ).alias(name)
        )
    return located.groupBy(*keys).agg(*sums)
