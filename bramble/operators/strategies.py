"""How joins are laid out at scale: sizes that are checked before a broadcast, and intervals that are met by equal bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: A side is sent to all executors only if Spark's estimate of its size is at most this; beyond it Spark chooses.
BROADCAST_BYTES = 256 << 20

#: A nested loop is left to Spark over a side of at most so many bytes, or over two whose bytes multiply to at most so much (by Spark's estimates).
LOOP_SIDE, LOOP_PRODUCT = 4 << 10, 1 << 30

#: An interval join compares at most about so many pairs for each value of its key; bins with more are cut.
CELL_PAIRS = 1 << 21

_NUMBERS = (S.ByteType, S.ShortType, S.IntegerType, S.LongType, S.FloatType, S.DoubleType)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a plan's result."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _NUMBERS)


def loops_cheaply(left: DataFrame, right: DataFrame) -> bool:
    """Whether Spark itself would send a side to all executors and has few pairs to try: what it tries grows with the product of both sides."""
    small, large = sorted((estimated_bytes(left), estimated_bytes(right)))
    sent = small <= int(str(left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))
    return sent and (small <= LOOP_SIDE or small * large <= LOOP_PRODUCT)


#: The level of intervals without a finite width: one bin holds them all. That of intervals without a width: a bin for each value.
_UNBOUNDED, _SINGLE = 1100, -1100


def _level(low: Column, high: Column) -> Column:
    """A level whose bins are half as wide as an interval at least, which then lies in four of them at most."""
    width = high - low
    finite = ~F.isnan(width) & (width < float("inf"))
    return F.when(~finite, _UNBOUNDED).when(width > 0, F.greatest(F.ceil(F.log2(width)) - 1, F.lit(-1000))).otherwise(_SINGLE).cast("int")


def _bin(value: Column, level: Column) -> Column:
    """Rounding never reorders values, so a point between two ends lies in a bin between theirs."""
    value, power = value.cast("double"), F.greatest(F.least(level, F.lit(1023)), F.lit(-1000)).cast("double")
    return F.when(level >= _UNBOUNDED, F.lit(0)).when(level <= _SINGLE, F.xxhash64(value + 0.0)).otherwise(F.floor(value / F.pow(F.lit(2.0), power)))


def _hot(left: DataFrame, right: DataFrame) -> list[tuple]:
    """Bins with more than CELL_PAIRS pairs, and into how many parts the intervals and the points of each are dealt: about the square root of CELL_PAIRS of both meet."""
    own = left.groupBy("__level", "__bin").agg(F.count("*").cast("double").alias("__m"))
    far = right.groupBy(F.col("__level").alias("__l"), F.col("__bin").alias("__b")).agg(F.count("*").cast("double").alias("__n"))
    both = own.join(far, (F.col("__level") == F.col("__l")) & (F.col("__bin") == F.col("__b"))).where(F.col("__m") * F.col("__n") > CELL_PAIRS)
    out = []
    for level, bin_, m, n in both.select("__level", "__bin", "__m", "__n").collect():  # as many as the pairs hold CELL_PAIRS at most
        cells = math.ceil(m * n / CELL_PAIRS)
        rows = max(1, math.isqrt(int(cells * m / n)))
        out.append((level, bin_, rows, math.ceil(cells / rows)))
    return out


def _dealt(df: DataFrame, hot: DataFrame, own: str, far: str, cell: Column) -> DataFrame:
    """Each row in one part of its own side, with a copy for each part of the other side. Where a row lies tells it from equal ones; a task that is run again deals alike."""
    values = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, S.AtomicType)]
    df = df.join(hot, ["__level", "__bin"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, far)})
    df = df.withColumn("__own", F.pmod(F.xxhash64(F.spark_partition_id(), *values), F.col(own)))
    return df.withColumn("__cell", F.explode(cell)).drop("__own", own, far)


def interval_join(intervals: DataFrame, low: str, high: str, points: DataFrame, point: str, condition: Column) -> DataFrame:
    """Intervals with the points in them, as an equi-join that any number of executors can share.

    Points go to one bin of each level that occurs (some dozens, found by one pass over the
    intervals), intervals to the four bins of their own level at most. A pair meets in
    exactly one bin, and the condition decides. Bins with many pairs are cut into cells, a
    grid of parts of their intervals and parts of their points, so that where values crowd
    the pairs are still shared. Rows with nulls match nothing.
    """
    x, y = F.col(low).cast("double"), F.col(high).cast("double")
    wide = intervals.where((x <= y)).withColumn("__level", _level(x, y))
    levels = sorted(r[0] for r in wide.select("__level").distinct().collect())  # one for each power of two
    keys = ["__level", "__bin"]

    def binned(wide: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
        right = points.where(F.col(point).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
        bins = F.sequence(_bin(F.col(low), F.col("__level")), _bin(F.col(high), F.col("__level")))
        return wide.withColumn("__bin", F.explode(bins)), right.withColumn("__bin", _bin(F.col(point), F.col("__level")))

    left, right = binned(wide, points)
    if cut := _hot(left.select(*keys), right.select(*keys)):
        spark = left.sparkSession
        # Numbers of tasks are given, as the work isn't in the bytes by which Spark would merge tasks.
        cores, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
        left, right = binned(*[df.repartition(max(cores, min(most, estimated_bytes(df) >> 25))) for df in (wide, points)])
        hot = F.broadcast(spark.createDataFrame(cut, "__level int, __bin bigint, __rows bigint, __columns bigint"))
        row, column, columns = F.col("__own") * F.col("__columns"), F.col("__own"), F.col("__columns")
        left = _dealt(left, hot, "__rows", "__columns", F.sequence(row, row + columns - 1))
        right = _dealt(right, hot, "__columns", "__rows", F.sequence(column, column + (F.col("__rows") - 1) * columns, columns))
        keys.append("__cell")
        left, right = left.repartition(max(most, 4 * cores), *keys).hint("merge"), right.repartition(max(most, 4 * cores), *keys)
    right = right.withColumnsRenamed({k: f"{k}_far" for k in keys})
    met = condition
    for k in keys:
        met = (F.col(k) == F.col(f"{k}_far")) & met
    return left.join(right, met).drop(*keys, *[f"{k}_far" for k in keys])
