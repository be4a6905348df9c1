"""Joins that Spark has no operator for: as-of, range and interval joins, as equi-joins or one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], width: float | None = None,
) -> DataFrame:
    """Each left row with the right row of its key that is latest at or before it: one union, one sort by key and time, no join.

    ``width``: keys are cut into slices of so many seconds (or units of a number), each sorted by a task of its own, so that a key with a third of all rows is
    spread; a slice begins with the last right row before it, which comes from one row per key and slice.
    """
    cols = [c for c in left.columns if c not in by]
    state = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    kind = right.select(state.alias("s")).schema["s"].dataType
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_left"), F.lit(None).cast(kind).alias("_state"))
    none = F.lit(None).cast(a.schema["_left"].dataType)
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), none.alias("_left"), state.alias("_state"))
    keys = list(by)
    if width is not None:
        keys.append("_slice")
        number = F.unix_micros(F.col("_t").cast("timestamp")) / 1e6 if "timestamp" in dict(a.dtypes)["_t"] else F.col("_t")
        a, b = (x.withColumn("_slice", F.floor(number / width)) for x in (a, b))
        last = b.filter("_t is not null").groupBy(*keys).agg(F.max_by("_state", "_t").alias("_state"))
        needed = a.select(*keys).distinct()
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        both = needed.withColumn("_needed", F.lit(True)).join(last, keys, "full_outer")
        carried = both.withColumn("_state", F.last("_state", ignorenulls=True).over(before)).filter("_needed and _state is not null")
        b = b.unionByName(carried.select(*by, F.col("_state.t").alias("_t"), F.lit(-1).alias("_side"), none.alias("_left"), "_state", "_slice"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_state", F.last("_state", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*by, "_left.*", *[F.col(f"_state.{v}").alias(v) for v in values])


def cell(value: Column, width: float) -> Column:
    return F.floor(value / width)


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): an equi-join on cells of ``width``; a range is copied to the cells it covers."""
    cells = F.sequence(cell(F.col(low), width), cell(F.col(high), width))
    spread = ranges.filter(F.col(high) > F.col(low)).withColumn("_cell", F.explode(cells))
    placed = points.withColumn("_cell", cell(F.col(value), width))
    return placed.join(spread, "_cell").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def interval_join(a: DataFrame, b: DataFrame, a_low: str, a_high: str, b_low: str, b_high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Overlapping half-open intervals, each pair once: it is found in the cell where the later of the two begins."""
    spread = lambda df, lo, hi: df.filter(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(cell(F.col(lo), width), cell(F.col(hi), width))))
    pairs = spread(a, a_low, a_high).join(spread(b, b_low, b_high), ["_cell", *(on or [])])
    first = pairs.filter(F.col("_cell") == cell(F.greatest(a_low, b_low), width))
    return first.filter((F.col(a_low) < F.col(b_high)) & (F.col(b_low) < F.col(a_high))).drop("_cell")


def salted_join(big: DataFrame, other: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An inner or left join whose big side has a few hot keys: they are dealt over ``salts`` tasks."""
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left")
    dealt = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copied = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")
