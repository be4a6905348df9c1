"""Statistics of files, kept in the commit log, and what they tell about where a value can't be.

Of each file its rows, and by column the smallest and largest value and the number of nulls, are in the log itself. Bloom filters are beside the data as rows of (file, column, block, bits), in
blocks of 2^15 bits: a value belongs to one block by its hash and sets ``HASHES`` bits there, so a look-up reads one block per file. Their number follows the file's distinct values, ``BITS_PER_VALUE`` bits each.
"""

from __future__ import annotations

import datetime
import decimal
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.sources.deletion import FILE, is_set

BLOCK_BITS = 15
BITS_PER_VALUE, HASHES = 16, 6
SCHEMA = "file string, column string, block long, bits binary, blocks long"
#: Longer texts have no bounds in the log.
LONGEST = 256
ORDERED = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.DecimalType, T.DoubleType, T.FloatType)


def told(value: object) -> object:
    """A bound as JSON has it; texts and numbers as they are, others by their text."""
    return value if isinstance(value, (int, float, str)) else str(value)


def taken(text: object, kind: T.DataType) -> object:
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(text)
    if isinstance(kind, T.TimestampType):
        return datetime.datetime.fromisoformat(text)
    return decimal.Decimal(text) if isinstance(kind, T.DecimalType) else text


def collect(rows: DataFrame, columns: list[str]) -> dict[str, dict]:
    """``rows``: located rows of new files. By file: rows, and by column [smallest, largest, nulls]; bounds that can't be told are null. A row per file reaches the driver."""
    kinds = {c: rows.schema[c].dataType for c in columns}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, c in enumerate(columns):
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"n{k}"))
        if isinstance(kinds[c], ORDERED):
            aggs += [F.min(c).alias(f"a{k}"), F.max(c).alias(f"b{k}")]
    out = {}
    for r in rows.groupBy(FILE).agg(*aggs).collect():
        of = {}
        for k, c in enumerate(columns):
            a, b = (r[f"a{k}"], r[f"b{k}"]) if isinstance(kinds[c], ORDERED) else (None, None)
            fit = a is not None and not any(isinstance(x, float) and not math.isfinite(x) or isinstance(x, str) and len(x) > LONGEST for x in (a, b))
            of[c] = [told(a), told(b), r[f"n{k}"]] if fit else [None, None, r[f"n{k}"]]
        out[r[FILE]] = {"rows": r["rows"], "columns": of}
    return out


def may_hold(info: dict, column: str, op: str, value: object, kind: T.DataType) -> bool:
    """Whether a file can have rows with ``column op value``; op: =, <, <=, >, >=, in, null."""
    own = info.get("columns", {}).get(column)
    if own is None:
        return True
    low, high, nulls = own
    if op == "null":
        return nulls > 0
    if nulls == info["rows"]:
        return False
    if low is None:
        return True
    if any(isinstance(v, float) and math.isnan(v) for v in (value if op == "in" else [value])):
        return True  # Spark's NaN is above all numbers
    low, high = taken(low, kind), taken(high, kind)
    try:
        if op == "in":
            return any(low <= v <= high for v in value)
        return {"=": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[op]
    except TypeError:  # a value of another type: the scan decides
        return True


# -- Bloom filters


def plain(value: Column, kind: T.DataType) -> Column:
    """As text, equal values alike: there are two zeros."""
    return (value + F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else value).cast("string")


def slots(value: Column, blocks: Column) -> tuple[Column, list[Column]]:
    """(block, bits in it) of a value as text."""
    first, second = F.xxhash64(value), F.shiftright(F.xxhash64(value, F.lit("bloom")), 4)
    return F.pmod(first, blocks), [F.pmod(second + F.lit(k).cast("long") * F.shiftright(first, 17), F.lit(1 << BLOCK_BITS)) for k in range(HASHES)]


def powers(n: Column) -> Column:
    """Blocks for so many values, a power of two, so that a table has few sizes."""
    return F.pow(F.lit(2), F.ceil(F.greatest(F.log2(F.greatest(n, F.lit(1)) * BITS_PER_VALUE / (1 << BLOCK_BITS)), F.lit(0.0)))).cast("long")


def build(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``: located rows of new files."""
    out = None
    for c in columns:
        values = rows.filter(F.col(c).isNotNull()).select(F.col(FILE).alias("file"), plain(F.col(c), rows.schema[c].dataType).alias("v"))
        sizes = values.groupBy("file").agg(F.approx_count_distinct("v").alias("n"))
        sizes = F.broadcast(sizes.select("file", powers(F.col("n")).alias("blocks")))  # a row per file
        block, bits = slots(F.col("v"), F.col("blocks"))
        set_ = values.join(sizes, "file").select("file", "blocks", block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
        own = set_.groupBy("file", "block", "blocks").agg(F.bitmap_construct_agg("bit").alias("bits")).select("file", F.lit(c).alias("column"), "block", "bits", "blocks")
        out = own if out is None else out.unionByName(own)
    return out


def holding(spark: SparkSession, blooms: DataFrame, column: str, values: list) -> set[str]:
    """The files whose filter has one of ``values`` (at most some thousands)."""
    own = blooms.filter(F.col("column") == column)
    sizes = [F.lit(r["blocks"]) for r in own.select("blocks").distinct().collect()]  # powers of two
    if not sizes:
        return set()
    sought = spark.createDataFrame([(str(v),) for v in values], "v string").select("v", F.explode(F.array(*sizes)).alias("blocks"))
    block, bits = slots(F.col("v"), F.col("blocks"))
    wanted = sought.select("blocks", block.alias("block"), F.array(*bits).alias("wanted"))
    hit = own.join(F.broadcast(wanted), ["blocks", "block"]).filter(F.forall("wanted", lambda b: is_set(F.col("bits"), b)))
    return {r["file"] for r in hit.select("file").distinct().collect()}
