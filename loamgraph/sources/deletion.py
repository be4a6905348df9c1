"""Deletion vectors: which rows of a table's files are gone, as bitmaps of 2^15 rows each.

A vector is kept beside the data as rows of (file, block, bits, dv): ``dv`` names the write, and for each file the log names the write that holds its bitmaps now, all of them. Rows are
told by their file and their place in it, which never change. All is done in Spark's own bitmap functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bitmap, as a power of two; what Spark's bitmaps hold.
BITS = 15
FILE, ROW = "_file", "_row"
SCHEMA = "file string, block long, bits binary, dv string"
#: Bitmaps (of 4 KB) that are sent to every executor; more are joined.
MOST_SENT = 1 << 14


def located(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The rows of these files with ``_file`` (the last three parts of its path) and ``_row``."""
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.select("*", F.substring_index("_metadata.file_path", "/", -3).alias(FILE), F.col("_metadata.row_index").alias(ROW))


def bitmaps(places: DataFrame) -> DataFrame:
    """``places``: _file, _row. file, block, bits."""
    bit = F.col(ROW).bitwiseAND((1 << BITS) - 1)
    return places.groupBy(F.col(FILE).alias("file"), F.shiftright(ROW, BITS).alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def united(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("file", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def is_set(bits: Column, row: Column) -> Column:
    at = row.bitwiseAND((1 << BITS) - 1)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), at.bitwiseAND(7).cast("int")) == 1


def flagged(rows: DataFrame, bits: DataFrame, name: str, sent: bool) -> DataFrame:
    """``rows`` (located) with a boolean ``name``: whether the row is in a bitmap."""
    held = bits.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("bits").alias("_bits"))
    held = F.broadcast(held) if sent else held
    joined = rows.join(held, (F.col(FILE) == F.col("_f")) & (F.shiftright(ROW, BITS) == F.col("_b")), "left")
    return joined.withColumn(name, F.when(F.col("_bits").isNull(), False).otherwise(is_set(F.col("_bits"), F.col(ROW)))).drop("_f", "_b", "_bits")
