"""The exact difference of two states of a table, as changes of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def difference(gone: DataFrame, came: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """``schema``'s columns and ``_change``: insert, update (the row as it is now) or delete (as it was).

    Rows are counted as a multiset first, so what went and came back alike is no change, however often it is repeated. Then a key that one row left and one row took is an update;
    a key that is null, or that more rows share, gives deletes and inserts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in schema.names])
    text = F.to_json(row, {"ignoreNullFields": "false"})  # also where columns are maps, which can't be grouped by
    sided = [df.select(text.alias("_text"), row.alias("_r"), F.lit(n).cast("long").alias("_n")) for df, n in ((gone, -1), (came, 1))]
    net = sided[0].unionByName(sided[1]).groupBy("_text").agg(F.sum("_n").alias("_n"), F.first("_r").alias("_r")).filter("_n <> 0")
    kind = F.when(F.col("_n") > 0, "insert").otherwise("delete")
    if not keys:
        return repeated(net, F.abs("_n"), kind, schema)
    known = reduce(lambda a, b: a & b, [F.col("_r")[k].isNotNull() for k in keys])
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = net.withColumns({n: F.col("_r")[k] for n, k in zip(names, keys, strict=True)})
    side = lambda n: F.sum(F.when(F.col("_n") * n > 0, F.abs("_n")).otherwise(0))
    pairs = keyed.filter(known).groupBy(*names).agg(side(1).alias("_in"), side(-1).alias("_out"), F.max(F.when(F.col("_n") > 0, F.col("_text"))).alias("_text"))
    pairs = pairs.filter("_in = 1 and _out = 1").select(*names, F.col("_text").alias("_new"))
    found = keyed.join(pairs, names, "left")
    found = found.filter(F.col("_new").isNull() | (F.col("_text") == F.col("_new")))  # of an update the row before goes
    return repeated(found, F.abs("_n"), F.when(F.col("_new").isNotNull(), "update").otherwise(kind), schema)


def repeated(rows: DataFrame, times, kind, schema: T.StructType) -> DataFrame:
    many = rows.select(F.col("_r"), kind.alias("_change"), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_i"))
    return many.select(*[F.col("_r")[c].alias(c) for c in schema.names], "_change")
