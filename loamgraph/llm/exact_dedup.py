"""Exact dedup by an extendible-hash index on shared files. DataFrame operations only.

A text's key is 64 bits of hash. The directory is indexed by the key's leading bits and doubles while a bucket is overfull; it is computed on the driver from
a histogram of key prefixes (at most 2^16 numbers). A bucket is a key range and has one owner task: every row goes straight to its bucket's task, once.
There rows are sorted by key and text, texts of one key are compared byte by byte with their neighbours, and texts that differ although their keys collide are
numbered as a chain. The owner writes the bucket's file to the shared folder: all rows of a text with its digest, keeper and number of copies.

Keys held by more than ``hot_rows`` rows (and more than 1 / 2^16 of all rows, so there are fewer than 2^16 such keys) do not go to their owner as they are:
their copies are folded into one row per text before anything is shuffled, and the owner's decision is sent back to the rows by a broadcast of those few
entries.

Defined results: null text equals empty text; a null id becomes a keeper only if its whole group is null; rows that repeat an id with the same text are one
document and share its decision (``keep_first`` keeps one of them); an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import pin, scratch

WHITESPACE = r"[\x20\x09-\x0D]+"
#: The directory never exceeds this many slots; beyond it buckets grow instead.
MAX_DIRECTORY_BITS = 16
#: Copies of one key beyond which they are folded before the shuffle; with more rows than 2^16 times this, a 2^16th of the rows.
HOT_ROWS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def prefix(key: Column, bits: int) -> Column:
    """The leading ``bits`` of the key as an integer from 0."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def grow_directory(counts: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int]]:
    """Split overfull buckets, doubling the directory as needed.

    ``counts``: load per prefix of ``bits`` bits. Returns (local depth, leading bits) per bucket, in key order.
    """
    upto = [0, *accumulate(counts.get(p, 0) for p in range(1 << bits))]
    done: list[tuple[int, int]] = []
    todo = [(0, 0)]
    while todo:
        depth, lead = todo.pop()
        span = bits - depth
        if upto[(lead + 1) << span] - upto[lead << span] <= capacity or depth == bits:
            done.append((depth, lead))
        else:
            todo += [(depth + 1, 2 * lead + 1), (depth + 1, 2 * lead)]
    return done


def directory_slots(buckets: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """(global depth, bucket number per slot)."""
    depth = max(d for d, _ in buckets)
    return depth, [k for k, (d, _) in enumerate(buckets) for _ in range(1 << (depth - d))]


def bucket_of(key: Column, depth: int, slots: list[int]) -> Column:
    if depth == 0:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>")  # folded to one literal
    return F.element_at(table, prefix(key, depth) + 1)


@dataclass
class Directory:
    depth: int
    slots: list[int]
    hot: DataFrame | None  # key of the hot keys, fewer than 2^16

    def bucket(self, key: Column) -> Column:
        return bucket_of(key, self.depth, self.slots)

    def deal(self, rows: DataFrame) -> DataFrame:
        """Each row (with a ``key``) to the task that owns its bucket."""
        return rows.withColumn("bucket", self.bucket(F.col("key"))).repartitionById(max(self.slots) + 1, F.col("bucket"))


def plan_directory(keys: DataFrame, capacity: int, hot_rows: int) -> Directory:
    """``keys``: key, size (bytes). A bucket's load is counted in rows of at least 1 KB; ``capacity`` is a load, less if tasks would be too few."""
    counts = pin(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")))
    rows = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot_rows = max(hot_rows, rows >> 16)
    weight = F.least("n", F.lit(hot_rows)) * F.ceil((F.col("size") + 1) / 1024)
    load = counts.agg(F.sum(weight).alias("n")).first()["n"] or 0
    capacity = max(1, min(capacity, load // int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bits = 0
    while (load >> bits) > max(1, capacity // 8) and bits < MAX_DIRECTORY_BITS:
        bits += 1
    held = counts.groupBy(prefix(F.col("key"), bits).alias("p")).agg(F.sum(weight).alias("n")).collect()
    depth, slots = directory_slots(grow_directory({r["p"]: r["n"] for r in held}, bits, capacity))
    hot = counts.filter(F.col("n") > hot_rows).select("key")
    return Directory(depth, slots, hot if hot.first() else None)


def own(dealt: DataFrame) -> DataFrame:
    """``dealt``: bucket, key, norm, id, copies. In each owner task: chain_no, keep_id, group_size, and first for one row of each text."""
    chain = Window.partitionBy("bucket", "key").orderBy("norm", F.col("id").asc_nulls_last())
    one = Window.partitionBy("bucket", "key", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differs = F.when(F.col("norm") == F.lag("norm").over(chain), 0).otherwise(1)
    return (
        dealt.withColumn("_differs", differs)
        .withColumn("chain_no", F.sum("_differs").over(chain).cast("int"))
        .withColumns({"first": F.row_number().over(one) == 1, "keep_id": F.min("id").over(whole), "group_size": F.sum("copies").over(whole)})
        .drop("_differs")
    )


def postings(keyed: DataFrame, plan: Directory) -> DataFrame:
    """``keyed``: id, norm, key. The index, written by its owners and read again: one row per row, or per text of a hot key."""
    rows = keyed.select("key", "norm", "id", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("hot"))
    if plan.hot is not None:
        few = F.broadcast(plan.hot)
        folded = keyed.join(few, "key", "left_semi").groupBy("key", "norm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        rows = rows.join(few, "key", "left_anti").unionByName(folded.select("key", "norm", "id", "copies", F.lit(True).alias("hot")))
    path = f"{scratch(keyed.sparkSession, 'exact-index')}/buckets"
    owned = own(plan.deal(rows))
    owned.select("bucket", "key", "chain_no", F.sha2("norm", 256).alias("sha"), "first", "hot", "id", "keep_id", "group_size").write.parquet(path)
    return keyed.sparkSession.read.parquet(path)


def sized(keyed: DataFrame) -> DataFrame:
    return keyed.select("key", F.octet_length("norm").alias("size"))


def build_index(keyed: DataFrame, capacity: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int, list[int]]:
    """``keyed``: id, norm, key. The index's entries, one per different text, and its directory."""
    plan = plan_directory(sized(keyed), capacity, hot_rows)
    return postings(keyed, plan).filter("first"), plan.depth, plan.slots


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, hot_rows: int = HOT_ROWS, key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, chain_no (place in its key's chain)."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("key", key(F.col("norm")))
    plan = plan_directory(sized(keyed), capacity, hot_rows)
    index = postings(keyed, plan)
    found = index.filter("not hot").select("id", "keep_id", "group_size", "sha", "chain_no")
    if plan.hot is not None:
        entries = F.broadcast(index.filter("hot").select("key", "sha", "keep_id", "group_size", "chain_no"))
        probes = keyed.join(F.broadcast(plan.hot), "key", "left_semi").select("id", "key", F.sha2("norm", 256).alias("sha"))
        found = found.unionByName(probes.join(entries, ["key", "sha"]).select("id", "keep_id", "group_size", "sha", "chain_no"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "chain_no"
    )


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, hot_rows: int = HOT_ROWS, key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row of ``docs``, all columns, per different text: the one with the smallest id (null ids last), of rows that share it the one with the smallest raw
    text, then any. The rows themselves go to their owners, so nothing is joined back.
    """
    names, row = docs.columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), normalised(F.col(text_col)).alias("norm")).withColumn("key", key(F.col("norm")))
    plan = plan_directory(sized(packed), capacity, hot_rows)
    rows = packed.select("key", "row", "id")
    if plan.hot is not None:
        few = F.broadcast(plan.hot)
        order = F.struct(F.col("id").isNull(), "id", F.col("row")[text_col])
        folded = packed.join(few, "key", "left_semi").groupBy("key", "norm").agg(F.min_by("row", order).alias("row"), F.min("id").alias("id"))
        rows = rows.join(few, "key", "left_anti").unionByName(folded.select("key", "row", "id"))
    dealt = plan.deal(rows).withColumns({"norm": normalised(F.col("row")[text_col]), "raw": F.col("row")[text_col]})
    one = Window.partitionBy("bucket", "key", "norm").orderBy(F.col("id").asc_nulls_last(), "raw")
    return dealt.withColumn("place", F.row_number().over(one)).filter("place = 1").select(*[F.col("row")[c].alias(c) for c in names])
