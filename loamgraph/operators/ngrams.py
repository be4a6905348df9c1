"""Substring search by an index of trigrams.

Of every row's lower-cased text the different trigrams are kept as (gram, id) in a table bucketed by gram, beside the texts in a table bucketed by id. A search reads the buckets of the pattern's
trigrams only, keeps the ids that have all of them, reads the texts' buckets that those ids fall into, and looks for the pattern itself there. Only the rarest trigrams of a long
pattern are used, ``MOST`` at most; the rest could take ids out but not add any, and the texts decide anyway.

Grams are positions-free and of characters, not bytes. A pattern of fewer than three characters has no trigram: all texts are looked at. Rows of an id that is written again replace the old ones: their grams are
marked, not rewritten. Null texts are found by nothing; null ids are left out; of rows that share an id in one batch the one with the largest text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.session import SMALL
from loamgraph.sources.group import Group
from loamgraph.sources.store import VersionedTable

N, MOST = 3, 8


def grams(text: Column) -> Column:
    """The different trigrams of a text, in lower case; linear in its length."""
    chars = F.split(F.lower(text), "")
    out = chars
    for k in range(2, N + 1):
        out = F.zip_with(out, F.slice(chars, k, 1 << 30), lambda a, b: F.concat(a, b))  # null where the text has ended
    return F.array_distinct(F.filter(out, lambda g: g.isNotNull()))


def grams_of(pattern: str) -> list[str]:
    p = pattern.lower()
    return sorted({p[k : k + N] for k in range(len(p) - N + 1)})


class NgramIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark = spark
        self.texts = VersionedTable(spark, f"{root}/texts", ["id"], buckets, stats=None)
        self.postings = VersionedTable(spark, f"{root}/postings", ["gram", "id"], buckets, by=["gram"], stats=None)
        self.group = Group(spark, root, {"texts": self.texts, "postings": self.postings})

    def upsert(self, rows: DataFrame, text_col: str = "text", id_col: str = "id") -> None:
        """Rows in place of those with their ids."""
        given = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
        with self.group.commit():
            if self.texts.exists():
                old = self.texts.read().join(given.select("id").distinct(), "id", "left_semi").select("id")
                self.postings.delete_matching(old, ["id"])
            self.texts.write(given.groupBy("id").agg(F.max("text").alias("text")))
            ids = self.texts.read().join(given.select("id").distinct(), "id", "left_semi")
            new = ids.select(F.explode(grams(F.col("text"))).alias("gram"), "id")
            self.postings.append(new) if self.postings.exists() else self.postings.write(new)

    def delete(self, ids: DataFrame) -> None:
        """By id (the first column)."""
        gone = ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
        with self.group.commit():
            self.postings.delete_matching(gone, ["id"])
            self.texts.delete_matching(gone, ["id"])

    def _versions(self) -> dict:
        return self.group.record()["versions"]

    def candidates(self, pattern: str) -> DataFrame | None:
        """The ids whose text has the pattern's rarest trigrams, all of them; None if the pattern is too short to have any."""
        wanted = grams_of(pattern)
        if not wanted:
            return None
        held = self.postings.read_of(wanted, self._versions().get("postings", -1))
        if len(wanted) > MOST:
            counts = {r["gram"]: r["n"] for r in held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per trigram of the pattern
            wanted = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:MOST]
            held = self.postings.read_of(wanted, self._versions().get("postings", -1))
        return held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("id")

    def contains(self, pattern: str) -> DataFrame:
        """id and text of the rows whose text contains the pattern, case aside. ``%`` and ``_`` are themselves."""
        version = self._versions().get("texts", -1)
        if version < 0:
            return self.spark.createDataFrame([], "id string, text string")
        ids = self.candidates(pattern)
        if ids is None:
            rows = self.texts.read(version)
        else:
            few = [r["id"] for r in ids.limit(SMALL + 1).collect()]
            rows = self.texts.read_of(few, version) if len(few) <= SMALL else self.texts.read(version).join(ids, "id", "left_semi")
        return rows.filter(F.contains(F.lower("text"), F.lit(pattern.lower()))).select("id", "text")
