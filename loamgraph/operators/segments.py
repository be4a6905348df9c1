"""A BM25 index of segments that follows its documents, with postings in blocks that searches can skip.

Each ``upsert`` cuts its own documents into words and writes them as a segment, under a new generation; older postings of the same documents stay where they are and are listed as tombstones by
generation and id, with how many of each term they were, so document frequencies, the number of documents and their mean length are always those of an index built anew. Segments of like size are merged when
there are ``FAN`` of them, from their postings: no text is read again, and a posting is rewritten a logarithmic number of times.

The postings of a term are in blocks of ``BLOCK`` at most, the strongest first, as one row each with the largest frequency, the smallest length and the best strength in it, which bound every score inside whatever
the collection's statistics are by now. A search for the best ``k`` scores the terms' strongest blocks first; the k-th best sum there is a score that the result must reach. A block is then left
out if its bound and the best that all other terms could add stay below: no document in it can be in the result, so the result is that of scoring everything. What is left is read by
(segment, term, last block), which reaches the scan.

Blocks, documents and tombstones are tables of one group, so readers see all of an update or nothing. Documents have one row per id in the index: of rows that share an id in one batch
the one with the largest text counts; rows without an id are left out.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.search import K1, B, query_terms, tokens
from loamgraph.session import SMALL, discard, keep
from loamgraph.sources.group import Group
from loamgraph.sources.store import VersionedTable

#: Postings of a block; segments of one size that are merged.
BLOCK, FAN = 128, 4
BLOCKS = "segment int, term string, block long, n long, max_tf long, min_dl int, top double, average double, postings array<struct<id:{id},label:string,tf:long,dl:int,gen:int>>"
POSTING = ("id", "label", "tf", "dl", "gen")


def impact(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average or 1.0)))


EMPTY = {"documents": 0, "words": 0, "segments": {}, "dead": [], "next": 0}


class SegmentedIndex:
    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", buckets: int = 32, fan: int = FAN):
        self.spark, self.id_type, self.fan = spark, id_type, fan
        self.blocks = VersionedTable(spark, f"{root}/blocks", ["term", "segment", "block"], buckets, by=["term"], stats=None)
        self.docs = VersionedTable(spark, f"{root}/documents", ["id"], buckets, stats=None)
        self.tombs = VersionedTable(spark, f"{root}/tombstones", stats=None)
        self.lost = VersionedTable(spark, f"{root}/lost-terms", stats=None)
        self.group = Group(spark, root, {"blocks": self.blocks, "documents": self.docs, "tombstones": self.tombs, "lost": self.lost})

    # -- what is in it

    def exists(self) -> bool:
        return self.group.number() >= 0

    @property
    def facts(self) -> dict:
        """documents, words, segments (by number: postings, generations, files), dead (of generations with tombstones), whatever a caller adds."""
        return EMPTY | self.group.record()["facts"]

    @property
    def documents(self) -> int:
        return self.facts["documents"]

    @property
    def average(self) -> float:
        f = self.facts
        return f["words"] / f["documents"] if f["documents"] else 0.0

    def _tombstones(self) -> DataFrame:
        return self.group.read("tombstones", self._schema(f"gen int, id {self.id_type}"))

    def _schema(self, text: str):
        return self.spark.createDataFrame([], text).schema

    def _alive(self, blocks: DataFrame) -> DataFrame:
        """The postings of these blocks that no tombstone covers: term, id, label, tf, dl, gen, what else a block has."""
        own = [c for c in blocks.columns if c != "postings"]
        rows = blocks.select(*own, F.explode("postings").alias("p")).select(*own, "p.*")
        return rows.join(self._tombstones(), ["gen", "id"], "left_anti") if self.facts["dead"] else rows

    @property
    def postings(self) -> DataFrame:
        """term, id, label, tf, dl, as an index built anew has them."""
        return self._alive(self.group.read("blocks", self._schema(BLOCKS.format(id=self.id_type)))).select("term", "id", "label", "tf", "dl")

    def hits(self, terms: list[str]) -> DataFrame:
        return self._alive(self._blocks_of(terms)).select("term", "id", "label", "tf", "dl")

    def _blocks_of(self, terms: list[str]) -> DataFrame:
        version = self.group.record()["versions"].get("blocks", -1)
        return self.blocks.read_of(terms, version) if version >= 0 else self.spark.createDataFrame([], BLOCKS.format(id=self.id_type))

    # -- updates

    def upsert(self, docs: DataFrame, text_col: str = "text", id_col: str = "id", label_col: str | None = None, facts: dict | None = None) -> None:
        """Documents in place of those with their ids. ``facts`` are kept with the commit."""
        self.update(docs, None, text_col, id_col, label_col, facts)

    def delete(self, ids: DataFrame, facts: dict | None = None) -> None:
        """By id (the first column)."""
        self.update(None, ids, facts=facts)

    def update(self, docs: DataFrame | None, gone: DataFrame | None, text_col: str = "text", id_col: str = "id", label_col: str | None = None, facts: dict | None = None) -> None:
        """Deletes, then upserts, in one commit."""
        with self.group.commit() as held:
            held |= json.loads(json.dumps(EMPTY | held))
            if gone is not None:
                self._bury(gone.select(F.col(gone.columns[0]).cast(self.id_type).alias("id")).distinct(), held, replaced=False)
            if docs is not None:
                self._add(docs, text_col, id_col, label_col, held)
            self._merge(held)
            held |= facts or {}

    def _add(self, docs: DataFrame, text_col: str, id_col: str, label_col: str | None, held: dict) -> None:
        label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
        rows = docs.select(F.col(id_col).cast(self.id_type).alias("id"), F.struct(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), label.alias("label")).alias("d"))
        one = rows.filter("id is not null").groupBy("id").agg(F.max("d").alias("d"))
        words, at = keep(one.select("id", F.col("d.label").alias("label"), tokens(F.col("d.text")).alias("words")))  # cut into words once
        terms = F.array_distinct("words")
        sums = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words"), F.sum(F.size(terms)).alias("postings")).first()
        if not sums["n"]:
            discard(self.spark, at)
            return
        gen = held["next"]
        held["next"] += 1
        self._bury(words.select("id"), held, replaced=True)
        self.docs.write(words.select("id", F.size("words").alias("dl"), F.lit(gen).alias("gen"), terms.alias("terms")))
        held["documents"] += sums["n"]
        held["words"] += sums["words"] or 0
        each = words.select("id", "label", F.size("words").alias("dl"), F.explode("words").alias("term"))
        counted = each.groupBy("term", "id", "label", "dl").agg(F.count(F.lit(1)).alias("tf")).withColumn("gen", F.lit(gen))
        self._write_segment(gen, counted, held, {"postings": sums["postings"] or 0, "gens": [gen]}, [])
        discard(self.spark, at)

    def _bury(self, ids: DataFrame, held: dict, replaced: bool) -> None:
        """Tombstones for what the index has of these documents."""
        if not self.docs.exists() or not held["documents"]:
            return
        old, at = keep(self.docs.read().join(ids, "id", "left_semi"))
        sums = old.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"), F.collect_set("gen").alias("gens")).first()
        if not sums["n"]:
            discard(self.spark, at)
            return
        held["documents"] -= sums["n"]
        held["words"] -= sums["words"] or 0
        held["dead"] = sorted({*held["dead"], *sums["gens"]})
        self.tombs.write(old.select("gen", "id"))
        self.lost.write(old.select("gen", F.explode("terms").alias("term")).groupBy("gen", "term").agg(F.count(F.lit(1)).alias("n")))
        discard(self.spark, at)
        if not replaced:
            self.docs.delete_matching(ids, ["id"])

    def _write_segment(self, segment: int, postings: DataFrame, held: dict, fact: dict, instead_of: list[str]) -> None:
        """Blocks: the postings sorted by term and strength over all tasks, cut at every ``BLOCK`` rows and where the term changes. A frequent term is many blocks, of many tasks."""
        average = held["words"] / held["documents"] if held["documents"] else 0.0
        strong = postings.withColumn("_s", impact(F.col("tf"), F.col("dl"), average)).orderBy("term", F.desc("_s"), "id")
        at = strong.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
        made = at.groupBy("term", "block").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max("_s").alias("top"), F.collect_list(F.struct(*POSTING)).alias("postings")
        )
        head = [F.lit(segment).alias("segment"), "term", "block", "n", "max_tf", "min_dl", "top", F.lit(average or 1.0).alias("average")]
        files = self.blocks.swap(made.select(*head, "postings"), instead_of)
        held["segments"][str(segment)] = fact | {"files": files}

    def _merge(self, held: dict) -> None:
        """Segments whose sizes lie between the same powers of ``fan`` become one when there are ``fan`` of them, until nowhere are so many."""
        while True:
            classes: dict[int, list[str]] = {}
            for name, fact in sorted(held["segments"].items(), key=lambda x: int(x[0])):
                classes.setdefault(size_class(fact["postings"], self.fan), []).append(name)
            full = next((names for _, names in sorted(classes.items()) if len(names) >= self.fan), None)
            if full is None:
                return
            facts = [held["segments"].pop(name) for name in full]
            gens, files = sorted(g for f in facts for g in f["gens"]), [x for f in facts for x in f["files"]]
            live = self.blocks.read_files(files).select("term", F.explode("postings").alias("p")).select("term", "p.*")
            dead = sorted(set(gens) & set(held["dead"]))
            if dead:
                live = live.join(self.tombs.read().filter(F.col("gen").isin(dead)), ["gen", "id"], "left_anti")
            segment = held["next"]
            held["next"] += 1
            self._write_segment(segment, live, held, {"postings": sum(f["postings"] for f in facts), "gens": gens}, files)
            if dead:  # their postings are gone
                for table in (self.tombs, self.lost):
                    table.replace(table.read().filter(~F.col("gen").isin(dead)))
                held["dead"] = sorted(set(held["dead"]) - set(dead))

    # -- searching

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Documents with each term."""
        counted = self._blocks_of(terms).groupBy("term").agg(F.sum("n").alias("n"))
        if self.facts["dead"]:
            lost = self.group.read("lost").filter(F.col("term").isin(terms)).groupBy("term").agg((-F.sum("n")).alias("n"))
            counted = counted.unionByName(lost).groupBy("term").agg(F.sum("n").alias("n"))
        sums = counted.collect()  # a row per query term
        return {r["term"]: r["n"] for r in sums if r["n"]}

    def plan(self, query: str, limit: int, label: str | None = None) -> tuple[DataFrame | None, int]:
        """(the blocks that can hold one of the best ``limit`` documents, the number of all blocks of the terms)."""
        terms = query_terms(query)
        df = self.frequencies(terms) if terms else {}
        if not df:
            return None, 0
        n, average = self.documents, self.average
        weigh = F.create_map(*[x for t, d in df.items() for x in (F.lit(t), F.log(1 + (F.lit(n) - d + 0.5) / F.lit(d + 0.5)))])
        blocks = self._blocks_of(list(df)).withColumn("idf", weigh[F.col("term")])
        # a score grows with the mean length, at most in proportion
        grown = F.col("top") * F.greatest(F.lit(1.0), F.lit(average or 1.0) / F.col("average"))
        bound = F.col("idf") * F.least(impact(F.col("max_tf"), F.col("min_dl"), average), grown) * (1 + 1e-9)
        heads = blocks.select("segment", "term", "block", bound.alias("bound"))  # without the postings
        tops = {r["term"]: (r["top"], r["n"]) for r in heads.groupBy("term").agg(F.max("bound").alias("top"), F.count(F.lit(1)).alias("n")).collect()}
        first = heads.orderBy(F.desc("bound"), "segment", "block").limit(len(df) * (2 + -(-4 * limit // BLOCK))).collect()
        reached = self._score(blocks.filter(any_of([(r["segment"], r["term"], r["block"], r["block"]) for r in first])), average)
        reached = reached.filter(F.col("label") == label) if label else reached
        best = [r["score"] for r in reached.orderBy(F.desc("score")).limit(limit).select("score").collect()] if limit <= SMALL else []
        least = best[-1] if len(best) == limit else float("-inf")
        total = sum(t for t, _ in tops.values())
        others = F.create_map(*[x for t, (top, _) in tops.items() for x in (F.lit(t), F.lit(total - top))])
        last = heads.filter(F.col("bound") + others[F.col("term")] >= least).groupBy("segment", "term").agg(F.max("block").alias("to"), F.min("block").alias("from")).collect()
        kept = blocks.filter(any_of([(r["segment"], r["term"], r["from"], r["to"]) for r in last]))
        return kept, sum(c for _, c in tops.values())

    def _score(self, blocks: DataFrame, average: float) -> DataFrame:
        alive = self._alive(blocks.select("idf", "postings"))
        return alive.groupBy("id", "label").agg(F.sum(F.col("idf") * impact(F.col("tf"), F.col("dl"), average)).alias("score"))

    def search(self, query: str, limit: int, label: str | None = None, post_filter: bool = False) -> DataFrame:
        """The best ``limit`` documents: id, label, score; ties by id. ``post_filter``: the label is looked at after the cut."""
        limit = max(1, limit)
        blocks, _ = self.plan(query, limit, None if post_filter else label)
        if blocks is None:
            return self.spark.createDataFrame([], f"id {self.id_type}, label string, score double")
        scores = self._score(blocks, self.average)
        if label and not post_filter:
            scores = scores.filter(F.col("label") == label)
        top = scores.orderBy(F.desc("score"), "id").limit(limit)
        return top.filter(F.col("label") == label) if label and post_filter else top


def size_class(n: int, fan: int) -> int:
    k = 0
    while n >= fan:
        n //= fan
        k += 1
    return k


def any_of(spans: list[tuple[int, str, int, int]]) -> Column:
    """Blocks of these (segment, term, first, last); a few for each term and segment."""
    if not spans:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [(F.col("term") == t) & (F.col("segment") == s) & F.col("block").between(a, b) for s, t, a, b in spans])
