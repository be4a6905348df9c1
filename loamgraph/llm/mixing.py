"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

A source's target is its weight's share of the budget, at most ``most`` times its size; what is above is shared again by weight among the rest until no
source is above. A target is so many whole rounds over the source and a rest. For the rest, the rows whose hash is below the source's threshold are taken once
more, so the chosen rows of a smaller budget are among those of a larger one, and neither needs an order of the rows.

Thresholds come from histograms. Words are summed by source and leading digit of the hash (``DIGIT`` bits). In running sums the digit in which the rest is
reached is the only one that matters; its rows, a 1,024th of the source, are summed by their next digit, and so on until one row is left, which is taken
if that brings the source nearer to its target (the middle of the row lies below the rest). So every source ends within half a row of its target.

A row's hash has three parts: 60 bits of the id's digest, 63 of the text's hash, 63 of the hash of the row's place. The later ones matter only among rows whose earlier ones are equal;
rows equal in id and text are interchangeable, so reruns agree.

Sources are ranked by parts of a range sort, and shares are found by sums over the table of sources; only sums reach the driver. Thresholds go to the rows by broadcast
for the sources that hold more than a 4,096th of all rows, by a join for the others, all of which are small.

Defined results: null text has size 0, and a row of size 0 is taken 0 words; null is a source, the last one; rows that repeat an id are judged each; an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.exact_dedup import normalised
from loamgraph.session import pin

#: Bits of hash that one histogram tells apart.
DIGIT = 10
#: Of each part of the key, its bits.
PARTS = {"h": 60, "t": 63, "p": 63}
#: Sources that get their threshold by broadcast hold at least this share of all rows.
LARGE_SHARE = 4096


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space, without building them."""
    t = F.trim(normalised(text))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def half(h: Column) -> Column:
    """63 bits, so that the order of numbers is that of their bits."""
    return F.shiftrightunsigned(h, 1)


def digit(part: str, number: int) -> Column:
    """The ``number``th group of leading bits, from 0; of the last group only the bits there are."""
    left = PARTS[part] - DIGIT * (number + 1)
    return F.shiftrightunsigned(F.col(part), left) % (1 << DIGIT) if left >= 0 else F.col(part).bitwiseAND((1 << (DIGIT + left)) - 1)


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0, by code point, null last. No task holds more than its range."""
    at = pin(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    placed = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int, share: float) -> DataFrame:
    """``sources`` (source, size, rows) with ``target``. Each round caps the sources that the present level lifts above ``most`` sizes; levels only rise, so it ends."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = pin(ranked(sources).withColumn("weight", weight))
    total = held.agg(F.sum("size").alias("n")).first()["n"] or 0
    budget = int(total * min(share, most))  # no more than all sources can give
    capped, cap = F.lit(False), most * F.col("size")
    left, width, n_capped = budget, 0, -1
    while True:
        sums = held.agg(
            F.sum(F.when(capped, cap).otherwise(0)).alias("taken"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("width"), F.sum(capped.cast("int")).alias("capped")
        ).first()
        if (sums["capped"] or 0) == n_capped:
            break
        n_capped, left, width = sums["capped"] or 0, budget - (sums["taken"] or 0), sums["width"] or 0
        capped = F.lit(left).cast("decimal(20,0)") * F.col("weight") > cap.cast("decimal(20,0)") * F.lit(width)
    level = (F.lit(left).cast("long") * F.col("weight")).cast("double") / F.lit(float(max(width, 1)))
    return held.withColumn("target", F.when(capped, cap.cast("double")).otherwise(level)).drop("rank", "weight")


def spread(rows: DataFrame, facts: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` of the sources in ``facts`` (a checkpoint: key, rows, ...) joined with them. ``rows`` there is the source's number of rows."""
    large = F.col("rows") * LARGE_SHARE >= n_rows
    few, others = facts.filter(large).drop("rows"), facts.filter(~large).drop("rows")
    told = rows.join(F.broadcast(few), "key")  # LARGE_SHARE sources at most
    return told if others.isEmpty() else told.unionByName(rows.join(F.broadcast(few.select("key")), "key", "left_anti").join(others, "key"))


def thresholds(rows: DataFrame, plan: DataFrame, n_rows: int) -> DataFrame:
    """``rows``: key, size, h, t, p. ``plan``: key, rows, rest (words to take). Per key with a rest: ``limit`` (h, t, p) and ``closed``, whether the row at the limit is taken."""
    inside, state = rows, plan.filter("rest > 0").select("key", "rows", "rest", F.lit(0).cast("long").alias("before"))
    for part, bits in PARTS.items():
        for number in range(-(-bits // DIGIT)):
            sums = inside.groupBy("key", digit(part, number).alias("digit")).agg(F.sum("size").alias("words")).join(state.drop("digit"), "key")
            upto = F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("digit"))  # 1,024 rows at most
            reached = sums.withColumn("upto", upto).filter("upto >= rest")
            first = F.min_by(F.struct("rows", "rest", (F.col("upto") - F.col("words")).alias("before"), "digit"), "digit")
            state = pin(reached.groupBy("key").agg(first.alias("s")).select("key", "s.*"))
            inside = spread(inside, state.select("key", "rows", "digit"), n_rows).filter(digit(part, number) == F.col("digit"))
            inside = pin(inside.select("key", "size", *PARTS))
            spans = inside.groupBy("key").agg(*[(F.min(c) != F.max(c)).cast("int").alias(c) for c in PARTS])
            differs = spans.agg(*[F.max(c).alias(c) for c in PARTS]).first()
            if not differs[part]:
                break  # every source has one value of this part left
        if not any(differs.asDict().values()):
            break
    ends = inside.groupBy("key").agg(F.max(F.struct(*PARTS)).alias("limit"), F.sum("size").alias("words"))
    return ends.join(state, "key").select("key", "limit", (F.col("before") + F.col("words") / 2 < F.col("rest")).alias("closed"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target (of its source), times (how often it is taken), taken (words).

    ``weights`` belong to the sources in order, repeating. ``share``: the budget as a part of all words. ``size`` defaults to the number of words.
    """
    source, text = F.col(source_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = word_count(F.col(text_col)) if size is None else F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
        size.alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("-"))), 1, 15), 16, 10).cast("long").alias("h"),
        half(F.xxhash64(text)).alias("t"),
    )
    rows = pin(rows.withColumn("p", half(F.xxhash64(F.monotonically_increasing_id()))))  # texts are read once; places stay what they are
    per_source = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    named = per_source.withColumn("source", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)))
    shares = pin(targets(named, weights, most, share))
    n_rows = shares.agg(F.sum("rows").alias("n")).first()["n"] or 0
    rounds = F.coalesce(F.floor(F.try_divide("target", "size")), F.lit(0))
    rest = F.when(F.col("size") > 0, F.col("target") - rounds * F.col("size")).otherwise(0.0)
    plan = shares.select("key", "rows", "source", F.col("size").alias("source_size"), "target", rounds.cast("int").alias("rounds"), rest.alias("rest"))
    facts = pin(plan.drop("rest").join(thresholds(rows, plan, n_rows), "key", "left"))
    at = F.struct(*PARTS)
    once = F.coalesce((at < F.col("limit")) | ((at == F.col("limit")) & F.col("closed")), F.lit(False))
    found = spread(rows, facts, n_rows).withColumn("times", F.col("rounds") + once.cast("int"))
    return found.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))
