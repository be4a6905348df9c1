"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Documents are dealt evenly into shards by a hash of each row's place (never by id or source, so neither a source nor an id that a third of all rows share
fills a shard), and each shard is packed by itself; the number of shards grows with the total of
tokens, a shard's work does not. Inside a shard pieces go from long to short. Open bins are kept ordered by what is left in
them; each carries two bitmaps, of the sources and of the duplicate clusters it holds. The search starts at the first bin
that a piece fits and goes on to its successors until one is compatible: that is the tightest compatible bin. If there is none, a
bin is opened.

A bin holds at most one document of a source and one of a duplicate cluster. A document longer than a bin is cut: its full pieces fill
bins of their own and its last piece is packed like a document. Nothing is dropped or truncated.

Lengths are words (runs of anything but ASCII white space), or any column given.

Defined results: null or empty text, or a length below 1, counts as one token; a null source or cluster conflicts with nothing; rows that
repeat an id are packed each; the order of pieces of equal length is by id, then source; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.exact_dedup import normalised
from loamgraph.session import pin

SCHEMA = "bin_id string, slot int, doc_id long, piece int, start long, n_tokens int"
ARROW = pa.schema([("bin_id", pa.string()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])


def pack(items: list[tuple], capacity: int) -> list[list[tuple]]:
    """``items``: (tokens, source, cluster, anything...). Bins of items; tokens must be at most ``capacity``."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    order: list[tuple[int, int]] = []  # (left, bin), ascending
    bins: list[list[tuple]] = []
    sources: list[int] = []
    clusters: list[int] = []
    for item in items:
        n, source, cluster = item[:3]
        s = 0 if source is None else source_bit.setdefault(source, 1 << len(source_bit))
        c = 0 if cluster is None else cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        at = bisect_left(order, (n, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            sources.append(0)
            clusters.append(0)
        bins[b].append(item)
        sources[b] |= s
        clusters[b] |= c
        if left > n:
            insort(order, (left - n, b))
    return bins


def words(text: Column) -> Column:
    """Number of words, without building them; at least 1."""
    t = F.trim(normalised(text))
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def best_fit(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    cluster: Column | None = None,
    tokens: Column | None = None,
    shard_tokens: int = 1_000_000,
) -> DataFrame:
    """One row per piece: bin_id, slot (place in the bin), doc_id, piece, start (first token in the document), n_tokens.

    ``cluster`` defaults to the exact text after white space is normalised.
    """
    text = F.col(text_col).cast("string")
    count = words(text) if tokens is None else tokens
    own = F.xxhash64(normalised(text)) if cluster is None else cluster.cast("string")
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.greatest(F.coalesce(count.cast("long"), F.lit(1)), F.lit(1)).alias("n"),
        source.alias("source"),
        own.cast("string").alias("cluster"),
    )
    rows = pin(sized)
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    # a row's place in the checkpoint doesn't change, whichever executor reads it
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("pack")), F.lit(shards)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, out, items, made = key[0].as_py(), [], [], 0
        held = zip(*(table.column(c).to_pylist() for c in ("doc_id", "source", "n", "cluster")), strict=True)
        for doc, source, n, cluster in sorted(held, key=lambda r: [(x is not None, x) for x in r[:3]]):
            full, rest = divmod(n, capacity)
            for k in range(full):
                out.append((f"{shard}-{made}", 0, doc, k, k * capacity, capacity))
                made += 1
            if rest:
                items.append((rest, source, cluster, doc, full))
        items.sort(key=lambda x: -x[0])
        for bin_ in pack(items, capacity):
            out += [(f"{shard}-{made}", slot, doc, piece, piece * capacity, n) for slot, (n, _, _, doc, piece) in enumerate(bin_)]
            made += 1
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW.types, strict=True)], schema=ARROW)

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)


def bin_iterator(packed: DataFrame) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """For readers on one machine: (bin, [(document, first token, tokens)]) in order."""
    bin_id, held = None, []
    for r in packed.orderBy("bin_id", "slot").toLocalIterator():
        if r["bin_id"] != bin_id:
            if held:
                yield bin_id, held
            bin_id, held = r["bin_id"], []
        held.append((r["doc_id"], r["start"], r["n_tokens"]))
    if held:
        yield bin_id, held
