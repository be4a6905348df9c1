"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are words (see ``words``). The CGK walk embeds a window of words so that few edits become few differing coordinates: step j
reads the word at the walk's place and a random bit of (j, word) says whether the place moves on. Each repetition has
its own random bits and samples ``coords`` coordinates of the walk; windows that agree on them with an item's window are candidates. A window
begins at every word of every document; an item is entered from every ``stride`` words on, so that an edit near
its beginning doesn't hide it. Signatures are built coordinate by coordinate, and a window is given up as soon as no item has the
signature so far: the outcome is that of whole signatures, for a small part of the work.

Repetitions are added until simulated copies of the items, edited as much as the similarity allows and set in other words, are found at
``target_recall`` or there are ``max_walks``. For each item length that is still found less often, mostly the short ones, all runs of words that so
few edits must leave whole are looked for as well, so that no such copy is missed.
Every candidate is then verified exactly: the fewest word edits that turn the item into any passage around the
window. An item is found if 1 - edits / words of the item is ``similarity`` or more.

Documents stay where they are: the only thing that is sent is the items' index, of ``block_chars`` characters of items at most; larger benchmarks
are worked through in blocks.

Defined results: null or empty text has no words and is clean; items without words find nothing; repeated items are looked for once; rows that repeat
an id are judged each; very long texts are read whole; empty tables give empty results; extra columns are ignored. An item shorter than
1 / (1 - similarity) words must occur as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.words import hash_words, mix, slices

FILTER_BITS = 18
#: Simulated copies for each item length.
TRIALS = 400
SCHEMA = "doc_id long, item_id long, start_word long, end_word long, edits int, similarity double"


@dataclass
class Walk:
    """One repetition: its random bits, the coordinates it samples, and the items' signatures."""

    seed: np.uint64
    coords: list[int]
    filters: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray | None = None
    anchors: np.ndarray | None = None

    def bits(self, tokens: np.ndarray) -> np.ndarray:
        return mix(tokens ^ self.seed)

    def run(self, tokens: np.ndarray, bits: np.ndarray, place: np.ndarray, pruned: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(index into ``place``, signature) of the windows left; the signatures so far by coordinate if not pruned."""
        index, sign, step, so_far = None, np.zeros(len(place), np.uint64), 0, []
        for k, coord in enumerate(self.coords):
            while step < coord:
                place = place + ((bits[place] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
                step += 1
            sign = (sign ^ tokens[place]) * np.uint64(0x9E3779B97F4A7C15)
            sign ^= sign >> np.uint64(29)
            if pruned:
                keep = np.flatnonzero(self.filters[k][(sign * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                place, sign, index = place[keep], sign[keep], keep if index is None else index[keep]
            else:
                so_far.append(sign.copy())
        return index, sign, so_far

    def hold(self, flat: np.ndarray, place: np.ndarray, usable: np.ndarray) -> None:
        """Keep the signatures of the windows of ``flat`` that begin at ``place``, for the anchors ``usable``."""
        _, sign, so_far = self.run(flat, self.bits(flat), place, False)
        for s in so_far:
            table = np.zeros(1 << FILTER_BITS, dtype=bool)
            table[(s[usable] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters.append(table)
        self.anchors = usable[np.argsort(sign[usable], kind="stable")]
        self.keys = sign[self.anchors]


class Run(Walk):
    """Words in a row: every step moves on."""

    def bits(self, tokens: np.ndarray) -> np.ndarray:
        return np.full(len(tokens), np.iinfo(np.uint64).max, dtype=np.uint64)


def reach(coords: list[int]) -> int:
    return coords[-1] + 1


@dataclass
class Index:
    ids: list
    items: list[np.ndarray]
    edits: list[int]
    similarity: float
    walks: list[Walk]
    anchors: np.ndarray  # (item, place in the item)
    recall: float = 0.0

    @staticmethod
    def build(ids: list, texts: list[str], similarity: float, target_recall: float, coords: int, span: int, stride: int, max_walks: int, seed: int = 7) -> Index:
        w = hash_words(texts)
        items = [w.hashes[a:b] for a, b in zip(w.offsets, w.offsets[1:], strict=False)]
        kept = [k for k, t in enumerate(items) if len(t)]
        items, ids = [items[k] for k in kept], [ids[k] for k in kept]
        edits = [int((1 - similarity) * len(t) + 1e-9) for t in items]
        at = [(k, a) for k, t in enumerate(items) for a in range(0, max(1, len(t) - (span + 1) // 2), stride)]
        index = Index(ids, items, edits, similarity, [], np.array(at, dtype=np.int64).reshape(-1, 2))
        if items:
            index.grow(target_recall, coords, span, max_walks, np.random.default_rng(seed))
        return index

    def grow(self, target: float, coords: int, span: int, max_walks: int, rng: np.random.Generator) -> None:
        pad = np.zeros(span + 1, np.uint64)
        flat = np.concatenate([np.concatenate([t, pad]) for t in self.items])
        begin = np.cumsum([0] + [len(t) + span + 1 for t in self.items[:-1]])
        place = begin[self.anchors[:, 0]] + self.anchors[:, 1]
        room = np.array([len(t) for t in self.items])[self.anchors[:, 0]] - self.anchors[:, 1]
        lengths = np.array([len(t) for t in self.items])
        # lengths beyond two spans count together up to each doubling
        kinds, kind = np.unique(np.where(lengths <= 2 * span, lengths, 2 * span + np.ceil(np.log2(np.maximum(lengths / (2 * span), 1)))), return_inverse=True)
        trial = [int(k) for c in range(len(kinds)) for k in rng.choice(np.flatnonzero(kind == c), TRIALS)]
        around = [rng.integers(1, 1 << 62, 2 * (span + 1), dtype=np.uint64) for _ in trial]
        copies = [np.concatenate([x[: span + 1], edited(self.items[k], self.edits[k], rng), x[span + 1 :]]) for k, x in zip(trial, around, strict=True)]
        tried = np.concatenate([*copies, pad])
        owner = np.repeat(np.arange(len(trial)), [len(t) for t in copies])
        trial, found = np.array(trial), np.zeros(len(trial), dtype=bool)

        def recall() -> np.ndarray:
            return np.bincount(kind[trial], weights=found) / TRIALS

        def look(walk: Walk) -> None:
            self.walks.append(walk)
            starts, anchors = self.candidates(walk, tried)
            starts, anchors = starts[starts < len(owner)], anchors[starts < len(owner)]
            found[owner[starts[self.anchors[anchors, 0] == trial[owner[starts]]]]] = True

        shortest = min(len(t) for t in self.items)
        while len(self.walks) < max_walks and (recall()[kind].mean() < target or len(self.walks) < 2):
            # the last walk allowed, and every fourth, samples little enough for the shortest item
            width = span if shortest >= span or len(self.walks) % 4 else max(1, shortest)
            picked = sorted(rng.choice(width, size=min(coords, width), replace=False).tolist())
            walk = Walk(rng.integers(1, 1 << 63, dtype=np.uint64), picked)
            walk.hold(flat, place, np.flatnonzero(room > 0))
            look(walk)
        # lengths that the walks leave below the target: however the edits fall, one run of so many words stays as it is
        short = np.flatnonzero(recall()[kind] < target)
        runs = np.array([-(-(n - e) // (e + 1)) for n, e in zip(lengths, self.edits, strict=True)])
        for r in np.unique(runs[short]):
            more = np.array([(k, a) for k in short[runs[short] == r] for a in range(lengths[k] - r + 1)], dtype=np.int64)
            self.anchors = np.concatenate([self.anchors, more])
            walk = Run(np.uint64(0), list(range(int(r))))
            walk.hold(flat, begin[self.anchors[:, 0]] + self.anchors[:, 1], np.arange(len(self.anchors) - len(more), len(self.anchors)))
            look(walk)
        self.recall = float(recall().min())

    def candidates(self, walk: Walk, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's first word, anchor). ``tokens`` ends with at least a walk's reach of zeros."""
        n = len(tokens) - reach(walk.coords)
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, sign, _ = walk.run(tokens, walk.bits(tokens), np.arange(n), True)
        lo, hi = np.searchsorted(walk.keys, sign, "left"), np.searchsorted(walk.keys, sign, "right")
        many = hi - lo
        starts = np.repeat(at, many)
        pick = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return starts, walk.anchors[pick]

    def cells(self, walk: Walk, tokens: np.ndarray, n: int, offsets: np.ndarray) -> np.ndarray:
        """Rows of (item, document, cell) to be checked. The places of one passage differ by its edits at most, so cells that wide, with a margin, do.

        Windows of one signature in the same document that begin within the smallest cell of their anchors' items are taken together, so a text that repeats itself is
        no more work for each repetition; pairs of them with anchors are formed ``PAIRS_AT_ONCE`` at a time.
        """
        at, sign, _ = walk.run(tokens, walk.bits(tokens), np.arange(max(0, len(tokens) - reach(walk.coords))), True)
        at, sign = at[at < n], sign[at < n]
        lo, hi = np.searchsorted(walk.keys, sign, "left"), np.searchsorted(walk.keys, sign, "right")
        hit = lo < hi
        at, lo, hi = at[hit], lo[hit], hi[hit]
        if not len(at):
            return np.zeros((0, 3), np.int64)
        item = self.anchors[walk.anchors, 0]
        width = np.maximum(np.array(self.edits), 1)[item]
        step = self.steps(walk, width)[lo]
        doc = np.searchsorted(offsets, at, "right") - 1
        some = np.unique(np.stack([lo, hi, doc, at // step, step], axis=1), axis=0)
        out, sizes = [], some[:, 1] - some[:, 0]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS_AT_ONCE, sizes.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "left")
        first = 0
        for last in np.unique(np.append(cuts + 1, len(some))):
            part, many = some[first:last], sizes[first:last]
            first = last
            if not len(part):
                continue
            pick = np.repeat(part[:, 0] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            low = np.repeat(part[:, 3] * part[:, 4], many) - self.anchors[walk.anchors[pick], 1]
            high = low + np.repeat(part[:, 4], many) - 1
            for end in (low, high):
                out.append(np.unique(np.stack([item[pick], np.repeat(part[:, 2], many), end // width[pick]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    @staticmethod
    def steps(walk: Walk, width: np.ndarray) -> np.ndarray:
        """For each place in the keys, the smallest width among the anchors of its signature."""
        firsts = np.flatnonzero(np.append(True, walk.keys[1:] != walk.keys[:-1]))
        return np.repeat(np.minimum.reduceat(width, firsts), np.diff(np.append(firsts, len(width))))

    def search(self, tokens: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, word after the last, edits), the best place of each item in each document."""
        if not self.walks or not len(tokens):
            return []
        longest = max(reach(w.coords) for w in self.walks)
        padded = np.concatenate([tokens, np.zeros(longest + 1, np.uint64)])
        rows = np.unique(np.concatenate([self.cells(walk, padded, len(tokens), offsets) for walk in self.walks]), axis=0)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item in np.unique(rows[:, 0]):
            own = rows[rows[:, 0] == item]
            width = max(1, self.edits[item])
            at_once = max(1, CELLS_AT_ONCE // (width + len(self.items[item]) + 2 * self.edits[item]))
            for at in range(0, len(own), at_once):
                part = own[at : at + at_once]
                first = part[:, 2] * width - self.edits[item]
                ends, cost = self.verify(
                    int(item), tokens, first, first + width + len(self.items[item]) + 2 * self.edits[item], offsets[part[:, 1]], offsets[part[:, 1] + 1],
                )
                for d, e, c in zip(part[:, 1], ends, cost, strict=True):
                    if c <= self.edits[item]:
                        key, new = (int(d), int(item)), (int(c), int(e))
                        if key not in out or new < out[key][:2]:
                            out[key] = new
        return [(
            d, i,
            self.first_word(i, tokens[max(offsets[d], e - len(self.items[i]) - c) : e]) + max(int(offsets[d]), e - len(self.items[i]) - c) - int(offsets[d]),
            e - int(offsets[d]), c,
        ) for (d, i), (c, e) in sorted(out.items())]

    def verify(self, item: int, tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc_lo: np.ndarray, doc_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits between the item and any passage of tokens[lo:hi] inside the document; (word after the passage, edits)."""
        pattern = self.items[item]
        at = lo[:, None] + np.arange(int((hi - lo).max()))
        ok = (at >= doc_lo[:, None]) & (at < doc_hi[:, None])
        text = np.where(ok, tokens[np.clip(at, 0, len(tokens) - 1)], np.uint64(0))
        steps = np.arange(text.shape[1] + 1, dtype=np.int32)
        row = np.zeros((len(lo), text.shape[1] + 1), dtype=np.int32)
        for i, word in enumerate(pattern, 1):
            new = np.empty_like(row)
            new[:, 0] = i
            np.minimum(row[:, :-1] + (text != word), row[:, 1:] + 1, out=new[:, 1:])
            row = np.minimum.accumulate(new - steps, axis=1) + steps
        best = row.argmin(axis=1)
        return lo + best, row[np.arange(len(row)), best]

    def first_word(self, item: int, text: np.ndarray) -> int:
        """Where the best passage that ends with ``text`` begins."""
        pattern, row = self.items[item][::-1], np.arange(len(text) + 1)
        for word in pattern:
            new = np.minimum(row[:-1] + (text[::-1] != word), row[1:] + 1)
            row = np.concatenate([[row[0] + 1], new])
            row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
        return len(text) - int(row.argmin())


def edited(words: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(n):
        kind, at = rng.integers(0, 3), int(rng.integers(0, max(1, len(out))))
        new = int(rng.integers(1, 1 << 62))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif out:
            out.pop(at)
    return np.array(out, dtype=np.uint64)


def indexes(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int, **options) -> Iterator[Index]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        rows.sort(key=lambda r: (r["item"] is None, r["item"] or 0, r["text"]))
        yield Index.build([r["item"] for r in rows], [r["text"] for r in rows], **options)


#: Bounds of the arrays in a search, in numbers.
PAIRS_AT_ONCE, CELLS_AT_ONCE = 1 << 20, 1 << 20

DEFAULTS = {"similarity": 0.8, "target_recall": 0.98, "coords": 5, "span": 18, "stride": 2, "max_walks": 24}


def find_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_chars: int = 4_000_000, **options,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, end_word, edits, similarity."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, item_col, item_text_col, block_chars, **DEFAULTS | options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for start, texts in slices(b.column(1)):
                    ids, w = b.column(0).slice(start, len(texts)), hash_words(texts)
                    hits = index.search(w.hashes, w.offsets)
                    cols = list(zip(*hits, strict=True)) or [[]] * 5
                    made = [
                        ids.take(pa.array(cols[0], pa.int64())),
                        pa.array([index.ids[i] for i in cols[1]], pa.int64()),
                        pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.int64()),
                        pa.array(cols[4], pa.int32()),
                        pa.array([1 - c / len(index.items[i]) for i, c in zip(cols[1], cols[4], strict=True)], pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(made, names=["doc_id", "item_id", "start_word", "end_word", "edits", "similarity"])

        found = picked.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 4_000_000,
    **options,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found. Nothing is shuffled."""
    for index in indexes(benchmark, item_col, item_text_col, block_chars, **DEFAULTS | options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start, texts in slices(b.column(b.schema.get_field_index(text_col))):
                    w = hash_words(texts)
                    clean = np.ones(len(texts), dtype=bool)
                    clean[[h[0] for h in shared.value.search(w.hashes, w.offsets)]] = False
                    yield b.slice(start, len(texts)).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
