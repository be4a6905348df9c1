"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed against each: from each
place the longest match that occurs in the sample is one phrase, an unseen character is a phrase of its own. A phrase costs the logarithm of
the sample's length, which a place in it takes to name, so a language with little text is not at a disadvantage: the fewest bits per character win. All letters of all samples have codes. Transitions by
the most frequent letters are in a dense table, those by the others in one sorted list that is searched, so many scripts, or one with thousands of letters, cost no wider
table. All texts of a batch are parsed in step with one another.

Text is lower-cased; whatever is not a letter becomes one space per run. Whole texts are parsed, in segments of ``SEGMENT`` characters (a
phrase ends with its segment), so a very long text costs no more per character than a short one.

The sample: ``docs_per_lang`` documents at most of each language, chosen by a hash of the id, ``chars_per_lang`` characters at most; both are
parameters. Score: the winner's share when languages are weighted by bits per character to the power -4.

Defined results: text that is null or has no letters is ``und`` with score 0; ties go to the language first in order; null languages teach nothing; without any labelled
text all is ``und``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.words import slices

UND = "und"
SEGMENT = 512
#: Most letters with a column in the dense table, and most bytes it takes; neither changes any result.
ALPHABET, TABLE_BYTES = 64, 1 << 28
#: Codes: 0 a letter that no sample has, 1 a run of anything but letters, then letters by frequency.
UNSEEN, GAP = 0, 1
CODE_BITS = 21
#: Most languages that are told apart; their list reaches the driver.
MAX_LANGUAGES = 256


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Of an integer sequence: each state's transitions, symbol to state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # code of every code point
    width: int  # codes below have a column
    table: np.ndarray  # flat; entries are offsets of the next state's row, or -1
    rare: np.ndarray  # sorted: a state's row offset, then a code of ``width`` or more
    rare_next: np.ndarray
    roots: np.ndarray
    costs: np.ndarray  # bits that a phrase takes to name: the logarithm of the sample's length

    @staticmethod
    def fit(samples: dict[str, list[str]], chars_per_lang: int) -> Model:
        letters, counts = letter_table(), Counter()
        kept: dict[str, list[np.ndarray]] = {}
        for lang in sorted(samples):
            room, kept[lang] = chars_per_lang, []
            for text in samples[lang]:
                points = code_points(text)[:room]
                room -= len(points)
                kept[lang].append(points)
                counts.update(points[letters[points]].tolist())
                if room <= 0:
                    break
        codes = np.where(letters, UNSEEN, GAP).astype(np.int32)
        for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
            codes[c] = 2 + k
        states: list[dict[int, int]] = []
        roots, costs = [], []
        for texts in kept.values():
            roots.append(len(states))
            parts = [np.append(squeeze(codes[t]), UNSEEN) for t in texts]  # texts are held apart by a letter that is never followed
            costs.append(np.log2(max(2, sum(len(p) - 1 for p in parts))))
            own = suffix_automaton(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            states += [{s: t + roots[-1] for s, t in m.items() if s != UNSEEN} for m in own]
        width = max(2, min(ALPHABET, TABLE_BYTES // (4 * max(1, len(states)))))
        sizes = [len(m) for m in states]
        state = np.repeat(np.arange(len(states), dtype=np.int64), sizes)
        code = np.fromiter((s for m in states for s in m), dtype=np.int64, count=sum(sizes))
        to = np.fromiter((t for m in states for t in m.values()), dtype=np.int64, count=sum(sizes)) * width
        table = np.full(len(states) * width, -1, dtype=np.int32 if len(states) * width < 1 << 31 else np.int64)
        dense = code < width
        table[state[dense] * width + code[dense]] = to[dense]
        rare = (state[~dense] * width << CODE_BITS) + code[~dense]
        order = np.argsort(rare)
        return Model(list(kept), codes, width, table, rare[order], to[~dense][order], np.array(roots, dtype=np.int64) * width, np.array(costs))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none; arrays of one shape."""
        far = code >= self.width
        if not far.any():
            return self.table[state + code].astype(np.int64)
        out = self.table[state + np.where(far, UNSEEN, code)].astype(np.int64)
        wanted = (state[far] << CODE_BITS) + code[far]
        at = np.minimum(np.searchsorted(self.rare, wanted), max(0, len(self.rare) - 1))
        hit = self.rare[at] == wanted if len(self.rare) else np.zeros(len(wanted), dtype=bool)
        out[far] = np.where(hit, self.rare_next[at] if len(self.rare) else -1, -1)
        return out

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per text and language, characters parsed, whether the text has a letter."""
        parts, lettered = [], np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            coded = self.codes[code_points(t)] if t else np.zeros(0, np.int32)
            lettered[i] = bool((coded != GAP).any())
            parts.append(squeeze(coded))
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        counts = np.zeros((len(self.roots), len(texts)), dtype=np.int64)
        if not sizes.sum() or not len(self.roots):
            return counts.T, sizes, lettered
        flat = np.concatenate([*parts, np.zeros(SEGMENT, np.int32)])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n_seg = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), n_seg)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        at = begin[owner] + nth * SEGMENT
        length = np.minimum(sizes[owner] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        at, length, owner = at[order], length[order], owner[order]
        grid = np.ascontiguousarray(flat[at[:, None] + np.arange(int(length[0]))].T)
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        roots = self.roots[:, None]
        state = np.repeat(roots, len(at), axis=1)
        found = np.zeros((len(roots), len(at)), dtype=np.int32)
        for t in range(int(length[0])):
            m = int(active[t])
            ch = grid[t, :m]
            step = self.step(state[:, :m], np.broadcast_to(ch, (len(roots), m)))
            lost = step < 0
            if lost.any():
                lang, seg = np.nonzero(lost)
                again = self.step(self.roots[lang], ch[seg])
                # the phrase before ends unless nothing has been matched; an unseen character is one itself
                found[lang, seg] += (state[lang, seg] != self.roots[lang]).astype(np.int32) + (again < 0)
                step[lang, seg] = np.where(again < 0, self.roots[lang], again)
            state[:, :m] = step
        found += state != roots
        np.add.at(counts.T, owner, found.T)
        return counts.T, sizes, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts, sizes, lettered = self.phrases(texts)
        if not len(self.languages):
            return [UND] * len(texts), np.zeros(len(texts))
        rate = np.maximum(counts, 1) * self.costs / np.maximum(sizes, 1)[:, None]
        weight = (rate.min(axis=1, keepdims=True) / rate) ** 4
        best = rate.argmin(axis=1)
        score = np.where(lettered, 1 / weight.sum(axis=1), 0.0)
        return [self.languages[b] if ok else UND for b, ok in zip(best, lettered, strict=True)], score


def squeeze(coded: np.ndarray) -> np.ndarray:
    """One gap for each run of gaps."""
    if not len(coded):
        return coded
    gap = coded == GAP
    keep = np.ones(len(coded), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return coded[keep]


def sample_texts(docs: DataFrame, lang_col: str, text_col: str, id_col: str, learn_from: Column, docs_per_lang: int, chars_per_lang: int) -> dict[str, list[str]]:
    """About ``docs_per_lang`` texts of each language: rows whose hashed id falls below the share wanted. One narrow pass, one with text."""
    usable = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    spread = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    shares = [F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, 1.2 * docs_per_lang / r["n"]))) for r in sizes]
    cut = F.substring(F.col(text_col), 1, chars_per_lang)  # no more of one text is used
    picked = usable.filter(spread < (F.coalesce(*shares) if shares else F.lit(0.0)))
    rows = picked.select(F.col(lang_col).alias("lang"), cut.alias("text"), spread.alias("u"))
    out: dict[str, list[str]] = {}
    for r in sorted(rows.limit(3 * docs_per_lang * max(1, len(sizes))).collect(), key=lambda r: (r["u"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: v[:docs_per_lang] for k, v in out.items()}


def fit(
    docs: DataFrame, learn_from: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_lang: int = 60, chars_per_lang: int = 24_000
) -> Model:
    return Model.fit(sample_texts(docs, lang_col, text_col, id_col, learn_from, docs_per_lang, chars_per_lang), chars_per_lang)


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE_BYTES, and MAX_LANGUAGES times 3 * chars_per_lang rare transitions at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for start, texts in slices(b.column(1)):
                lang, score = m.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of ``least_score`` or more. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in slices(b.column(b.schema.get_field_index(text_col))):
                lang, score = shared.value.predict(texts)
                ok = [x != UND and s >= least_score for x, s in zip(lang, score, strict=True)]
                yield b.slice(start, len(texts)).filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
