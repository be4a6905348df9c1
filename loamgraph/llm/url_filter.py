"""URL rules by a cascade of Bloom filters. DataFrame operations only.

A rule is a host and a path prefix; it fits the host and its subdomains. Every url gives candidate keys (each host
suffix with each path prefix of a length that some rule has); the distinct candidates of the whole corpus
are the key universe. Level 1 encodes the listed keys, level 2 the universe's keys that level 1 wrongly accepts, level 3
the listed keys that level 2 wrongly accepts, and so on until nothing is left over, so that for every key
of the universe the level at which it is first refused tells exactly whether it is listed; urls are then judged by a scan without any
join.

A level's bits are bounded by the list's length times the bits per key (about 1.44 log2 of universe / list for level 1, 1.44 for the
rest). They are checked against ``max_bits``: lists beyond it are split by key hash into shards with a cascade
each, every one within the bound.

Defined results: a url that is null or has no ``://`` has empty host and path and fits no rule; two rules with one key: block
wins; ties of length cannot occur between different keys of one url but for equal total length, where the longer host wins;
an empty rule list allows every url; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.session import pin

SPLIT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bitmap_construct_agg works on buckets of this many bits.
BUCKET_BITS = 32_768


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT_URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT_URL, 2)


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys that a rule fitting this url can have: host suffix, then path prefix."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*map(F.lit, path_lengths)), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    data: bytes

    def positions(self, key: Column) -> Column:
        return positions(key, self.bits, self.hashes, self.seed)

    def has(self, key: Column) -> Column:
        data = F.lit(self.data)
        probes = []
        one, step = base(key, self.bits, self.seed)
        for i in range(self.hashes):
            at = F.pmod(one + F.lit(i) * step, F.lit(self.bits))
            byte = F.conv(F.hex(F.substring(data, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            probes.append(F.getbit(byte, (at % 8).cast("int")) == 1)
        out = probes[0]
        for p in probes[1:]:
            out = out & p
        return out


def base(key: Column, bits: int, seed: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(bits))


def positions(key: Column, bits: int, hashes: int, seed: int) -> Column:
    one, step = base(key, bits, seed)
    return F.array(*[F.pmod(one + F.lit(i) * step, F.lit(bits)) for i in range(hashes)])


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``keys`` (column key) with about this rate of false positives; only its bits reach the driver."""
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2)))
    hashes = min(hashes, max(1, math.ceil(math.log2(1 / rate))))
    at = keys.select(F.explode(positions(F.col("key"), bits, hashes, seed)).alias("at"))
    parts = (
        at.groupBy((F.col("at") / BUCKET_BITS).cast("int").alias("b"))
        .agg(F.bitmap_construct_agg((F.col("at") % BUCKET_BITS).cast("long")).alias("bits"))
        .collect()
    )
    data = bytearray((bits + 7) // 8)
    for row in parts:
        start = row["b"] * BUCKET_BITS // 8
        piece = bytes(row["bits"])[: len(data) - start]
        data[start : start + len(piece)] = piece
    return Level(bits, hashes, seed, bytes(data))


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def has(self, key: Column) -> Column:
        """Exact for every key of the universe: the first level that refuses a key tells, odd ones refuse what isn't listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels, 1))):
            out = F.when(~level.has(key), F.lit(k % 2 == 0)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0, max_levels: int = 64) -> Cascade:
    """``listed``, ``universe``: distinct keys in column key; universe without the listed keys."""
    cascade = Cascade()
    inside, outside = listed, universe
    n_in, n_out = inside.count(), outside.count()
    rate = min(0.5, n_in / (n_out * math.sqrt(2))) if n_in and n_out else 0.5
    while n_in:
        if len(cascade.levels) >= max_levels:
            raise RuntimeError("the cascade does not end; are the listed keys taken out of the universe?")
        level = build_level(inside, n_in, rate, seed * 1000 + len(cascade.levels))
        cascade.levels.append(level)
        wrong = pin(outside.filter(level.has(F.col("key"))))
        inside, outside, rate = wrong, inside, 0.5
        n_in = wrong.count()
    return cascade


def sharded(listed: DataFrame, universe: DataFrame, max_bits: int, seed: int):
    """A test key -> is listed, of one cascade per shard of at most about ``max_bits`` bits."""
    shards = max(1, math.ceil(listed.count() * 64 / max_bits))
    shard = lambda c: F.pmod(F.xxhash64(c, F.lit("shard")), F.lit(shards))
    made = [
        build_cascade(listed.filter(shard(F.col("key")) == k), universe.filter(shard(F.col("key")) == k), seed * 100 + k)
        for k in range(shards)
    ]

    def has(key: Column) -> Column:
        out = made[-1].has(key)
        for k in range(shards - 1):
            out = F.when(shard(key) == k, made[k].has(key)).otherwise(out)
        return out

    return has


def ranked(keys: Column, action: str) -> Column:
    """Structs that order by key length, host length, block before allow."""
    return F.transform(
        keys,
        lambda key: F.struct(
            F.length(key).alias("n"), F.instr(key, "/").alias("host_n"), F.lit(action == "block").alias("block"), key.alias("key"), F.lit(action).alias("action")
        ),
    )


def url_filter(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bits: int = 1 << 28,
) -> DataFrame:
    """Judge every url. ``rules``: (host, path prefix, "allow" or "block"). Returns page_id, host, path, rule, verdict."""
    spark: SparkSession = pages.sparkSession
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    actions = {h.translate(str.maketrans(UPPER, LOWER)) + p: a for h, p, a in sorted(rules, key=lambda r: r[2] != "allow")}
    if not actions:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted({len(p) for _, p, _ in rules})
    keys = candidates(F.col("host"), F.col("path"), lengths)
    universe = pin(parts.select(F.explode(keys).alias("key")).distinct())
    tests = {}
    for k, action in enumerate(("block", "allow")):
        own = [(x,) for x, a in actions.items() if a == action]
        if own:
            listed = spark.createDataFrame(own, "key string")
            others = universe.join(F.broadcast(listed), "key", "left_anti") if len(own) < 100_000 else universe.join(listed, "key", "left_anti")
            tests[action] = sharded(listed, others, max_bits, k + 1)
    found = [ranked(F.filter(keys, test), action) for action, test in tests.items()]
    best = F.array_max(F.concat(*found))
    return parts.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
