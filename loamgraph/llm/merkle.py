"""A Merkle manifest of a dataset: digests of rows, of sources and of all, with a proof for every row. DataFrame operations only.

A leaf is the digest of a row's fields. In each source leaves ascend by id; while there are more than one, every ``FAN`` consecutive nodes become the digest of their concatenated
digests, the last run too if it is shorter. The sources' roots are the leaves of one more tree.

For a parent its preimage is kept, the concatenated digests of its children. A child finds its siblings by cutting its own 64 characters out of the parent's preimage, and
folds a changed digest upwards by setting it in their place. Nothing else of the tree is needed.

Leaves are placed by one range sort and numbered from the starts of its parts. ``LEVELS`` levels are made at once: a block of 243 neighbours, wherever their source lies, is a row of
its own with its preimages, so a hot source is many blocks of one size. A block's root is a leaf of the next layer, a 243rd as large; layers are written to the shared
folder. On the way down a block gets the preimages above it once, for all its leaves, and each leaf takes its proof from them in place: paths are never shuffled by leaf.

Defined results: null fields are ``-``; rows without an id come first; rows that repeat an id are ordered by their leaf, and equal rows are interchangeable, also in proofs; a
lone leaf is its source's root and a lone source's root the root, the digest of no siblings is that of the empty text; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import SMALL, scratch

#: Children of a parent.
FAN = 3
#: Levels of a block.
LEVELS = 5
BLOCK = FAN**LEVELS
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(field: Column) -> Column:
    t = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*map(encoded, fields)))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = f"{scratch(df.sparkSession, 'merkle')}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` (with ``tree``) and their ``pos`` in the tree, from 0; tree and ``n``). Equal rows may lie in several parts of the sort."""
    tie = F.monotonically_increasing_id().alias("_tie")
    path = f"{scratch(rows.sparkSession, 'merkle')}/sorted"
    spread = rows.select("*", tie).orderBy("tree", *[F.col(c).asc_nulls_first() for c in order], "_tie").drop("_tie")
    spread.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    at = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    starts = at.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("tree").orderBy("_part"))  # a row per part of the sort
    starts = keep(starts.withColumn("_before", upto - F.col("_n")), "starts")
    few = F.broadcast(starts) if starts.count() <= SMALL else starts  # parts and trees
    numbered = at.join(few.drop("_n"), ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
    return numbered.drop("_part", "_at", "_first", "_before"), starts.groupBy("tree").agg(F.sum("_n").alias("n"))


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves: none above one."""
    powers = [FAN**k for k in range(40) if FAN**k < 1 << 62]
    return reduce(lambda a, b: a + b, [(n > F.lit(p).cast("long")).cast("int") for p in powers])


def runs(hashes: Column) -> Column:
    """The preimages of the parents of these digests."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FAN).cast("int")), lambda i: F.array_join(F.slice(hashes, i * FAN + 1, FAN), ""))


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes``: tree, pos, hash, left (levels above), and anything else. A row per block: tree, block, left, ``nodes`` (by pos), ``pre1`` to ``pre5`` (null above the
    top) and its root's ``hash``.
    """
    extra = [c for c in nodes.columns if c not in ("tree", "left")]
    made = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct("pos", *[c for c in extra if c != "pos"]))).alias("nodes")
    )
    made = made.withColumn("_h0", F.col("nodes")["hash"])
    for k in range(1, LEVELS + 1):
        made = made.withColumn(f"pre{k}", F.when(F.col("left") >= k, runs(F.col(f"_h{k - 1}"))))
        made = made.withColumn(f"_h{k}", F.coalesce(F.transform(f"pre{k}", digest), F.col(f"_h{k - 1}")))
    kept = made.select("tree", "block", "left", "nodes", *[f"pre{k}" for k in range(1, LEVELS + 1)], F.col(f"_h{LEVELS}")[0].alias("hash"))
    return keep(kept, name)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """All layers of blocks over ``nodes``, from the leaves; the last has one block per tree left."""
    layers = []
    while True:
        layers.append(blocks(nodes, f"layer{len(layers)}"))
        more = layers[-1].filter(F.col("left") > LEVELS)
        if more.isEmpty():
            return layers
        nodes = more.select("tree", F.col("block").alias("pos"), "hash", (F.col("left") - LEVELS).alias("left"))


def tops(layers: list[DataFrame]) -> DataFrame:
    """tree and the ``hash`` of its root."""
    return reduce(lambda a, b: a.unionByName(b), [x.filter(F.col("left") <= LEVELS).select("tree", "hash") for x in layers])


def steps(i: Column) -> list[tuple[Column, Column]]:
    """(preimage, place in it) of the ``i``th node of a block at each level; the preimage is null above the top."""
    return [(F.get(f"pre{k}", F.floor(i / FAN**k).cast("int")), (F.floor(i / FAN ** (k - 1)) % FAN).cast("int")) for k in range(1, LEVELS + 1)]


def siblings(preimage: Column, place: Column) -> Column:
    return F.concat(F.substring(preimage, F.lit(1), place * WIDTH), F.substring(preimage, place * WIDTH + WIDTH + 1, F.lit(FAN * WIDTH)))


def folded(preimage: Column, place: Column, child: Column) -> Column:
    """The parent's digest if its child there were ``child``."""
    return digest(F.concat(F.substring(preimage, F.lit(1), place * WIDTH), child, F.substring(preimage, place * WIDTH + WIDTH + 1, F.lit(FAN * WIDTH))))


def no_path() -> Column:
    return F.array().cast("array<struct<pre:string,place:int>>")


def path_of(i: Column) -> Column:
    """The steps inside the block and those above it."""
    own = F.array(*[F.struct(p.alias("pre"), s.alias("place")) for p, s in steps(i)])
    return F.concat(F.filter(own, lambda s: s["pre"].isNotNull()), F.col("above"))


def descend(layers: list[DataFrame], over: DataFrame | None) -> DataFrame:
    """The lowest layer with ``above``: the steps from each block's root to the root of all. ``over``: tree and the steps above its root."""
    above = None
    for layer in reversed(layers):
        top = layer.filter(F.col("left") <= LEVELS)
        top = top.withColumn("above", no_path()) if over is None else top.join(over, "tree")
        if above is None:
            blocks_of = top
        else:
            blocks_of = top.unionByName(layer.filter(F.col("left") > LEVELS).join(above, ["tree", "block"]))
        if layer is layers[0]:
            return blocks_of
        found = F.transform("nodes", lambda x, i: F.struct(x["pos"].alias("block"), path_of(i).alias("above")))
        above = blocks_of.select("tree", F.explode(found).alias("n")).select("tree", "n.*")
    raise AssertionError("no layers")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered``: fields as they are found to be now; the leaf of those is folded with the siblings of the original. Without it, the original leaf is.
    """
    source, now = F.col(source_col).cast("string"), tampered or {}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("tree"),
        F.col(id_col).cast("long").alias("doc_id"),
        leaf(*[F.col(f) for f in fields]).alias("hash"),
        leaf(*[now.get(f, F.col(f)) for f in fields]).alias("found"),
    )
    numbered, counts = placed(rows, ["doc_id", "hash"])
    sized = counts.select("tree", depth(F.col("n")).alias("left"))
    few = F.broadcast(sized) if sized.count() <= SMALL else sized
    layers = climb(numbered.join(few, "tree"))
    roots = tops(layers)
    over_rows, over_counts = placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    total = over_counts.agg(F.sum("n")).first()[0] or 0
    over_layers = climb(over_rows.withColumn("left", depth(F.lit(total).cast("long"))))
    root = tops(over_layers).first()
    in_block = F.transform("nodes", lambda x, i: F.struct(x["name"].alias("tree"), path_of(i).alias("above")))
    over = keep(descend(over_layers, None).select(F.explode(in_block).alias("n")).select("n.*"), "over")
    over = F.broadcast(over) if total <= SMALL else over
    named = roots.withColumnRenamed("hash", "subroot")
    found = descend(layers, over).join(F.broadcast(named) if total <= SMALL else named, "tree")

    def judged(x: Column, i: Column) -> Column:
        path = path_of(i)
        return F.struct(
            x["doc_id"].alias("doc_id"), x["hash"].alias("leaf"),
            digest(F.array_join(F.transform(path, lambda s: siblings(s["pre"], s["place"])), "")).alias("proof_sha256"),
            F.aggregate(path, x["found"], lambda h, s: folded(s["pre"], s["place"], h)).alias("folded_root"),
        )

    out = found.select("tree", "subroot", F.explode(F.transform("nodes", judged)).alias("n")).select("tree", "subroot", "n.*")
    return out.select(
        "doc_id", F.when(F.col("tree") != "n", F.substring("tree", 2, 1 << 30)).alias("source"), "leaf", "subroot", F.lit(root["hash"] if root else None).alias("root"),
        "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root["hash"] if root else None)).alias("verified"),
    )
