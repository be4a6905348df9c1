"""Text analytics as Column and DataFrame expressions: chunks, comment ranking, issue references, composed documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.ids import let

README_LINES = 120
DIGEST_BYTES = 4000

# Fixed values of the comment score.
SCORE_WEIGHTS = {"reaction": 0.45, "author": 0.20, "position": 0.15, "recency": 0.10, "quality": 0.10}
SCORE_THRESHOLD = 0.42
SELECT_MIN, SELECT_MAX = 3, 8
AUTHOR_WEIGHTS = {"OWNER": 1.0, "MEMBER": 0.9, "COLLABORATOR": 0.8, "CONTRIBUTOR": 0.7, "FIRST_TIMER": 0.6, "FIRST_TIME_CONTRIBUTOR": 0.6, "NONE": 0.5}
RESOLUTION_WORDS = "fix|fixed|resolve|resolved|workaround|duplicate"

# Fixed values of reference classes: (class, strength, words), strongest first.
REFERENCE_CLASSES = (
    ("closes", 3, "close|closes|closed|fix|fixes|fixed|resolve|resolves|resolved"),
    ("duplicate", 3, "duplicate"),
    ("references", 2, "reference|references|ref|refs|see|related"),
)
REFERENCE_WINDOW = 40
MOST_REFERENCES = 50


def strip(text: Column) -> Column:
    """Without white space at its ends; Spark's trim takes spaces only."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000"))


def lines_of(text: Column) -> Column:
    """Lines without their ends; LF and CRLF end lines, a last line end adds none. Empty text has no lines."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(unix, "\n"))


def line_chunks(df: DataFrame, text_col: str = "text", size: int = README_LINES) -> DataFrame:
    """One row per window of ``size`` lines: the row's columns, chunk_order, start_line, end_line (from 1), chunk_text."""

    def windows(lines: Column) -> Column:
        def window(k: Column) -> Column:
            at = k * size
            ends = F.least(at + size, F.size(lines))
            return F.struct(
                k.alias("chunk_order"), (at + 1).alias("start_line"), ends.alias("end_line"),
                F.array_join(F.slice(lines, at + 1, F.lit(size)), "\n").alias("chunk_text"),
            )

        return F.when(F.size(lines) > 0, F.transform(F.sequence(F.lit(0), ((F.size(lines) - 1) / size).cast("int")), window))

    chunks = let(lines_of(F.col(text_col)), windows)
    return df.withColumn("_c", F.explode(chunks)).select(*df.columns, "_c.chunk_order", "_c.start_line", "_c.end_line", "_c.chunk_text")


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def normalise_comment(text: Column) -> Column:
    """Lines trimmed, quoted lines (``>``) left out, white space collapsed, lower case."""
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: ~x.startswith(">"))
    return F.lower(F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " ")))


def reaction_score(plus: Column, heart: Column, hooray: Column, eyes: Column, rocket: Column, confused: Column) -> Column:
    good = (plus + heart + hooray + eyes + rocket).cast("double")
    raw = F.log1p(good) / F.log(F.lit(21.0)) - 0.5 * F.log1p(confused.cast("double")) / F.log(F.lit(6.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def author_weight(association: Column) -> Column:
    key = F.upper(strip(F.coalesce(association, F.lit("NONE"))))
    out = F.when(key == "", 0.5)
    for name, weight in AUTHOR_WEIGHTS.items():
        out = out.when(key == name, weight)
    return out.otherwise(0.6)


def position_weight(index: Column, text: Column) -> Column:
    return F.when(index == 0, 0.6).otherwise(0.3) + F.when(F.lower(text).rlike(RESOLUTION_WORDS), 0.3).otherwise(0.0)


def recency_weight(index: Column, total: Column) -> Column:
    return F.when(total <= 1, 1.0).otherwise(index / (total - 1))


def content_quality(normalised: Column) -> Column:
    size = F.octet_length(normalised)
    return F.when(size <= 80, size / 80.0).when(size >= 1200, 1200.0 / size).otherwise(1.0)


def score_comments(comments: DataFrame, group: list[str]) -> DataFrame:
    """Comments that can represent their thread, with index, total, normalised, parts of the score and score.

    ``comments``: group columns, id, body_text, author_association, created_at, reactions struct, is_bot, kind. Bots, blank texts and id 0 are out;
    places are counted before texts that repeat an earlier one are out.
    """
    order = Window.partitionBy(*group).orderBy("created_at", "id")
    r = F.col("reactions")
    kept = comments.filter(~F.coalesce("is_bot", F.lit(False)) & (strip(F.col("body_text")) != "") & (F.col("id") != 0))
    placed = kept.withColumn("index", F.row_number().over(order) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    first = Window.partitionBy(*group, "normalised").orderBy("created_at", "id")
    unique = placed.withColumn(
        "normalised", normalise_comment(F.col("body_text")),
    ).filter("normalised <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    none = F.lit(0)
    parts = {
        "reaction": reaction_score(*[F.coalesce(r[c], none) for c in ("plus_one", "heart", "hooray", "eyes", "rocket", "confused")]),
        "author": author_weight(F.col("author_association")),
        "position": position_weight(F.col("index"), F.col("body_text")),
        "recency": recency_weight(F.col("index"), F.col("total")),
        "quality": content_quality(F.col("normalised")),
    }
    out = unique.withColumns({f"{k}_part": v for k, v in parts.items()})
    return out.withColumn("score", sum((F.lit(w) * F.col(f"{k}_part") for k, w in SCORE_WEIGHTS.items()), F.lit(0.0)))


def select_comments(scored: DataFrame, group: list[str], limit_hint: int = SELECT_MAX) -> DataFrame:
    """The representative comments of each thread with their place in it.

    The best ``desired`` above the threshold, or the best whatever they score if fewer than three are above. If reviews were left out
    altogether, the best one joins, the selection is put in order again and cut: it may fall out once more.
    """
    desired = max(SELECT_MIN, min(SELECT_MAX, limit_hint))
    best = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    whole = Window.partitionBy(*group)
    ranked = scored.withColumn("rank", F.row_number().over(best)).withColumn("above", F.sum(F.when(F.col("score") >= SCORE_THRESHOLD, 1).otherwise(0)).over(whole))
    chosen = (F.col("rank") <= desired) & ((F.least("above", F.lit(desired)) < SELECT_MIN) | (F.col("score") >= SCORE_THRESHOLD))
    marked = ranked.withColumn("chosen", chosen).withColumn("is_review", F.coalesce(F.lower("kind") == "review", F.lit(False)))
    seen = F.max(F.col("chosen") & F.col("is_review")).over(whole)
    first_review = F.min(F.when(F.col("is_review"), F.col("rank"))).over(whole)
    joined = marked.withColumn("picked", F.col("chosen") | (~seen & (F.col("rank") == F.coalesce(first_review, F.lit(0)))))
    return joined.filter("picked").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= desired).drop("above", "chosen", "picked", "is_review", "rank")


def comment_digest(selected: DataFrame, group: list[str]) -> DataFrame:
    """ids in order, and their texts set off by blank lines, cut at ``DIGEST_BYTES`` with an ellipsis."""
    bodies = F.transform("_all", lambda x: x["body_text"])

    def add(done: Column, text: Column) -> Column:
        base = F.when(done == "", done).otherwise(F.concat(done, F.lit("\n\n")))
        room = F.lit(DIGEST_BYTES) - F.octet_length(base)
        cut = F.concat(base, F.substring(text, F.lit(1), F.greatest(room, F.lit(0))), F.lit("…"))
        return F.when(F.octet_length(done) >= DIGEST_BYTES, done).otherwise(F.when(F.octet_length(text) > room, cut).otherwise(F.concat(base, text)))

    gathered = selected.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("place", "id", "body_text"))).alias("_all"))  # SELECT_MAX at most
    return gathered.select(*group, F.transform("_all", lambda x: x["id"]).alias("comment_ids"), F.nullif(F.aggregate(bodies, F.lit(""), add), F.lit("")).alias("digest"))


def bytes_of(text: Column, start: Column, size: Column) -> Column:
    """A window in bytes; what it cuts of characters at its ends becomes a replacement character."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), start, size).cast("string"))


def references(text: Column, cross_repo: bool) -> Column:
    """An array of what stands around every ``#`` that counts: position, digits, before and after (windows of bytes), prefix.

    Each text is split once. Windows are put together from the ends of as many pieces as they can have characters, so the work grows with the length, not its
    square; places are summed in blocks of pieces.
    """
    block, reach = 256, REFERENCE_WINDOW + 1

    def total(sizes: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(sizes, first, n), F.lit(0), lambda a, x: a + x)

    def digits(parts: Column, k: Column) -> Column:
        return F.regexp_extract(F.element_at(parts, k + 1), "^([0-9]+)", 1)

    def counts(parts: Column, k: Column) -> Column:
        last = F.element_at(parts, k)
        free = ~F.right(last, F.lit(1)).rlike("[A-Za-z0-9/-]")
        named = last.rlike(r"(^|[\s(\[{:,])[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z")
        return F.length(digits(parts, k)).between(1, 7) & ((free | named) if cross_repo else free)

    def one(parts: Column, ends: Column, begins: Column, sizes: Column, sums: Column, k: Column) -> Column:
        near, whole, last = F.least(k, F.lit(reach)), F.floor(k / block).cast("int"), F.element_at(parts, k)
        position = total(sums, F.lit(1), whole) + total(sizes, whole * block + 1, k - whole * block) - 1
        before = let(
            F.array_join(F.slice(ends, k - near + 1, near), "#"),
            lambda head: bytes_of(head, F.greatest(F.octet_length(head) - REFERENCE_WINDOW + 1, F.lit(1)), F.lit(REFERENCE_WINDOW)),
        )
        after = bytes_of(F.array_join(F.slice(begins, k + 1, F.lit(reach)), "#"), F.length(digits(parts, k)) + 1, F.lit(REFERENCE_WINDOW))
        run = r"([^\s(\[{:,]*)\z"
        # a piece without any delimiter goes on into the one before
        prefix = F.when(last.rlike(r"[\s(\[{:,]"), F.regexp_extract(last, run, 1)).otherwise(F.regexp_extract(F.array_join(F.slice(parts, k - near + 1, near), "#"), run, 1))
        return F.struct(position.alias("position"), digits(parts, k).alias("digits"), F.lower(before).alias("before"), F.lower(after).alias("after"), prefix.alias("prefix"))

    def found(parts: Column) -> Column:
        kept = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: counts(parts, k))
        ends = F.transform(parts, lambda p: F.right(p, F.lit(reach)))
        # up to seven digits come before the window
        begins = F.transform(parts, lambda p: F.left(p, F.lit(reach + 7)))
        sizes = F.transform(parts, lambda p: F.length(p) + 1)

        def placed(sizes: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int"))
            sums = F.transform(blocks, lambda b: total(sizes, b * block + 1, F.lit(block)))
            return let(sums, lambda sums: let(ends, lambda e: let(begins, lambda b: F.transform(kept, lambda k: one(parts, e, b, sizes, sums, k)))))

        return F.when(F.size(parts) > 1, let(sizes, placed))

    return let(F.split(text, "#"), found)


def issue_links(df: DataFrame, text: Column, owner: Column, repo: Column, origin: Column, cross_repo: bool = False) -> DataFrame:
    """One row per ``#number`` in a text: the row's columns, position, number, link_type, strength, ref_owner, ref_repo, origin, cross_repo.

    A number has one to seven digits. It counts if no letter, digit, ``/`` or ``-`` stands before ``#``; with ``cross_repo`` an ``owner/repo`` may. What kind of
    link it is depends on the words within ``REFERENCE_WINDOW`` bytes before ``#`` and after the number.
    """
    found = df.withColumn("_r", F.explode(references(text, cross_repo)))
    r = F.col("_r")
    link, strength = F.lit("mentions"), F.lit(1)
    for name, weight, words in reversed(REFERENCE_CLASSES):
        has = r["before"].rlike(words) | r["after"].rlike(words)
        link, strength = F.when(has, name).otherwise(link), F.when(has, weight).otherwise(strength)
    prefix = F.regexp_replace(r["prefix"], r"^[(\[{:,;]+|[(\[{:,;]+\z", "")
    pair = F.regexp_extract(prefix, r"(?s)^(.+)/([^/]+)\z", 1), F.regexp_extract(prefix, r"(?s)^(.+)/([^/]+)\z", 2)
    usable = ~prefix.contains("://")
    ref_owner = F.when(usable & (pair[0] != ""), pair[0]).otherwise(owner)
    ref_repo = F.when(usable & (pair[0] != ""), pair[1]).when(usable & prefix.rlike(r"^[A-Za-z0-9_-]+\z"), prefix).otherwise(repo)
    made = {
        "position": r["position"], "number": r["digits"].cast("long"), "link_type": link, "strength": strength, "ref_owner": ref_owner, "ref_repo": ref_repo,
        "origin": origin,
    }
    out = found.withColumns(made)
    same = (F.lower("ref_owner") == F.lower(owner)) & (F.lower("ref_repo") == F.lower(repo))
    return out.withColumn("cross_repo", ~same).drop("_r")


def first_comments(comments: DataFrame, group: list[str], representatives: int = 16) -> DataFrame:
    """The comments of each thread that are looked at at all: the first four times ``representatives``, by time and id."""
    order = Window.partitionBy(*group).orderBy("created_at", "id")
    return comments.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= 4 * representatives).drop("_n")


def strongest_links(links: DataFrame, group: list[str], origin_order: list[str], most: int = MOST_REFERENCES) -> DataFrame:
    """One link per (group, owner, repo, number), the strongest, the first on ties; the ``most`` strongest of a group."""
    place = reduce(lambda acc, x: acc.when(F.col("origin") == x[1], x[0]), enumerate(origin_order), F.when(F.lit(False), 0)).otherwise(len(origin_order))
    order = [F.desc("strength"), place, F.col("position")]
    own = Window.partitionBy(*group, "ref_owner", "ref_repo", "number").orderBy(*order)
    first = links.withColumn("_n", F.row_number().over(own)).filter("_n = 1")
    top = Window.partitionBy(*group).orderBy(*order, "ref_owner", "ref_repo", "number")
    return first.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= most).drop("_n")


def section(head: str, text: Column) -> Column:
    """A section of a composed document, null if there is no text."""
    return F.when(strip(text) != "", F.concat(F.lit(f"{head}\n"), text))


def issue_document(full_name: Column, c=F.col) -> Column:
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Issue #"), c("number").cast("string"), F.lit(" in "), full_name),
        F.concat(F.lit("State: "), c("state")),
        F.concat(F.lit("Author: "), c("author_login")),
        section("Title:", c("title")),
        section("Body:", c("body")),
        section("Representative Comments:", c("representative_digest_text")),
    )


def pull_request_document(full_name: Column, c=F.col) -> Column:
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Pull Request #"), c("number").cast("string"), F.lit(" in "), full_name),
        F.concat(F.lit("State: "), c("state"), F.when(F.coalesce(c("draft"), F.lit(False)), " (draft)").otherwise("")),
        F.concat(F.lit("Author: "), c("author_login")),
        section("Title:", c("title")),
        section("Body:", c("body")),
        section("Representative Comments:", c("representative_digest_text")),
        *[F.concat(F.lit(f"{head}: "), c(col).cast("string")) for head, col in (
            ("Additions", "additions"), ("Deletions", "deletions"), ("Changed Files", "changed_files"),
        )],
    )


def is_bot(account_type: Column, login: Column) -> Column:
    return F.coalesce(account_type == "Bot", F.lit(False)) | F.coalesce(F.lower(login).endswith("[bot]"), F.lit(False))


def optional_number(text: Column) -> Column:
    """A number, or null for null, blank and ``null``; anything else fails."""
    t = strip(text)
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "null"), None).otherwise(t.cast("double"))


def first_text(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in columns])
