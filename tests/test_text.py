"""Text analytics against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import text


@pytest.mark.parametrize("n", [0, 1, 119, 120, 121, 240, 241])
def test_chunks(spark, n):
    body = "\n".join(f"l{i}" for i in range(n))
    got = sorted(text.line_chunks(spark.createDataFrame([(body,)], "text string")).collect(), key=lambda r: r["chunk_order"])
    assert len(got) == -(-n // 120)
    assert "\n".join(r["chunk_text"] for r in got) == body
    assert [(r["start_line"], r["end_line"]) for r in got] == [(k + 1, min(k + 120, n)) for k in range(0, n, 120)]


def test_line_ends(spark):
    rows = spark.createDataFrame([("a\r\nb",), ("a\nb\n",), ("\n",), ("a\n\n",)], "t string").select(text.lines_of(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [["a", "b"], ["a", "b"], [""], ["a", ""]]


COMMENT = "g int, id long, body_text string, author_association string, created_at int, reactions struct<plus_one:int,heart:int,hooray:int,eyes:int,rocket:int,confused:int>, is_bot boolean, kind string"


def comment(i, body="some words", assoc="NONE", at=None, plus=0, confused=0, bot=False, kind="issue"):
    return (1, i, body, assoc, i if at is None else at, (plus, 0, 0, 0, 0, confused), bot, kind)


def twin_scores(rows):
    """id -> score by the book."""
    kept = sorted((r for r in rows if not r[6] and r[2].strip() and r[1] != 0), key=lambda r: (r[4], r[1]))
    seen, out = set(), {}
    weights = {"OWNER": 1, "MEMBER": 0.9, "COLLABORATOR": 0.8, "CONTRIBUTOR": 0.7, "NONE": 0.5, "": 0.5}
    for i, r in enumerate(kept):
        lines = [x.strip() for x in r[2].split("\n")]
        norm = " ".join(" ".join(x for x in lines if not x.startswith(">")).split()).lower()
        if not norm or norm in seen:
            continue
        seen.add(norm)
        plus, confused = r[5][0], r[5][5]
        reaction = max(-1, min(1, math.log1p(plus) / math.log(21) - 0.5 * math.log1p(confused) / math.log(6)))
        size = len(norm.encode())
        quality = size / 80 if size <= 80 else 1200 / size if size >= 1200 else 1
        place = (0.6 if i == 0 else 0.3) + (0.3 if any(w in r[2].lower() for w in text.RESOLUTION_WORDS.split("|")) else 0)
        recency = 1 if len(kept) == 1 else i / (len(kept) - 1)
        out[r[1]] = 0.45 * reaction + 0.2 * weights.get((r[3] or "NONE").upper(), 0.6) + 0.15 * place + 0.1 * recency + 0.1 * quality
    return out


def test_comment_scores(spark):
    rows = [
        comment(1, "> quoted\nFixed in  MAIN", "owner", plus=20), comment(2, "x" * 1300, "weird", confused=9), comment(3, "fixed in main"),
        comment(4, bot=True), comment(0), comment(5, "  "), comment(6, "> only quotes"), comment(7, "é" * 50),
    ]
    got = text.score_comments(spark.createDataFrame(rows, COMMENT), ["g"]).collect()
    want = twin_scores(rows)
    assert {r["id"] for r in got} == set(want) == {1, 2, 7}
    for r in got:
        assert r["score"] == pytest.approx(want[r["id"]], abs=1e-9)


def selected(spark, rows, hint=8):
    s = text.select_comments(text.score_comments(spark.createDataFrame(rows, COMMENT), ["g"]), ["g"], hint)
    return [r["id"] for r in sorted(s.collect(), key=lambda r: r["place"])], s


def test_comment_selection(spark):
    assert selected(spark, [comment(4, bot=True)])[0] == []
    low = [comment(i, f"w{i}") for i in range(1, 8)]
    assert len(selected(spark, low, 4)[0]) == 4  # fewer than three are above the threshold: the best, whatever they score
    high = [comment(i, f"fixed by change {i} " * 6, "OWNER", plus=20) for i in range(1, 6)]
    review = comment(9, "nit", kind="review", at=0)
    ids, _ = selected(spark, [*high, review], 8)
    assert ids[-1] == 9 and len(ids) == 6
    assert 9 not in selected(spark, [*high, review], 3)[0]  # it joins and falls out again
    tied = [comment(i, f"same size {i}", "OWNER", plus=20, at=i) for i in (3, 2)]
    assert len(selected(spark, tied)[0]) == 2


def test_digest(spark):
    rows = [comment(i, f"fixed {i} " + "y" * 2500, "OWNER", plus=20) for i in (1, 2, 3)]
    row = text.comment_digest(selected(spark, rows)[1], ["g"]).first()
    assert len(row["comment_ids"]) == 3 and row["digest"].endswith("…") and len(row["digest"].encode()) == 4000 + len("…".encode())


LINKS = [
    (
        "Fixes #12 and #3", [(12, "closes"), (3, "closes")],
    ), ("see #7", [(7, "references")]), ("a#1 x/y#2 z-#3", []), ("(#1) duplicate", [(1, "duplicate")]), ("#12345678", []), ("ends with #", []), ("plain #5.", [(5, "mentions")]),
    ("##4", [(4, "mentions")]), ("#1#2", [(1, "mentions")]), ("fixes" + " " * 60 + "#9", [(9, "mentions")]),
]


@pytest.mark.parametrize(("body", "want"), LINKS)
def test_links(spark, body, want):
    df = spark.createDataFrame([(body,)], "t string")
    got = text.issue_links(df, F.col("t"), F.lit("o"), F.lit("r"), F.lit("body")).orderBy("position").collect()
    assert [(r["number"], r["link_type"]) for r in got] == want
    assert all(not r["cross_repo"] for r in got)


def test_cross_repository_links(spark):
    df = spark.createDataFrame([("closes ab/cd#5",)], "t string")
    assert text.issue_links(df, F.col("t"), F.lit("o"), F.lit("r"), F.lit("body")).count() == 0
    row = text.issue_links(df, F.col("t"), F.lit("o"), F.lit("r"), F.lit("body"), cross_repo=True).first()
    assert (row["ref_owner"], row["ref_repo"], row["cross_repo"]) == ("ab", "cd", True)


def test_strongest_link_stays(spark):
    df = spark.createDataFrame([("#5 is long away from anything that could tell more about it. Now fixes #5",)], "t string").withColumn("g", F.lit(1))
    links = text.issue_links(df, F.col("t"), F.lit("o"), F.lit("r"), F.lit("body"))
    assert [(r["number"], r["strength"]) for r in text.strongest_links(links, ["g"], ["body"]).collect()] == [(5, 3)]
    assert text.strongest_links(links, ["g"], ["body"], most=0).count() == 0


def test_documents(spark):
    row = spark.createDataFrame(
        [(3, "open", None, " ", "text", None, True, 5, None, 2)],
        "number int, state string, author_login string, title string, body string, representative_digest_text string, draft boolean, additions int, deletions int, changed_files int",
    )
    assert row.select(text.pull_request_document(F.lit("a/b")).alias("d")).first()["d"] == "Pull Request #3 in a/b\n\nState: open (draft)\n\nBody:\ntext\n\nAdditions: 5\n\nChanged Files: 2"
    assert row.select(text.issue_document(F.lit("a/b")).alias("d")).first()["d"] == "Issue #3 in a/b\n\nState: open\n\nBody:\ntext"


def test_small_functions(spark):
    df = spark.createDataFrame([("Bot", "x"), ("User", "ci[bot]"), (None, None)], "t string, l string")
    assert [r[0] for r in df.select(text.is_bot(F.col("t"), F.col("l"))).collect()] == [True, True, False]
    n = spark.createDataFrame([("1.5",), ("",), ("null",), (None,)], "t string")
    assert [r[0] for r in n.select(text.optional_number(F.col("t"))).collect()] == [1.5, None, None, None]
    with pytest.raises(Exception):
        spark.createDataFrame([("x",)], "t string").select(text.optional_number(F.col("t"))).collect()
