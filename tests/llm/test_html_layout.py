"""HTML rendering against naive layouts: tables by a grid of slots, flow by plain recursion."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.llm.html_text import html_to_text

CELL = st.tuples(st.sampled_from([0, 3, 70, 140]), st.sampled_from([1, 1, 1, 2, 3]), st.sampled_from([1, 1, 1, 2, 3, 0]))


def naive_columns(rows):
    """First column of every cell, by marking slots one by one."""
    taken, out = set(), {}
    for y, row in enumerate(rows):
        x = 0
        for k, (_, across, down) in enumerate(row):
            while (x, y) in taken:
                x += 1
            out[y, k] = x
            taken |= {(i, j) for i in range(x, x + across) for j in range(y + 1, len(rows) if down == 0 else y + down)}
            x += across
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CELL, min_size=1, max_size=5), min_size=1, max_size=6))
def test_cells_of_a_column_begin_at_one_place(rows):
    name = lambda y, k: f"<{y}.{k}>"
    body = "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{name(y, k).replace('<', '&lt;')}{'x' * n}" for k, (
        n, a, d,
    ) in enumerate(row)) for y, row in enumerate(rows))
    lines = html_to_text(f"<table>{body}</table>").split("\n")
    columns, begins = naive_columns(rows), {}
    for (y, k), x in columns.items():
        at = [line.index(name(y, k)) for line in lines if name(y, k) in line]
        assert len(at) == 1
        begins.setdefault(x, set()).add(at[0])
    assert all(len(v) == 1 for v in begins.values())
    order = sorted((x, *v) for x, v in begins.items())
    assert order == sorted(order, key=lambda b: b[1])
    for y, row in enumerate(rows):
        held = [line for line in lines if name(y, 0) in line][0]
        assert [k for k in range(len(row)) if name(y, k) in held] == list(range(len(row)))


def test_wide_and_spanned_cells_stay_aligned():
    out = html_to_text("<table><tr><td>" + "a" * 70 + "<td>one<tr><td>b<td>two</table>").split("\n")
    assert [x.index(w) for x, w in zip(out, ("one", "two"), strict=True)] == [72, 72]
    out = html_to_text("<table><tr><td rowspan=2>left<td>up<tr><td>down</table>").split("\n")
    assert out == ["left  up", "      down"]


def test_padding_is_bounded_and_loses_no_word():
    words = " ".join(f"word{k}" for k in range(4000))
    rows = "".join(f"<tr><td>c{k}<td>d{k}" for k in range(2000))
    out = html_to_text(f"<table><tr><td>{words}<td>x{rows}</table>")
    assert len(out) < 400_000 and sorted(out.split()) == sorted([*words.split(), "x", *(f"{c}{k}" for k in range(2000) for c in "cd")])
    assert len({line.index(f"d{k}") for k in range(2000) for line in [next(x for x in out.split("\n") if f"c{k} " in x)]}) == 1


def test_tables_in_tables_without_end():
    assert html_to_text("<table><tr><td>a<td>" * 3000 + "inner" + "</table>" * 3000).split() == ["a"] * 3000 + ["inner"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<style>@media print{.n{display:none}}</style><b class=n>x</b>", "x"), ("<style>@media screen{.n{display:none}}</style><b class=n>x</b>y", "y"),
        ("<style>@media print{@supports (a:b){.n{display:none}} .m{display:none}} .k{display:none}</style><b class=n>x</b><b class=m>y</b><b class=k>z</b>", "xy"),
        ("<style>.n{display:none} .n{display:block}</style><b class=n>x</b>", "x"), ("<style>.n{display:none}</style><b class=n style='display:inline'>x</b>", "x"),
        ("<style>@import 'a'; .n{display:none}</style><b class=n>x</b>y", "y"), ("<style>@font-face{display:none} b{color:red}</style><b>x</b>", "x"),
        ("<svg><title>t</title><text>shown</text></svg> <math><mi>m</mi></math> <map>q</map>", "shown m q"), ("<b style='flex-display:none'>x</b>", "x"),
    ],
)
def test_styles(html, want):
    assert html_to_text(html) == want


TREE = st.recursive(st.sampled_from(["a", " b ", "c  c", ""]), lambda kids: st.tuples(
    st.sampled_from(["div", "p", "span", "b", "section", "h1"]), st.lists(kids, max_size=4),
), max_leaves=14)
GAPS = {"div": 0, "section": 0, "p": 1, "h1": 1}


def markup(t):
    return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(markup, t[1]))}</{t[0]}>"


def naive_flow(tree):
    """Events of a recursive walk, then lines: text runs between block edges, blank lines where an edge asks for one."""
    events = []

    def walk(t):
        if isinstance(t, str):
            events.append(t)
        else:
            edge = [GAPS[t[0]]] if t[0] in GAPS else []
            events.extend(edge)
            for c in t[1]:
                walk(c)
            events.extend(edge)

    walk(tree)
    lines, now, gap = [], "", 0
    for e in [*events, 0]:
        if isinstance(e, str):
            now += e
        else:
            if now.strip():
                lines += [""] * (gap if lines else 0) + [" ".join(now.split())]
                gap = 0
            now, gap = "", max(gap, e)
    return "\n".join(lines)


def no_block_in_p(t, inside=False):
    """Browsers end a paragraph where a block begins; such trees are another shape than their markup."""
    if isinstance(t, str):
        return True
    return not (inside and t[0] in GAPS) and all(no_block_in_p(c, inside or t[0] == "p") for c in t[1])


@settings(max_examples=200, deadline=None)
@given(TREE.filter(no_block_in_p))
def test_flow_is_that_of_a_plain_walk(tree):
    assert html_to_text(markup(tree)) == naive_flow(tree)
