import random
import re
import time

import pytest
from pyspark.sql import functions as F

from arborform.operators.listrank import list_rank
from arborform.operators.markup import Scanner, markup_walk
from arborform.operators.trees import MARKUP_PATTERN, NEST_TAGS, RAW_PATTERN, TAG_NAME_PATTERN, \
    layout_leaves, leaf_arrays, markup_faults, markup_leaves, \
    node_leaves, node_order, node_paths, unreached_nodes


def _leaves(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.token, r.depth, r.sib) for r in
            layout_leaves(df, "doc_id", "text").orderBy("leaf_pos").collect()]


def test_layout_simple_line(spark):
    assert _leaves(spark, "x = 1") == [("x", 2, 0), ("=", 2, 1), ("1", 2, 2)]


def test_layout_blank_line_is_leaf_and_lines_are_siblings(spark):
    assert _leaves(spark, "a\n\nb c") == [("a", 2, 0), ("", 1, 1), ("b", 2, 0), ("c", 2, 1)]


def test_layout_empty_text_is_root_leaf(spark):
    assert _leaves(spark, "") == [("", 0, 0)]


def test_layout_null_text_is_an_empty_text(spark):
    assert _leaves(spark, None) == [("", 0, 0)]


def test_leaf_arrays_in_visit_order(spark):
    df = spark.createDataFrame([(1, "f(g(x))\ny")], "doc_id long, text string")
    r = leaf_arrays(layout_leaves(df, "doc_id", "text"), "doc_id").first()
    assert r.tokens == ["f", "(", "g", "(", "x", ")", ")", "y"]
    assert r.tree_mask == [1] * 8 and r.depths == [2] * 8
    assert r.sibs == [0, 1, 2, 3, 4, 5, 6, 0]


HTML = ("<html><head><title>T</title><script>var s='</div>';</script></head>"
        "<body><div><p>one <b>two</b></div><div></div><ul><li>a</li><li>b</li></ul>"
        "<!-- <div>x</div> --></body></html>")


def test_markup_leaves_depth_and_sibling(spark):
    df = spark.createDataFrame([(7, HTML)], "page_id long, html string")
    got = [(r.token, r.depth, r.sib) for r in
           markup_leaves(df, "page_id", "html").orderBy("leaf_pos").collect()]
    assert got == [
        ("T", 3, 0),                                   # html > head > title > text
        ("<script>var s='</div>';</script>", 2, 1),    # raw block, 2nd child of head
        ("one ", 3, 0), ("two", 3, 1),                 # p and b are transparent
        ("<div>", 2, 1),                               # empty element is a leaf
        ("a", 4, 0), ("b", 4, 0),                      # each li has one child
    ]
    assert markup_faults(df, "page_id", "html").count() == 0


def _markup(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r.token, r.depth, r.sib) for r in markup_leaves(df, "page_id", "html").orderBy("leaf_pos").collect()]
    return got, [(r.stray, r.unclosed) for r in markup_faults(df, "page_id", "html").collect()]


@pytest.mark.parametrize("html, leaves, faults", [
    ("<div>", [("<div>", 0, 0)], [(0, 1)]),                             # childless last node
    ("<html><body>", [("<body>", 1, 0)], [(0, 2)]),
    ("<ul><li>a</li><li>", [("a", 2, 0), ("<li>", 1, 1)], [(0, 2)]),
    ("", [("", 0, 0)], []), ("<!-- c -->", [("<!-- c -->", 0, 0)], []),  # no nodes
    (None, [("", 0, 0)], []),
    ("</div>a", [("a", 0, 0)], [(1, 0)]),                               # never below depth 0
    ("<div><ul><li>a<li>b</ul>c</div>d", [("a", 3, 0), ("b", 4, 0), ("c", 1, 1), ("d", 0, 1)], []),
    ("<div title='a > b'>x</div>y", [("x", 1, 0), ("y", 0, 1)], []),    # quoted '>'
    ('<a href="x>y"/>z', [('<a href="x>y"/>', 0, 0), ("z", 0, 1)], []),
    ("<div 'unbalanced>x</div>", [("x", 1, 0)], []),
])
def test_markup_edges(spark, html, leaves, faults):
    assert _markup(spark, html) == (leaves, faults)


def _reference_leaves(html):
    """Independent walk: builds the node tree first, then lists its leaves."""
    toks = re.findall(MARKUP_PATTERN, html)
    root = {"kids": [], "name": None, "tok": html, "up": None}
    cur = root
    for t in toks:
        m = None if re.match(RAW_PATTERN, t) else re.match(TAG_NAME_PATTERN, t)
        name = m.group(1).lower() if m else None
        if t.startswith("<!") or (name and name not in NEST_TAGS) or (not name and not t.strip()):
            continue
        node = {"kids": [], "name": name, "tok": t, "up": cur}
        if name and t.startswith("</"):
            x = cur
            while x is not root and x["name"] != name:
                x = x["up"]
            cur = x["up"] if x is not root else cur
        else:
            cur["kids"].append(node)
            if name and not t.endswith("/>"):
                cur = node
    out = []

    def visit(n, depth, sib):
        if not n["kids"]:
            out.append((n["tok"], max(depth, 0), sib))
        for i, k in enumerate(n["kids"]):
            visit(k, depth + 1, i)
    visit(root, -1, 0)
    return out


def test_markup_equals_an_independent_tree(spark):
    rnd = random.Random(8)
    parts = ["<div>", "</div>", "<ul>", "<li>", "</li>", "</ul>", "<p>", "text", " ", "<a href='>'>", "</a>", "<!-- x -->", "<a/>"]
    pages = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 40)))) for i in range(150)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {}
    for r in markup_leaves(df, "page_id", "html").orderBy("page_id", "leaf_pos").collect():
        got.setdefault(r.page_id, []).append((r.token, r.depth, r.sib))
    for i, html in pages:
        assert got[i] == _reference_leaves(html), html


def test_node_leaves_depth_sibling_and_orphans(spark):
    nodes = spark.createDataFrame([
        (1, None, 0, "root"), (2, 1, 5, "a"), (3, 1, 7, "b"), (4, 2, 0, "a0"),
        (5, 99, 0, "orphan"), (6, None, 1, "lone")],
        "node_id long, parent_id long, ord long, text string")
    got = {r.node_id: (r.root_id, r.leaf_pos, r.depth, r.sib, r.text) for r in node_leaves(nodes).collect()}
    # b is the 2nd child of root even though a is not a leaf; a childless root is a leaf
    assert got == {4: (1, 0, 2, 0, "a0"), 3: (1, 1, 1, 1, "b"), 6: (6, 0, 0, 0, "lone")}
    assert [r.node_id for r in unreached_nodes(nodes).collect()] == [5]
    assert {r.node_id: list(r.path) for r in node_paths(nodes).collect()} == {1: [0], 2: [0, 5], 3: [0, 7], 4: [0, 5, 0], 6: [1]}


def _walked(nodes):
    """Pre-order, depth, sibling and leaf place by a plain walk."""
    kids = {}
    for n, up, o, _ in sorted(nodes, key=lambda r: (r[2], r[0])):
        kids.setdefault(up, []).append(n)
    out = {}
    for root in kids.get(None, []):
        stack, pre, leaf = [(root, 0, 0)], 0, 0
        while stack:
            n, depth, sib = stack.pop()
            own = kids.get(n, [])
            out[n] = (root, pre, depth, sib, None if own else leaf)
            pre, leaf = pre + 1, leaf + (not own)
            stack += [(k, depth + 1, i) for i, k in reversed(list(enumerate(own)))]
    return out


@pytest.mark.parametrize("base", [0, 25, 1 << 18])
def test_node_order_equals_a_walk(spark, base):
    """Random forests with orphans, a cycle and a hot parent, at every size of the base."""
    rnd = random.Random(base)
    rows = [(1, None, 0, "r"), (2, None, 3, "r")]
    for n in range(3, 260):
        up = 1 if rnd.random() < 0.3 else rnd.choice(rows)[0]
        rows.append((n, up, rnd.randint(0, 4), f"t{n}"))
    want = _walked(rows)
    rows += [(900, 901, 0, "c"), (901, 900, 0, "c"), (902, 901, 0, "below"), (950, 949, 1, "orphan"), (951, 950, 0, "o"), (960, 960, 0, "self")]
    df = spark.createDataFrame(rows, "node_id long, parent_id long, ord long, text string").repartition(3)
    got = {r.node_id: (r.root_id, r.pre, r.depth, r.sib, r.leaf_pos) for r in node_order(df, base).collect()}
    assert got == want


def test_a_chain_of_100000_nodes(spark):
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"),
                                  F.lit(0).cast("bigint").alias("ord"), F.lit("n").alias("text"))
    order = node_order(nodes).agg(F.count(F.lit(1)), F.sum(F.abs(F.col("depth") - F.col("node_id"))), F.sum(F.abs(F.col("pre") - F.col("node_id")))).first()
    assert tuple(order) == (n, 0, 0)
    assert [(r.node_id, r.depth) for r in node_leaves(nodes).collect()] == [(n - 1, n - 1)]


def test_empty_node_table(spark):
    assert node_leaves(spark.createDataFrame([], "node_id long, parent_id long, ord long, text string")).count() == 0


@pytest.mark.parametrize("base", [0, 7])
def test_list_rank_sums_along_the_lists(spark, base):
    rnd = random.Random(base)
    ids = list(range(300))
    rnd.shuffle(ids)
    rows, want = [], {}
    for part in (ids[:1], ids[1:60], ids[60:]):
        upto = 0
        for i, v in enumerate(part):
            w = rnd.randint(-3, 9)
            rows.append((v, part[i + 1] if i + 1 < len(part) else None, i == 0, w))
            want[v] = (part[0], upto)
            upto += w
    rows += [(1000, 1001, False, 1), (1001, 1000, False, 1), (1002, None, False, 1)]        # a cycle, a list without a head
    df = spark.createDataFrame(rows, "id long, next long, head boolean, w long")
    assert {r.id: (r.root, r.w) for r in list_rank(df, ["w"], base).collect()} == want


def test_scanner_reads_the_pattern(spark):
    rnd, pattern, raw = random.Random(4), re.compile(MARKUP_PATTERN), re.compile(RAW_PATTERN)
    parts = ["<script", "<script>", "</script>", "</SCRIPT  >", "<style a='>'>", "</style>", "<!--", "-->", "<!", "<!doctype x>", "<a ", "<div",
             "</div>", ">", "'", '"', "x", " ", "<", "</", "/>", "<b>", "<scripty>", "\u017f", "\n"]
    for _ in range(20_000):
        page = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        got = list(Scanner(page).tokens())
        assert [t for t, _ in got] == pattern.findall(page), page
        assert all((kind == "raw") == bool(raw.match(t)) for t, kind in got), page


@pytest.mark.parametrize("unit", ["<script>", "<a ", "<!--", "<!", '<a "', "<a '>\"", "<div>", "<div><p></div", "</div>", '<a "x>" ', "<ul><li>"])
def test_markup_walk_is_linear(unit):
    """Four times the page takes about four times as long (a square would take 16 times)."""
    def seconds(size):
        page = unit * (size // len(unit))
        t = time.perf_counter()
        markup_walk(page, frozenset(NEST_TAGS))
        return time.perf_counter() - t
    seconds(50_000)
    assert seconds(1_000_000) < 9 * max(min(seconds(250_000) for _ in range(2)), 0.02)


def test_only_parents_take_part_in_the_rounds(spark, monkeypatch):
    """Leaves are in no round of the path doubling, and one row each of the tour."""
    from arborform.operators import trees
    rows = [(0, None, 0), (1, 0, 1), (2, 1, 5)] + [(10 + i, 2, i) for i in range(20)] + [(40, None, 7), (50, 99, 0), (60, 61, 0), (61, 60, 0)]
    nodes = spark.createDataFrame([(*r, f"n{r[0]}") for r in rows], "node_id long, parent_id long, ord long, text string")
    sizes, kept = [], trees.written

    def noted(df, name):
        out = kept(df, name)
        sizes.append((name, out.count()))
        return out
    monkeypatch.setattr(trees, "written", noted)
    got = {r.node_id: (r.root_id, r.depth, list(r.path)) for r in trees.node_paths(nodes).collect()}
    assert got == {0: (0, 0, [0]), 1: (0, 1, [0, 1]), 2: (0, 2, [0, 1, 5]), 40: (40, 0, [7]),
                   **{10 + i: (0, 3, [0, 1, 5, i]) for i in range(20)}}
    assert [n for _, n in sizes[1:]] and max(n for _, n in sizes[1:]) <= 5
    tour = trees.euler_tour(trees.numbered_nodes(nodes.filter("node_id < 50")))
    assert tour.count() == 3 * 2 + 20 + 1
    order = {r.node_id: (r.root_id, r.pre, r.depth, r.leaf_pos) for r in trees.node_order(nodes).collect()}
    assert order == {0: (0, 0, 0, None), 1: (0, 1, 1, None), 2: (0, 2, 2, None), 40: (40, 0, 0, 0),
                     **{10 + i: (0, 3 + i, 3, i) for i in range(20)}}
