import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import asof, clones, graph, review

pairs = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=14)
few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def reachable(edges, start, stop=()):
    dist, queue = {start: 0}, [start]
    for node in queue:
        if node in stop and node != start:
            continue
        for a, b in edges:
            if a == node and b not in dist:
                dist[b] = dist[node] + 1
                queue.append(b)
    return dist


@few
@given(edges=pairs)
def test_components(spark, edges):
    nodes = spark.createDataFrame([(k,) for k in range(10)], "node bigint")
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    both = edges + [(b, a) for a, b in edges]
    assert {r.node: r.component for r in graph.components(nodes, links).collect()} == {k: min(reachable(both, k)) for k in range(10)}


@few
@given(edges=pairs, stop=st.sets(st.integers(0, 9), max_size=3))
def test_bfs(spark, edges, stop):
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(edges)], "src bigint, dst bigint, pos int")
    sources = spark.createDataFrame([(0,), (3,)], "node bigint")
    blocked = spark.createDataFrame([(k,) for k in stop], "node bigint")
    got = {(r.source, r.node): r for r in graph.bfs(df, sources, blocked).collect()}
    want = {(s, n): d for s in (0, 3) for n, d in reachable(edges, s, stop).items() if n != s}
    assert {k: r.dist for k, r in got.items()} == want
    assert all(r.path[0] == s and r.path[-1] == n and len(r.path) == r.dist + 1 for (s, n), r in got.items())


def test_splice_follows_document_order(spark):
    pieces = spark.createDataFrame([("m", "a", 2), ("m", "b", 1), ("a", "c", 1), ("c", "m", 1), ("b", "c", 5)], "src string, dst string, pos int")
    got = graph.splice(pieces, spark.createDataFrame([("m",)], "node string")).orderBy("place").collect()
    assert [r.node for r in got] == ["m", "b", "c", "a", "c"]


def test_splice_goes_to_the_end(spark):
    pieces = spark.createDataFrame([(k, k + 1, 0) for k in range(70)], "src int, dst int, pos int")
    assert graph.splice(pieces, spark.createDataFrame([(0,)], "node int")).count() == 71


def test_anchors_that_hold_each_other_pool(spark):
    rng = random.Random(1)
    texts = ["the cone is bounded", "cone is", "Cone  IS bounded here", "x", "xy", "other text", "the cone is bounded near", ""]
    rows = [(k, rng.choice("fg"), "T", "structure", rng.choice(texts), rng.choice([[], [], ["r1"], ["r1", "r2"], ["r3"]]), 1, k % 3, []) for k in range(60)]
    df = spark.createDataFrame(rows, "flag_id bigint, file string, tag string, layer string, anchor string, refs array<string>, severity int, review_id int, elsewhere array<string>")
    norm = {r[0]: " ".join(r[4].lower().split()) for r in rows}
    edges = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0] and (set(a[5]) & set(b[5]) or (not a[5] and not b[5] and (norm[a[0]] in norm[b[0]] or norm[b[0]] in norm[a[0]])))]
    want = {r[0]: min(reachable(edges, r[0])) for r in rows}
    assert {r.flag_id: r.pool for r in review.pooled(df).collect()} == want
    assert review.defects(df).count() == len(set(want.values()))
    assert review.threads(review.defects(df)).count() >= 0


def test_asof_and_ranges(spark):
    left = spark.createDataFrame([("u", 5, "l1"), ("u", 1, "l2"), ("v", 9, "l3")], "k string, t int, name string")
    right = spark.createDataFrame([("u", 5, "a"), ("u", 2, "b"), ("w", 1, "c")], "k string, t int, v string")
    assert {r.name: r.v for r in asof.last_before(left, right, ["k"], "t", "v", "v").collect()} == {"l1": "a", "l2": None, "l3": None}
    runs = spark.createDataFrame([("u", k, k not in (3, 8)) for k in range(12)], "k string, t int, on boolean")
    assert sorted((r.start, r.length) for r in asof.islands(runs, ["k"], ["t"], F.col("on"), 3).collect()) == [(1, 3), (5, 4), (10, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_equals_greedy_passes(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice("abc"), rng.choice("xy"), rng.choice("pq"), rng.choice("mn"), k, 3) for k in range(40)] + [(99, None, "x", None, "m", 99, 3)]
    df = spark.createDataFrame(rows, "decl_id bigint, member string, anchor string, whole string, name string, place int, src_lines int")
    want = set()
    for left, right in (("a", "b"), ("a", "c"), ("b", "c")):
        for anchor in "xy":
            a, b = ([r for r in rows if r[1] == m and r[2] == anchor] for m in (left, right))
            for same in (lambda p, q: p[3] == q[3] and p[4] == q[4], lambda p, q: p[3] == q[3], lambda p, q: p[4] == q[4], lambda p, q: True):
                for p in list(a):
                    q = next((q for q in b if same(p, q)), None)
                    if q:
                        a.remove(p)
                        b.remove(q)
                        want.add((p[0], q[0]))
    assert {(r.left_id, r.right_id) for r in clones.matches(df).collect()} == want
