import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import packing


def least(sizes, capacity):
    """Least number of containers by trying every assignment."""
    best = len(sizes)

    def go(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[at]:
                go(at + 1, rooms[:k] + [rooms[k] - sizes[at]] + rooms[k + 1 :])
        go(at + 1, rooms + [capacity - sizes[at]])

    go(0, [])
    return best


def test_bound_and_packing_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 7))), reverse=True)
        place, room = packing.best_fit_decreasing(np.array(sizes), 20)
        used = np.bincount(place, weights=sizes)
        assert (used + room == 20).all() and (room >= 0).all()
        assert packing.lower_bound(np.array(sizes), 20) <= least(sizes, 20) <= len(room)
    assert packing.lower_bound(np.array([11] * 5), 20) == 5
    assert packing.lower_bound(np.array([], dtype=int), 20) == 0


def check(rows, out, capacity):
    got = out.collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r.doc_id, r.container_id is None), []).append((r.begin_token, r.n_tokens))
        assert (r.container_id is None) == (r.n_tokens == 0)
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    used = {}
    for r in got:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert all(0 < u <= capacity for u in used.values())
    return got, used


def test_pieces_nulls_repeats_and_empty(spark):
    rows = [(1, 25), (2, 10), (3, 10), (4, None), (5, 0), (6, 3), (6, 3), (7, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").withColumn("container_id", F.lit("clash"))
    got, used = check(rows, packing.pack(df, capacity=10), 10)
    assert sorted((r.piece_no, r.begin_token, r.n_tokens) for r in got if r.doc_id == 1) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert len(used) == 7
    assert packing.pack(df.limit(0), capacity=10).count() == 0


def test_units_exchange_loose_documents(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([26, 30, 34, 45, 55])) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    out = packing.pack(df, capacity=100, unit_items=250)
    _, used = check(rows, out, 100)
    assert len({c.split("-")[0] for c in used}) > 1
    alone = packing.best_fit_decreasing(np.array([n for _, n in rows]), 100)[1]
    assert len(used) <= 1.02 * len(alone)
    line = packing.summary(out, 100).first()
    assert line.n_containers == len(used) and line.fullest <= 100
    assert sorted(itertools.chain(r.doc_id for r in out.collect())) == list(range(2000))
