import itertools
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import neardup

LIKE = neardup.Threshold(7, 10)


def brute(rows, over=7, under=10):
    words = [(k, Counter(w for w in t.split(" ") if w)) for k, t in rows if k is not None and t is not None]
    out = set()
    for (i, a), (j, b) in itertools.combinations(words, 2):
        common, size = sum((a & b).values()), sum(a.values()) + sum(b.values())
        if common and i != j and common * under >= over * (size - common):
            out.add((min(i, j), max(i, j)))
    return out


def found(spark, rows, like=LIKE):
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = [tuple(r) for r in neardup.all_pairs(neardup.similar(df, like)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def edited(rng, words, fresh):
    words = list(words)
    for _ in range(rng.randint(0, 12)):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = fresh()
        elif kind == 1:
            words.insert(at, fresh())
        elif len(words) > 3:
            words.pop(at)
    if rng.random() < 0.3:
        cut = rng.randrange(len(words))
        words = words[cut:] + words[:cut]
    return words


def family_rows(rng, n, lengths, frequent=30, vocabulary=4000):
    fresh = lambda: rng.choice("()[]:,") if rng.random() < 0.5 else f"w{rng.randrange(vocabulary)}" if rng.random() < 0.9 else f"c{rng.randrange(frequent)}"
    rows = []
    while len(rows) < n:
        base = [fresh() for _ in range(rng.randint(*lengths))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows), " ".join(edited(rng, base, fresh))))
    return rows


@pytest.mark.parametrize("seed,lengths", [(1, (40, 90)), (2, (3, 20))])
def test_equals_brute_force(spark, seed, lengths):
    rows = family_rows(random.Random(seed), 400, lengths)
    want = brute(rows)
    assert len(want) > 30
    assert found(spark, rows) == want


def test_records_of_common_words_only(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 25)))) for k in range(250)]
    want = brute(rows)
    assert len(want) > 50
    assert found(spark, rows) == want


def test_copies_nulls_blanks_and_empty(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (3, "h g f e d c b a"), (9, text), (4, None), (None, text), (6, ""), (7, "  "), (8, "a  b c d e f g h i"), (1, "z"), (2, "z")]
    assert found(spark, rows) == brute(rows) == {(3, 5), (3, 9), (5, 9), (3, 8), (5, 8), (8, 9), (1, 2)}
    df = spark.createDataFrame(rows, "id bigint, text string")
    result = neardup.similar(df, LIKE)
    assert {r.id: r.class_id for r in result.classes.collect()} == {5: 3, 3: 3, 9: 3, 8: 8, 1: 1, 2: 1}
    assert result.links.count() == 1
    assert sorted(tuple(r) for r in neardup.groups(result).collect()) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 3, 3), (5, 3, 3, 3), (8, 8, 3, 3), (9, 3, 3, 3)]
    assert found(spark, [(1, None)]) == set()


def test_needed_and_choice():
    for size in range(1, 200):
        most = max(size - c for c in range(size + 1) for b in (size,) if LIKE.alike(c, size, b))
        assert LIKE.needed(np.array([size]))[0] == most + 1
    rng = random.Random(6)
    for _ in range(300):
        sizes = np.array([[rng.randint(0, 4) for _ in range(3)]])
        pairs, singles = (np.array([[float(rng.randint(0, 9)) for _ in range(3)]]) for _ in range(2))
        need = np.array([rng.randint(0, 12)])
        gains = [[0, max(s - 1, 0), s] for s in sizes[0]]
        price = lambda mask: sum((0, pairs[0][p], singles[0][p])[o] for p, o in enumerate(mask))  # noqa: B023, E731
        options = [price(mask) for mask in itertools.product(range(3), repeat=3) if sum(gains[p][o] for p, o in enumerate(mask)) >= need[0]]
        option, missing = neardup.choose(sizes, pairs, singles, need)
        reached = sum(gains[p][o] for p, o in enumerate(option[0]))
        assert reached + missing[0] >= need[0]
        if options:
            assert missing[0] == 0 and price(option[0]) == min(options)


def test_hot_keys_and_shuffled_id_sets(spark, monkeypatch):
    for name, value in (("HOT_KEY", 3), ("HOT_BIT", 5), ("BROADCAST_ROWS", 10), ("COMMON_LEAST", 400)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(9)
    rows = family_rows(rng, 200, (20, 60))
    template = [f"t{k}" for k in range(30)]
    rows += [(1000 + k, " ".join(template + [f"u{k}", f"v{rng.randrange(9)}"])) for k in range(60)]  # one key in a fifth of the records
    rows += [(2000 + k, " ".join(template)) for k in range(25)]  # copies
    assert found(spark, rows) == brute(rows)


def test_long_records(spark):
    rows = family_rows(random.Random(11), 60, (100, 1500), vocabulary=30_000)
    want = brute(rows)
    sizes = [len(t.split(" ")) for _, t in rows]
    assert len(want) > 10 and max(sizes) > 1024
    # pairs of records on both sides of a class border
    level = neardup.Indexer.levels(np.array(sizes))
    assert any(level[a] != level[b] for a, b in want)
    assert found(spark, rows) == want


def test_postings_are_linear_in_words():
    made = {}
    for n in (2000, 8000, 20_000):
        words = np.sort(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, n))
        batch = neardup.pa.record_batch([neardup.pa.array([1]), neardup.pa.array([words])], names=["id", "words"])
        sketch = np.full(1 << neardup.SKETCH_BITS, 5)
        made[n] = neardup.Indexer(sketch, 1_000_000, LIKE).postings(batch).num_rows
    assert all(made[n] < 26 * n for n in made)
