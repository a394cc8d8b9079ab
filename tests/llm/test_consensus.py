import itertools
import random

import numpy as np

from quire.llm import consensus

FORMS = [(1, "The proof treats only the bounded case."), (2, "No reason is given for studying the object."), (3, "The term is used before it is defined.")]
SCHEMA = "flag_id bigint, item_id bigint, source string, severity int, claim string, refs array<string>, ingested_at int, n_votes string"


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(FORMS, "claim_id int, claim string")


def values(result):
    return {(r.item_id, r.field_name, r.field_value) for r in result.values.collect()}


def test_matcher():
    match = consensus.Matcher(FORMS)
    assert [match(t) for t in ("THE PROOF TREATS ONLY BOUNDED CASE", "I think: the trem is used before it is defined!?", "no reason is given for stud", "xyzzy", "", None)] == [1, 3, 2, None, None, None]


def test_triplets_recover_accuracies():
    rng = np.random.default_rng(1)
    w = np.array([0.9, 0.7, 0.5, 0.0, 0.3, 0.8])
    truth = rng.integers(0, 3, 20_000)
    given = np.array([np.where(rng.random(len(truth)) < p, truth, rng.integers(0, 3, len(truth))) for p in w])
    same = np.array([[float((a == b).sum()) for b in given] for a in given])
    met = np.full((6, 6), float(len(truth)))
    np.fill_diagonal(met, 0)
    np.fill_diagonal(same, 0)
    assert np.abs(consensus.triplets(met, same, 1 / 3) - w).max() < 0.08


def test_pair_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(1, 12), f"r{rng.randint(0, 4)}", rng.choice([1, 2, 3, 9, None]), rng.choice([None, *[t for _, t in FORMS]]), rng.sample("abc", rng.randint(0, 3)), 0, "") for k in range(80)]
    flags, forms = frames(spark, rows)
    voted = consensus.votes(flags, forms)
    names = [f"r{k}" for k in range(5)]
    counts = consensus.pair_counts(voted, names)
    want = {f: [np.zeros((5, 5)), np.zeros((5, 5))] for f in consensus.FIELDS}
    items = {}
    for r in voted.collect():
        items.setdefault(r.item_id, []).append(r)
    for votes in items.values():
        offered = {x for v in votes for x in v.refs}
        for v, u in itertools.permutations(votes, 2):
            a, b = names.index(v.source), names.index(u.source)
            for f in ("severity", "claim"):
                if v[f] is not None and u[f] is not None:
                    want[f][0][a, b] += 1
                    want[f][1][a, b] += v[f] == u[f]
            want["refs"][0][a, b] += len(offered)
            want["refs"][1][a, b] += sum((x in v.refs) == (x in u.refs) for x in offered)
    for f in consensus.FIELDS:
        assert (counts[f][0] == want[f][0]).all() and (counts[f][1] == want[f][1]).all()


def test_dependable_minority_wins_and_repeats_count_once(spark):
    rng = random.Random(3)
    rows, good, n = [], {"a": 0.95, "b": 0.9, "c": 0.9, "x": 0.0, "y": 0.0, "z": 0.05}, 0
    truth = {}
    for item in range(400):
        truth[item] = (rng.randint(1, 3), rng.randint(1, 3), rng.sample(["p", "q", "r", "s"], 2))
        for who, w in good.items():
            t = truth[item]
            severity = t[0] if rng.random() < w else rng.randint(1, 3)
            claim = t[1] if rng.random() < w else rng.randint(1, 3)
            refs = t[2] if rng.random() < w else rng.sample(["p", "q", "r", "s"], 2)
            for late in range(rng.choice([1, 1, 3])):
                rows.append((n, item, who, severity, FORMS[claim - 1][1].upper(), refs, late, ""))
            n += 1
    flags, forms = frames(spark, rows)
    result = consensus.agree(flags, forms)
    got = values(result)
    right = sum((k, "severity", str(t[0])) in got for k, t in truth.items()) + sum((k, "claim", str(t[1])) in got for k, t in truth.items())
    assert right > 0.93 * 800
    assert sum((k, "refs", x) in got for k, t in truth.items() for x in t[2]) > 0.93 * 800
    reliability = {r.source: r.severity_reliability for r in result.annotators.collect()}
    assert min(reliability[k] for k in "abc") > 0.75 > 0.3 > max(reliability[k] for k in "xyz")
    assert values(consensus.agree(flags.distinct(), forms)) == got
    assert all(0 <= r.agreement <= 1 + 1e-9 for r in result.values.collect())


def test_nulls_ties_and_empty(spark):
    rows = [
        (1, 7, "a", 1, None, None, 0, ""), (2, 7, "b", 2, None, [], 0, ""), (3, None, "a", 1, None, ["l"], 0, ""), (4, 8, None, 1, None, ["l"], 0, ""),
        (5, 9, "a", None, FORMS[0][1], ["l", "l", None], 0, ""), (6, 10, "c", 7, "zzz", ["k"], 0, ""),
    ]
    flags, forms = frames(spark, rows)
    assert values(consensus.agree(flags, forms)) == {(7, "severity", "1"), (9, "claim", "1"), (9, "refs", "l"), (10, "refs", "k")}
    assert values(consensus.agree(flags.limit(0), forms)) == set()
