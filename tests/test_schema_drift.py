import itertools
import json
import random

from quire.functions.schema_tree import MOVE, RETYPE, Node, assign, name_likeness, parse_type, cheapest, type_class
from quire.operators import schema_drift

SCHEMA = "series string, seq int, src_file string, line_no int, body string, kind string, name string"


def table(spark, files):
    """files: {(series, seq): [bodies]}; two more columns clash with names used inside."""
    rows = [(s, q, f"{s}-{q}", n, b if b is None or isinstance(b, str) else json.dumps(b), "x", "y") for (s, q), bodies in files.items() for n, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r.src_file, r.kind, r.field_name, r.change_kind) for r in schema_drift.top_level(schema_drift.changes(df)).collect())


def test_types():
    assert [type_class(t) for t in ("DECIMAL(1,0)", "DECIMAL(21,0)", "BIGINT", "DOUBLE", "VOID", "ARRAY<VOID>")] == ["decimal", "integer", "integer", "decimal", "void", "array"]
    tree = parse_type("OBJECT<`a b`: ARRAY<OBJECT<c: DECIMAL(2,1)>>, d: STRING>", "root")
    assert [c.name for c in tree.children] == ["a b", "d"] and tree.children[0].children[0].children[0].kind == "decimal" and tree.size() == 5


def test_assignment_is_cheapest():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(5, 6)
        cost = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert sum(cost[i][j] for i, j in enumerate(assign(cost))) == best


def test_moves_and_nesting():
    before = [Node("a", "object", [Node("x", "string"), Node("y", "integer")]), Node("b", "object", [])]
    after = [Node("a", "object", [Node("y", "decimal")]), Node("b", "object", [Node("x", "string")])]
    cost, changes = cheapest(before, after)
    assert sorted((c.kind, c.path, c.before) for c in changes) == [("moved", "b.x", "a.x"), ("retyped", "a.y", "a.y")]
    assert abs(cost - MOVE - RETYPE) < 1e-9
    # an object moves with what is in it, and what changes there is counted
    before = [Node("a", "object", [Node("o", "object", [Node("k", "string"), Node("m", "string")])]), Node("b", "object", [])]
    after = [Node("a", "object", []), Node("b", "object", [Node("o", "object", [Node("k", "string"), Node("z", "boolean")])])]
    cost, changes = cheapest(before, after)
    assert sorted((c.kind, c.path, c.before) for c in changes) == [("added", "b.o.z", None), ("moved", "b.o", "a.o"), ("removed", "a.o.m", "a.o.m")] and abs(cost - MOVE - 2) < 1e-9
    # a like field of the same object is a rename rather than a move of the other
    before = [Node("mode", "string", n=9, local={1: 1.0}, general={1: 1.0}), Node("a", "object", [])]
    after = [Node("modeName", "string", n=9, local={1: 1.0}, general={1: 1.0}), Node("a", "object", [Node("mode", "string")])]
    assert sorted((c.kind, c.path, c.before) for c in cheapest(before, after)[1]) == [("added", "a.mode", None), ("renamed", "modeName", "mode")]
    assert name_likeness("flag_tag", "tagName") == 0.5 and name_likeness("sev", "severity") == 1


def test_each_kind_of_change(spark):
    values = ["budding", "draft", "evergreen"]
    files = {("s", q): [] for q in (1, 2, 3)}
    for k in range(9):
        files["s", 1].append({"kind": "flag", "m": values[k % 3], "n": k, "keep": "x", "gone": 1, "late": None})
        files["s", 2].append({"kind": "flag", "ripe": values[(k + 1) % 3], "n": str(k), "keep": "x", "new": True, "late": None})
        files["s", 3].append({"kind": "flag", "Ripe": values[k % 3], "n": str(k), "keep": None if k else 5, "new": True, "late": 1.0})
    files["t", 1] = [{"kind": "flag", "q": 1}]
    df = table(spark, files)
    want = [
        ("s-2", "flag", "gone", "removed"), ("s-2", "flag", "n", "retyped"), ("s-2", "flag", "new", "added"), ("s-2", "flag", "ripe", "renamed"),
        ("s-3", "flag", "Ripe", "renamed"), ("s-3", "flag", "keep", "retyped"),
    ]
    assert found(df) == want
    assert found(df.unionAll(df)) == want  # lines delivered twice
    lines = schema_drift.unified(df)
    assert lines.count() == 28
    column = next(c for c in lines.columns if c in ("m", "ripe", "Ripe"))
    assert lines.filter(f"`{column}` in ('budding', 'draft', 'evergreen')").count() == 27


def test_a_name_used_again_is_another_column(spark):
    values = ["budding", "draft", "evergreen"]
    flag = lambda **f: {"kind": "flag", **f}
    files = {
        ("s", 1): [flag(mode=values[k % 3], back=k) for k in range(9)],
        ("s", 2): [flag(modus=values[k % 3]) for k in range(9)],
        ("s", 3): [flag(modus=values[k % 3], mode=k, back=k) for k in range(9)],
        ("t", 1): [flag(mode=values[k % 3]) for k in range(9)],
    }
    df = table(spark, files)
    rows = schema_drift.lineages(schema_drift.facts(schema_drift.typed_values(df)), schema_drift.changes(df)).collect()
    assert {(r.src_file, r.name): (r.origin, r.generation) for r in rows if r.name in ("mode", "modus", "back")} == {
        ("s-1", "mode"): ("mode", 1), ("s-1", "back"): ("back", 1), ("s-2", "modus"): ("mode", 1), ("s-3", "modus"): ("mode", 1),
        ("s-3", "mode"): ("mode", 2), ("s-3", "back"): ("back", 1), ("t-1", "mode"): ("mode", 1),
    }
    got = schema_drift.unified(df)
    assert got.filter("mode IN ('budding', 'draft', 'evergreen')").count() == 36 and sorted(r.mode_2 for r in got.filter("mode_2 IS NOT NULL").collect()) == list(range(9))
    assert got.filter("other <> '{}'").count() == 0


def test_single_values_of_another_type_and_dotted_names(spark):
    one = [{"kind": "flag", "a.b": 1, "o": {"x": 1}}] * 1 + [{"kind": "flag", "a.b": "?", "o": {"x": 1}}] + [{"kind": "flag", "a.b": k} for k in range(5)]
    two = [{"kind": "flag", "a.b": 1.5, "o": {"x": "s"}}]
    df = table(spark, {("s", 1): one, ("s", 2): two})
    assert found(df) == [("s-2", "flag", "a.b", "retyped")]
    assert schema_drift.changes(df).filter("path = 'o.x' AND change_kind = 'retyped'").count() == 1


def test_values_a_column_cannot_hold_are_kept(spark):
    df = table(spark, {("s", 1): [{"kind": "flag", "n": 1}, {"kind": "flag", "n": 2}, {"kind": "flag", "n": "many"}]})
    got = sorted((r.n, r.other) for r in schema_drift.unified(df).filter("n IS NOT NULL").collect())
    assert got == [(1, "{}"), (2, "{}")]
    assert [r.other for r in schema_drift.unified(df).filter("n IS NULL").collect()] == ['{"n":"many"}']


def test_blank_broken_and_empty(spark):
    df = table(spark, {("s", 1): [None, "", "  ", "nope", "[1]", {"kind": "flag", "a": 1}], ("s", 2): [{"a": 1}, {"kind": "flag", "a": 2}]})
    assert found(df) == []
    assert sorted(r.body for r in schema_drift.unparsed(df).collect()) == ["[1]", "nope"]
    assert found(df.limit(0)) == [] and schema_drift.unified(df.limit(0)).count() == 0


def test_inner_fields_of_any_line_count(spark):
    shapes = [{"a": 1}] * 5 + [{"a": 1, "rare": "x"}] * 2 + [{"a": 2, "seldom": True}]
    one = [{"kind": "flag", "o": o, "l": [{"p": 1}]} for o in shapes]
    two = [{"kind": "flag", "o": o, "l": [{"p": 1}]} for o in shapes[5:] * 2] + [{"kind": "flag", "o": {"a": 1, "fresh": 0.5}, "l": [{"p": 1, "q": "s"}]}]
    three = [{"kind": "flag", "o": {"a": 1, "rare": 4 if k else "x"}, "l": []} for k in range(4)]
    df = table(spark, {("s", 1): one, ("s", 2): two, ("s", 3): three})
    got = schema_drift.changes(df)
    assert sorted((r.change_kind, r.path) for r in got.filter("src_file = 's-2'").collect()) == [("added", "l.[].q"), ("added", "o.fresh")]
    assert ("retyped", "o.rare", "variant") in {(r.change_kind, r.path, r.type_after) for r in got.filter("src_file = 's-3'").collect()}
    assert found(df) == []
