import datetime as dt

import pytest

from quire.operators import repair
from quire.plans import releases
from quire.sources import lean, records, statements


def test_json_records(spark):
    t = lambda text, path="f.json": spark.createDataFrame([(path, text)], "path string, text string")
    lake = records.lake_packages(t('{"packages": [{"name": "a", "url": "u", "inputRev": "main", "rev": "abc"}, {"name": "b", "inputRev": "v1"}, {"url": "x"}]}'))
    assert sorted((r.name, r.rev, r.folder) for r in lake.collect()) == [("a", "abc", ".lake/packages"), ("b", "v1", ".lake/packages")]
    assert records.lake_packages(t("nope")).count() == 0
    wanted = spark.createDataFrame([("a",), ("z",)], "name string")
    assert {r.name: r.is_known for r in records.package_projection(wanted, lake).collect()} == {"a": True, "z": False}
    export = t('{"D.a": ["x", "y", "x"], "_sources": {"A.lean": "12"}}')
    assert {(r.decl, r.const) for r in records.constants(export).collect()} == {("D.a", "x"), ("D.a", "y")}
    assert [tuple(r) for r in records.constants_stamp(export).collect()] == [("A.lean", "12")]
    modules, decls = records.homes_record(t('{"modules": {"M": {"home": {"kind": "none", "labels": ["l"]}}, "N": {}}, "declarations": [{"name": "d", "module": "M"}, {}]}'))
    assert sorted((r.module, r.home, r.labels) for r in modules.collect()) == [("M", "none", ["l"]), ("N", None, [])] and [r.name for r in decls.collect()] == ["d"]
    assert [(r.pos, r.label, r.notes) for r in records.demands(t('{"demands": [{"label": "b", "claims": [{"note": "n"}]}, {"label": "a"}]}')).collect()] == [(0, "b", ["n"]), (1, "a", None)]
    present = spark.createDataFrame([("a", True), ("b", False)], "dir string, has_lean boolean")
    got = records.members(t('{"members": [{"slug": "a"}, {"slug": "x", "dir": "b"}, {"slug": "c"}]}'), present)
    assert {r.slug: r.state for r in got.collect()} == {"a": "member", "x": "no declarations", "c": "not checked out"}
    assert {r.key: r.value for r in records.settings(t('﻿{"a": "1", "b": "2"}'), t('{"b": "3"}')).collect()} == {"a": "1", "b": "3"}


def test_configuration(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    toml = records.toml_values(t(("linkage.toml", '[paths]\npaper = ["p", "q"]\nlean = "L"\n[[modules]]\nname = "m"\nanonymous = true'), ("bad", "= 1")))
    assert sorted((r.key, r.at, r.value) for r in toml.filter("problem IS NULL").collect()) == [("modules[0].anonymous", 0, "true"), ("modules[0].name", 0, "m"), ("paths.lean", 0, "L"), ("paths.paper", 0, "p"), ("paths.paper", 1, "q")]
    assert toml.filter("problem IS NOT NULL").count() == 1
    files = spark.createDataFrame([("p",), ("linkage.toml",), ("a/b/linkage.toml",)], "path string")
    assert sorted(r.named for r in records.missing_paths(toml, ["paths.paper", "paths.lean"], files).collect()) == ["L", "q"]
    starts = spark.createDataFrame([("a/b/c",), ("a",), ("x/y",)], "start string")
    assert {r.start: r.config for r in records.discovered(starts, files, "linkage.toml").collect()} == {"a/b/c": "a/b/linkage.toml", "a": "linkage.toml", "x/y": "linkage.toml"}
    safe = records.safe_commands(t(("m", "\\newcommand*{\\foo}[1]{x} % \\newcommand{\\no}{}\n\\renewcommand\\bar{y}")), t(("a", "# remark\n\n baz \n\\qux")))
    assert {r.name for r in safe.collect()} == {"foo", "bar", "baz", "qux"}
    rows = [("p", "1" * 40, "old", dt.datetime(2024, 1, 1)), ("p", "2" * 40, "new", dt.datetime(2025, 1, 1)), ("q", "1" * 40, "only", None)]
    revs = spark.createDataFrame(rows, "path string, rev string, text string, added_at timestamp")
    assert {r.path: r.text for r in records.at_revision(revs).collect()} == {"p": "new", "q": "only"}
    assert {r.path: r.text for r in records.at_revision(revs, "1111111").collect()} == {"p": "old", "q": "only"}


def test_releases(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    dates = releases.changelog_dates(t(("c", "## 1.2.0 — 2025-03-06 — x\n## v0.1.0 — 2024-13-01\n## other")))
    assert [(r.tag, str(r.day), r.said) for r in dates.withColumn("said", releases.long_date(dates.day)).collect()] == [("1.2.0", "2025-03-06", "March 6, 2025")]
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    required = spark.createDataFrame([("paper", "draft"), ("lean", "released")], "part string, phase string")
    got = releases.parts_state(one("part", ["paper", "lean"]), one("part", ["web"]), required, "review")
    assert sorted((r.tag, r.subject) for r in got.collect()) == [("parts", "web"), ("phase", "paper")]
    modules = spark.createDataFrame([("a", "draft"), ("a", "review"), ("b", "zz")], "article string, phase string")
    assert [tuple(r) for r in releases.most_advanced(modules).collect()] == [("a", "review")]
    paper = releases.axiom_lines(t(("p", "\\begin{verbatim}'A.b' depends on\n axioms: [x,\n y]\n'c' depends on axioms: [z]\\end{verbatim} 'd' depends on axioms: [q]")), "verbatim")
    assert {r.decl: r.axioms for r in paper.collect()} == {"A.b": ["x", "y"], "c": ["z"]}
    guard = releases.axiom_lines(t(("g", "'A.b' depends on axioms: [x, y]\n'e' depends on axioms: []")))
    assert [(r.subject, r.detail) for r in releases.axiom_mismatches(paper, guard).collect()] == [("c", "not printed by the guard")]
    decls = spark.createDataFrame([("R.P.exp", "Lib.A"), ("R.Q.exp", "Lib.B"), ("exp", "Other.C"), ("one", "Other.C")], "fullname string, module string")
    tags = one("tag", ["Lib.P.exp", "Lib.Z.exp", "one", "Pkg.exp"])
    got = {}
    for r in releases.tag_modules(tags, decls, ["Lib"], ["Pkg"]).collect():
        got.setdefault(r.tag, set()).add(r.module)
    assert got == {"Lib.P.exp": {"Lib.A"}, "Lib.Z.exp": {"Lib.A", "Lib.B"}, "one": {"Other.C"}}
    assert [r.path for r in releases.stale_files(one("path", ["./A.md", "b.md"]), one("path", ["a.MD"])).collect()] == ["b.md"]
    assert [r.slug for r in releases.lost_notes(t(("x", "\\notes{a} \\notes{b}")), one("path", ["n/a.md"])).collect()] == ["b"]
    flags = releases.sorries(lean.declarations(t(("x.lean", "/-- d -/\ntheorem a : True := by sorry\ntheorem b : P := by `sorry` x"))))
    assert {r.fullname: (r.is_sorry, r.is_vacuous, r.has_doc) for r in flags.collect()} == {"a": (True, True, True), "b": (False, False, False)}
    parents = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "node string, parent string")
    assert {r.node: r.chain for r in releases.import_chains(parents).collect()} == {"r": "r", "a": "r -> a", "b": "r -> a -> b"}
    text = "% shared with blueprint thm:a, lem:b@0123456789ab+0123456789ab\nx"
    new = releases.repinned(t(("p", text), ("q", "none")), {"thm:a": "a" * 12}, {"lem:b": "b" * 12}).collect()
    assert [(r.path, r.text, r.n) for r in new] == [("p", f"% shared with blueprint thm:a@{'a' * 12}, lem:b@0123456789ab+{'b' * 12}\nx", 1)]
    assert statements._marks(new[0].text)[0][2][0]["pinned"] == "a" * 12


@pytest.mark.parametrize("said,want", [
    ("asks which one", False), ("ask for a bound", True), ("asked to point out", False), ("asked to be closed", True), ("asks the reader to wait", False),
    ("asks the kernel to decay", True), ("asks (A8) at once", True), ("ask the same question", False), ("asks X at", True), ("ask themselves whether", False), ("asks, that", False),
])
def test_asks(said, want):
    assert repair.is_requirement(said[said.index("k") + 1 :].removeprefix("ed").removeprefix("s")) == want


def test_repair(spark):
    text = "Head 1\n\nThe the-\nory and a scale-\nspace of\n\nHead 2\n\nkernels. A scale-space.\n\n12\n\nHead 3\n\ntheory ends."
    row = repair.repaired(spark.createDataFrame([("p", text)], "path string, text string")).first()
    assert (row.text, row.heads, row.joined, row.reflowed) == ("The theory and a scale-space of kernels. A scale-space.\n\ntheory ends.", 4, 2, 1)
    lines = spark.createDataFrame([("p", 1, "We ask", "for more $x$."), ("p", 2, "for more", None)], "path string, line_no int, line string, next string")
    assert [(r.path, r.line_no, r.said) for r in repair.asks(lines).collect()] == [("p", 1, "ask for more X .")]
