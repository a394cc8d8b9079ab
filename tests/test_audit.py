import hashlib
import json

import pytest

from quire.plans import audit
from quire.sources import lean, statements

NODES = r"""
\begin{theorem}\label{thm:a}\lean{Ns.a}\leanok\uses{lem:b,lem:c} A \statusT\ledger{A1} \end{theorem}
\begin{lemma}\label{lem:b}\lean{b}\leanok B \statusT \end{lemma}
\begin{lemma}\label{lem:c}\lean{c}\leanok C \statusT \end{lemma}
\begin{lemma}\label{lem:d}\lean{d}\leanok\uses{lem:c} D \statusT \end{lemma}
\begin{lemma}\label{lem:e}\lean{gone}\leanok E \statusT \end{lemma}
\begin{proposition}\label{prop:p}\uses{ax:one} P "q" \statusT \end{proposition}
\begin{definition}[T/x]\label{ax:one} ax \statusA\quad\ledger{Mod:A7}\ledger{A2} \end{definition}
"""
LEAN = """
namespace Ns
theorem a : P := by exact helper b
lemma helper : Q := by simp [z]
end Ns
theorem b : P := trivial
theorem c : P := trivial
theorem d : P := trivial
theorem z : P := trivial
"""
PAPER = r"""
% trust base: begin
\item \ref{thm:p} is machine-checked. \item \ref{prop:p} is formalized and rests on A2. \item \ref{lem:q} is formalised
% trust base: end
% trust base: end
% trust base: begin
"""


@pytest.fixture(scope="module")
def world(spark):
    one = lambda path, text: spark.createDataFrame([(path, text)], "path string, text string")
    nodes = statements.nodes(one("c.tex", NODES)).cache()
    decls = lean.declarations(one("X.lean", LEAN)).cache()
    return nodes, decls, audit.cited(decls).cache(), audit.regions(one("p.tex", PAPER)).cache()


def rows(df):
    return sorted((r.tag, r.severity[0], r.subject, r.detail) for r in df.collect())


def test_uses_audit(world):
    nodes, decls, cited, _ = world
    assert {(r.src, r.dst) for r in cited.collect()} == {("Ns.a", "Ns.helper"), ("Ns.a", "b"), ("Ns.helper", "z")}
    assert rows(audit.uses_audit(nodes, decls, cited)) == [
        ("closure", "a", "lem:e", "gone"), ("declared", "a", "thm:a", "lem:c"), ("empty", "a", "lem:d", "1 formalised nodes are used, nothing is cited"),
        ("unused", "a", "lem:d", ""), ("unused", "a", "lem:e", ""),
    ]
    assert audit.audit_totals(nodes, decls).first().asDict() == {"labels_used": 3, "decls_cited": 4}


def test_export_replaces_the_scan(spark, world):
    nodes, decls, cited, _ = world
    export = spark.createDataFrame([("Ns.a", "d"), ("Ns.a", "Mathlib.x"), ("new", "b")], "decl string, const string")
    both = audit.exported(cited, export, decls)
    assert {(r.src, r.dst) for r in both.collect()} == {("Ns.a", "d"), ("Ns.helper", "z"), ("new", "b")}
    assert ("inferred", "a", "thm:a", "d lem:d") in rows(audit.uses_audit(nodes, decls, both))
    t = lambda x: spark.createDataFrame(x, "path string, sha string")
    assert [(r.subject, r.detail) for r in audit.stale_export(t([("a", "1"), ("b", "1"), ("c", "1")]), t([("a", "1"), ("b", "2"), ("d", "1")])).orderBy("subject").collect()] == [("b", "changed"), ("c", "went"), ("d", "came")]


def test_trust_base(spark, world):
    nodes, decls, _, found = world
    marks = spark.createDataFrame([("p.tex", 0, "thm:p", "thm:a")], "path string, pos int, statement_label string, label string")
    labels = audit.label_map(nodes, marks)
    assert rows(audit.stated_status(found, labels, nodes)) == [
        ("trust-base", "a", "p.tex:3", "lem:q is no node"), ("trust-base", "f", "p.tex:3", "prop:p is not formalised"),
        ("trust-base", "f", "p.tex:5", "end without begin"), ("trust-base", "f", "p.tex:6", "begin without end"),
    ]
    printed = spark.createDataFrame([("Ns.a", ["propext", "My.ax"])], "decl string, axioms array<string>")
    entries = spark.createDataFrame([("A1", "k", "x", ["My.ax"]), ("A2", None, None, [])], "id string, citekey string, anchor string, lean array<string>")
    boundary = spark.createDataFrame([("My.ax",)], "name string")
    read = audit.entries_read(nodes, printed, decls, entries, boundary)
    got = {(r.label, r.entry, r.unread) for r in read.collect()}
    assert {("thm:a", "A1", None), ("prop:p", "A2", None), ("prop:p", "Mod:A7", None), ("lem:b", None, "b")} <= got
    assert rows(audit.stated_entries(found, labels, read, entries, boundary)) == [("trust-base", "f", "p.tex:2", "A1 is read but not named"), ("trust-base", "f", "p.tex:2", "Mod:A7 is read but not named")]


def test_manifest(spark, world):
    nodes = world[0]
    entries = spark.createDataFrame([("A1", "k", "x \"y\"", [])], "id string, citekey string, anchor string, lean array<string>")
    shown = spark.createDataFrame([("ax:one", "T/x", "ax é", None)], "label string, title_md string, statement_md string, proof_md string")
    got = {r.label: json.loads(r.json) for r in audit.manifest(nodes, entries, shown).collect()}
    keys = "kind env title status ledger leanok notready lean uses statement statement_sha proof proof_sha statement_md proof_md rendered_sha title_md".split()
    assert list(got["thm:a"]) == keys and got["thm:a"]["ledger"] == [{"id": "A1", "citekey": "k", "anchor": 'x "y"'}]
    e = got["ax:one"]
    assert e["ledger"] == [{"id": "A7", "module": "Mod", "citekey": None, "anchor": None}, {"id": "A2", "citekey": None, "anchor": None}]
    want = json.dumps([e["env"], e["title_md"], e["status"], e["ledger"], e["lean"], e["leanok"], e["notready"], e["statement_md"], e["proof_md"]], ensure_ascii=False)
    assert e["rendered_sha"] == hashlib.sha256(want.encode()).hexdigest()[:12] and got["thm:a"]["rendered_sha"] is None
    assert got["prop:p"]["statement_sha"] == hashlib.sha256(b'P "q"').hexdigest()[:12]
    found = spark.createDataFrame([("b", "fatal", "s", "d"), ("a", "advisory", "s", "d")], "tag string, severity string, subject string, detail string")
    assert audit.verdict(found).first().asDict() == {"fatal": 1, "advisory": 1, "exit_status": 1}
    assert [r.line for r in audit.report(found).collect()] == ["  advisory [a] s: d", "  FAIL [b] s: d"]
