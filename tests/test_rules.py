import pytest
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.plans import texts as texts_plan
from quire.plans import rules
from quire.sources import lean, reviews, statements, texts, trust

BLUEPRINT = r"""
\begin{theorem}[Main]\label{thm:main}\lean{Ns.main}\leanok\uses{lem:a, def:x}
  Let $x$ be \emph{good}. % a comment
  \statusT\ledger{A1}\quad\emph{note}
\end{theorem}
% between
\begin{proof}\leanok By \cref{lem:a}.\end{proof}
\begin{lemma}\label{lem:a}\uses{lem:b,ax:one} A. \statusT\end{lemma}
\begin{proof} By Lemma~\ref{lem:b}. \end{proof}
\begin{lemma}\label{lem:b} B.\statusT\end{lemma}
\begin{definition}\label{def:x} X \unknowncmd. \end{definition}
\begin{theorem}\label{ax:one}\ledger{A9} One. \statusA\ledger{A1}\quad\emph{Assignment: A1 carries it.}\end{theorem}
\begin{theorem}\label{ax:two} Two. \statusA\end{theorem}
\begin{lemma}\label{lem:c}\leanok\lean{gone} C.\statusT\end{lemma}
\begin{proof} p \end{proof}
"""
AXIOMS = "# T\n\n## A1 one\n**Lean:** `Ns.main`, `other`\n**Cite:** @key — Thm 3 · more\n\n## A2 two\nno line\n"
PAPER = r"""% shared with blueprint lem:b, lem:zzz
\begin{lemma}\label{lem:b} B. \end{lemma}
% shared with blueprint lem:a@000000000000
\begin{lemma} A changed. \end{lemma}
\begin{proof} By \ref{lem:b}. \end{proof}
\begin{theorem}\label{thm:lonely} T \cite{k1,k2}\cite[p.~1]{k3} \ref{nope}\end{theorem} % \ref{commented}
"""
BIB = "@article{k1, title={x}, doi = {10.1/x}}\n@comment{k9}\n@book{k2, title={y}}\n"
LEAN = """import A.B
import C
namespace Ns
/-- The main one. -/
@[simp] theorem main (x : Nat) (h : x := 1) : P x := by
  exact foo -- theorem no
/- theorem hidden : x /- nested -/ -/
def helper : Nat where
end Ns
lemma top : "theorem str" = y
/-- info: 'Ns.main' depends on axioms: [propext, extra] -/
#guard_msgs in #print axioms Ns.main
#print axioms top
"""


@pytest.fixture(scope="module")
def world(spark):
    one = lambda name, text: spark.createDataFrame([(name, text), ("null", None)], "path string, text string")
    return {
        "nodes": statements.nodes(one("content.tex", BLUEPRINT)).cache(),
        "entries": statements.ledger_entries(one("AXIOMS.md", AXIOMS)),
        "marks": statements.markers(one("p.tex", PAPER)),
        "paper": statements.paper_tables(one("p.tex", PAPER)),
        "bib": statements.bib_entries(one("r.bib", BIB)),
        "decls": lean.declarations(one("A.lean", LEAN)),
        "pins": lean.pins(one("A.lean", LEAN)),
        "imports": lean.imports(one("X/A.lean", LEAN)),
        "safe": spark.createDataFrame([(n,) for n in ("emph", "ref", "cref")], "name string"),
    }


def found(df):
    return sorted((r.tag, r.severity[0], r.subject, r.detail) for r in df.collect())


def test_nodes(world):
    n = {r.label: r for r in world["nodes"].collect()}
    main = n["thm:main"]
    assert (main.title, main.lean, main.uses, main.status, main.leanok, main.proof_leanok) == ("Main", ["Ns.main"], ["lem:a", "def:x"], "T", True, True)
    assert main.statement == r"Let $x$ be \emph{good}." or "good" in main.statement
    assert main.status_ledger == ["A1"] and main.proof_refs == ["lem:a"] and main.status_note == r"\emph{note}"
    assert n["lem:a"].shared_proof == r"By \ref{lem:b}." and n["lem:b"].proof is None and n["def:x"].status is None
    assert n["ax:one"].ledger == ["A9", "A1"] and n["ax:one"].status_ledger == ["A1"]
    assert [r.line for r in world["nodes"].orderBy("pos").collect()][:2] == [2, 8]


def test_blueprint_rules(world):
    nodes = world["nodes"]
    assert found(rules.declared(nodes, world["decls"])) == [("lean", "f", "lem:c", "gone is not declared")]
    assert found(rules.flags_agree(nodes)) == [("leanok", "a", "lem:c", "the statement is formalised, its proof is not marked")]
    assert found(rules.ledger(nodes.select(F.explode("ledger").alias("ref")).distinct(), world["entries"])) == [("ledger", "f", "A9", "no entry")]
    assert found(rules.status(nodes)) == [("assign", "f", "ax:two", "no assignment clause"), ("status", "f", "def:x", "no status")]
    assert found(rules.render_safe(nodes, world["safe"])) == [("render", "f", "def:x", "command unknowncmd in statement")]
    assert found(rules.interfaces(nodes)) == []
    got = found(rules.dependencies(nodes))
    assert got == [("depend", "a", "lem:a", "1 of 1 rest on it ahead of the boundary"), ("depend", "f", "lem:b", "1 rest on it: thm:main -> lem:a -> lem:b")]


def test_shared_and_paper_rules(world):
    got = found(rules.shared(world["nodes"], world["marks"]))
    assert ("shared", "f", "lem:zzz", "no such node") in got and ("drift", "f", "lem:a", "the blueprint changed since it was pinned") in got
    assert not [g for g in got if g[2] == "lem:b" and g[0] == "drift"]
    assert ("uses", "a", "lem:a", "ax:one") in got
    paper = found(rules.paper(world["paper"], world["bib"]))
    assert paper == [("cite", "f", "k3", "no such entry"), ("doi", "a", "k2", "no DOI"), ("orphan", "a", "thm:lonely", "never referred to"), ("ref", "f", "nope", "no such label")]
    assert not [f for f in found(rules.paper(world["paper"], world["bib"].limit(0))) if f[0] in ("cite", "doi")]
    everything = rules.check(world["nodes"], world["decls"], world["entries"], world["marks"], world["safe"])
    assert {r.tag for r in everything.collect()} >= {"lean", "leanok", "render", "ledger", "status", "assign", "depend", "shared", "drift"}
    assert rules.statistics(world["nodes"]).first().asDict() == {"nodes": 7, "formalised": 2, "formalised_proofs": 1, "unproved": 1}


def test_manifest_and_demand(world, spark):
    rows = {r.label: r.json for r in rules.manifest(world["nodes"], world["entries"]).collect()}
    assert '"title":null' in rows["lem:a"] and '"citekey":"key"' in rows["thm:main"] and '"sources":[]' in rows["lem:b"]
    wanted = spark.createDataFrame([(1, "lem:b"), (2, "thm:main"), (3, "zz"), (4, "ax:one")], "pos int, label string")
    assert [(r.label, r.state) for r in rules.demand(wanted, world["nodes"]).orderBy("pos").collect()] == [("lem:b", "open"), ("zz", "not in the blueprint"), ("ax:one", "accepted")]


def test_lean(world, spark):
    d = {r.fullname: r for r in world["decls"].collect()}
    assert set(d) == {"Ns.main", "Ns.helper", "top"}
    assert d["Ns.main"].stmt == "(x : Nat) (h : x := 1) : P x" and d["Ns.main"].proof == "by exact foo" and d["Ns.main"].doc == "The main one." and d["Ns.main"].mods == "@[simp]"
    assert [(r.decl, r.guarded, r.axioms) for r in world["pins"].orderBy("line").collect()] == [("Ns.main", True, ["propext", "extra"]), ("top", False, None)]
    assert [(r.src, r.dst) for r in world["imports"].orderBy("pos").collect()] == [("X.A", "A.B"), ("X.A", "C")]
    tokens = spark.createDataFrame([("main",), ("Ns.helper",), ("none",)], "token string")
    assert {r.token: r.decl for r in rules.resolve(tokens, world["decls"]).collect()} == {"main": "Ns.main", "Ns.helper": "Ns.helper", "none": None}


def test_trust_and_pins(world, spark):
    lines = spark.createDataFrame([("t", k, x) for k, x in enumerate(["propext", "# c", "", "include Pkg @ v1.2.3 a.md", "include Pkg", "two words", "Ns.main # ok"])], "path string, line_no int, line string")
    parts = trust.boundary(lines)
    assert [r.name for r in parts["names"].orderBy("line_no").collect()] == ["propext", "Ns.main"]
    assert [(r.package, r.rev, r.file) for r in parts["includes"].collect()] == [("Pkg", "v1.2.3", "a.md")] and parts["malformed"].count() == 2
    assert found(rules.trust(parts["names"], world["entries"])) == [("trust", "a", "A2", "names no declaration"), ("trust", "f", "propext", "grounded by no entry")]
    assert found(rules.axioms(world["pins"], parts["names"])) == [("axiom", "f", "Ns.main", "extra"), ("pin", "a", "top", "not guarded")]
    flow = spark.createDataFrame([("w", 1, "  - uses: a/b@v1"), ("w", 2, "uses: a/b@v1.2.3"), ("w", 3, "uses: c@" + "0" * 40)], "path string, line_no int, line string")
    assert [r.ref for r in trust.unpinned(flow).collect()] == ["v1"]


def test_reviews(spark):
    body = '{"kind":"flag","severity":1}\n\n{"kind":"review","target":"x"}\n{"kind":"flag","severity":true,"refs":["a"]}\nnope\n{"kind":"other"}\n{"kind":"flag","severity":2}'
    df = spark.createDataFrame([("r.jsonl", body)], "path string, text string")
    assert [(r.line_no, r.problem) for r in reviews.records(df).filter("problem IS NOT NULL").orderBy("line_no").collect()] == [(1, "flag before any review"), (5, "not a JSON object"), (6, "unknown kind")]
    assert [(r.severity, r.refs, r.review_line) for r in reviews.flags(df).orderBy("line_no").collect()] == [(None, ["a"], 3), (2, [], 3)]


def test_anonymity_and_sync(spark):
    lines = spark.createDataFrame([("p", 1, "See our earlier paper"), ("p", 2, "as Müller shows \\cite{smith}"), ("p", 3, "plain"), ("p", 4, "a@b.org"), ("p", 5, "MULLER did"), ("p", 6, "a@b.org % anonymity-ok"), ("r.bib", 1, "Müller")], "path string, line_no int, line string")
    names = spark.createDataFrame([("Müller",), ("Smith",)], "name string")
    assert sorted((r.line_no, r.what) for r in rules.anonymity(lines, names).collect()) == [(1, "first-person self-citation"), (2, "identifying name"), (4, "e-mail address"), (5, "identifying name")]
    t = lambda rows: spark.createDataFrame(rows, "path string, sha string")
    got = rules.sync_directions(t([("a", "1"), ("b", "2"), ("c", "2"), ("d", "2"), ("e", "1")]), t([("a", "1"), ("b", "1"), ("c", "3"), ("d", "3")]), t([("b", "1"), ("c", "2"), ("d", "1")]))
    assert {r.path: r.direction for r in got.collect()} == {"a": "same", "b": "update", "c": "local change", "d": "conflict", "e": "missing here"}


def test_files(spark, tmp_path):
    (tmp_path / "_build").mkdir()
    (tmp_path / "a.tex").write_bytes(b"one\r\ntwo\x07\n```\nx\n```\nend\x1f")
    (tmp_path / "_build" / "b.tex").write_text("skipped")
    (tmp_path / "c.md").write_text("no")
    got = texts.read_texts(spark, str(tmp_path), "*.tex")
    assert [r.path.rsplit("/", 1)[-1] for r in got.collect()] == ["a.tex"]
    assert [r.fenced for r in texts.lines(got).orderBy("line_no").collect()] == [False, False, True, True, True, False]
    assert sorted((r.line_no, r.code) for r in texts.control_chars(texts.read_bytes(spark, str(tmp_path), "*.tex")).collect()) == [(2, 7), (6, 31)]
    assert got.select(F.length("text")).first()[0] > 5


MOVED = r"""% shared with blueprint thm:a@0123456789ab+abcdefabcdef , lem:b
\begin{theorem}[On {[x]} sets]\label{thm:p}
X by Corollaries~\ref{c} and Appendix \ref{d}. \statusT\quad\emph{a {b {c}} note} \emph{free}
\end{theorem}
% shared in full with blueprint lem:c
\begin{lemma} Y \end{lemma}
% a remark
\begin{proof} P \end{proof}
% shared with blueprint lem:d
% proof omitted
\begin{lemma} Z \end{lemma}
As shown in \ref{lem:z} and \ref{lem:y}
\begin{proof} N \end{proof}
% proof of lem:b

\begin{proof} Q \cref{x} \end{proof}
\begin{proof}[Proof of Lemma~\ref{lem:z}] R \end{proof}
"""


def test_moved_proofs_and_titles(spark):
    df = spark.createDataFrame([("p.tex", MOVED)], "path string, text string")
    got = {r.label: r for r in statements.markers(df).collect()}
    assert {k: (r.pinned, r.proof_pinned, r.statement_label, r.omitted) for k, r in got.items()} == {
        "thm:a": ("0123456789ab", "abcdefabcdef", "thm:p", False), "lem:b": (None, None, "thm:p", False), "lem:c": (None, None, None, False), "lem:d": (None, None, None, True),
    }
    assert got["thm:a"].shared_statement == "X by \\ref{c} and \\ref{d}."
    assert [got[k].shared_proof for k in ("thm:a", "lem:b", "lem:c", "lem:d")] == ["Q \\ref{x}", "Q \\ref{x}", "P", None]
    assert {r.label: r.line for r in statements.floating(df).collect()} == {"lem:b": 16, "lem:z": 17}
    assert [t for _, _, t, _, _, _ in statements.statements_of(MOVED)] == ["On {[x]} sets", None, None]


def test_rendered_and_verdicts(spark):
    src = "A \\ledger{Mod:A2} b \\ledger{A3}. % c\n\\label{x} \\statusA\\quad\\ledger{A1}\\quad\\emph{n} z"
    row = spark.createDataFrame([(src,)], "t string").select(fn.rendered(F.col("t")).alias("r"), fn.statement(F.col("t")).alias("s")).first()
    assert row.r == "A ledger A2 of Mod b ledger A3. z" and row.s.startswith("A b .")
    cases = [(4, 9.0, 0.0, 0.0, ""), (5, 9.0, 0.0, 0.0, "BOTH"), (5, 9.0, 4.0, 5.0, "voice"), (5, 9.0, 5.0, 4.0, "genre"), (5, 0.0, 0.0, 0.0, "")]
    df = spark.createDataFrame([c[:4] for c in cases], "n int, x double, a double, g double")
    assert [r[0] for r in df.select(fn.verdict(F.col("n"), F.col("x"), F.col("a"), F.col("g"))).collect()] == [c[4] for c in cases]
    assert df.select(fn.verdict(F.col("n"), F.col("x"), F.col("a"), F.col("g"), supported=(False, True))).collect()[2][0] == ""


def test_swallowed_prose(spark):
    t = lambda text: spark.createDataFrame([("a.tex", text)], "path string, text string")
    base = "We show that the bound\nholds for every kernel and that\nit is sharp. The rest follows."
    now = "We show that\n% CHANGED: moved the bound holds for every kernel\nand that it is sharp.\n% said. it is sharp.\nThe rest follows."
    assert [tuple(r) for r in texts_plan.swallowed_prose(t(now), t(base)).collect()] == [("a.tex", 2, "the bound holds for every kernel")]
    assert texts_plan.swallowed_prose(t(base), t(base)).count() == 0
