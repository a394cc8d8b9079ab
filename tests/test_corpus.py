from pyspark.sql import functions as F

from quire.plans import corpus, texts as plans
from quire.sources import texts


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_instruction_files(spark):
    files = frame(spark, "path string, text string", ("r/A.md", "see @b.md, and `@c.md`\n```\n@c.md\n```\nSet on 2026-01-02 x"), ("r/b.md", "@c.md"), ("r/c.md", "word " * 5000), ("r/d.md", "- **2026-01-01** ok\n@none.md"))
    lines = texts.lines(files)
    edges = corpus.instruction_imports(lines, files)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("r/A.md", "r/b.md"), ("r/b.md", "r/c.md")]
    load = corpus.resident(files, edges, frame(spark, "node string", ("r/A.md",), ("r/d.md",)))
    assert {r.source: (r.files, r.is_over) for r in load.collect()} == {"r/A.md": (3, True), "r/d.md": (1, False)}
    assert [(r.path, r.n, r.first_lines) for r in corpus.dated_lines(lines).collect()] == [("r/A.md", 1, [5])]
    said = frame(spark, "path string, pos int, sentence string", ("r/A.md", 1, "Please read c.md in full."), ("r/A.md", 2, "Then read r/c.md and b.md first."), ("r/A.md", 3, "No c.md"))
    assert sorted((r.target, r.pos) for r in corpus.read_pointers(said, files).collect()) == [("c.md", 1), ("r/c.md", 2)]


def test_homes_and_boundary(spark):
    nodes = frame(spark, "label string, lean array<string>", ("a", ["x"]), ("b", ["y"]), ("c", ["z"]), ("d", ["w"]), (None, ["x"]))
    decls = frame(spark, "name string, module string", ("x", "M"), ("y", "M"), ("z", "N"))
    modules = frame(spark, "module string, home string, labels array<string>", ("M", "home", ["a"]), ("N", "owed", []))
    assert {r.label: r["class"] for r in corpus.homes(nodes, decls, modules).collect()} == {"a": "at home", "b": "home elsewhere", "c": "owed", "d": "not in the record"}
    full = frame(spark, "fullname string", ("A.Group",), ("A.ring",), ("A.main",))
    got = corpus.shadows(full, frame(spark, "name string", ("Group",), ("ring",)), frame(spark, "name string", ("ring",), ("old",)))
    assert sorted(tuple(r) for r in got.collect()) == [("Group", "shadow"), ("old", "stale acknowledgement")]
    assert [r.fullname for r in corpus.unprobed(full, frame(spark, "text string", ("example : A.Group := by exact main",))).collect()] == ["A.ring"]
    imports = frame(spark, "src string, dst string, pos int", ("P", "Adv", 0), ("P", "Q", 1))
    assert [(r.module, r.importer) for r in corpus.imported_by_others(imports, frame(spark, "module string", ("Adv",))).collect()] == [("Adv", "P")]


def test_releases(spark):
    imports = frame(spark, "src string, dst string, pos int", ("R", "B", 0), ("R", "Lib", 1), ("B", "C", 0), ("C", "B", 0))
    lib = frame(spark, "root string, module string", ("Lib", "Lib.X"))
    got = corpus.carried(imports, frame(spark, "node string, pos int", ("R", 0)), lib)
    assert {r.node: r.parent for r in got.collect()} == {"R": None, "B": "R", "Lib": "R", "C": "B", "Lib.X": "Lib"}
    ours = frame(spark, "module string, text string", ("A", "x\r\ny"), ("B", "1"), ("D", ""))
    old = frame(spark, "module string, text string", ("A", "x\ny"), ("B", "2"), ("E", ""))
    assert {r.module: r.outcome for r in corpus.compared(ours, old).collect()} == {"A": "same", "B": "differs", "D": "added", "E": "gone"}
    r = corpus.redacted(frame(spark, "path string, text string", ("p", "/home/u/x /home/u /home")), ["/home/u", "/home"]).first()
    assert (r.text, r.n) == ("<path>/x <path> <path>", 3)
    nodes = frame(spark, "path string, label string, uses array<string>", ("p", "a", ["b", "z"]), ("q", "b", ["z"]))
    assert [(r.label, r.paths) for r in corpus.dangling_uses(nodes).collect()] == [("z", ["p", "q"])]
    pairs = frame(spark, "key string, a string, b string", ("k", "same start A", "same start B"), ("e", "x", "x"), ("n", None, "x"), ("p", "ab", "abc"))
    assert sorted((r.key, r.at, r.ours, r.theirs) for r in corpus.divergence(pairs).collect()) == [("k", 11, "A", "B"), ("p", 2, "", "c")]


def test_includes_of_includes(spark):
    includes = frame(spark, "src string, package string, rev string", ("root", "P", "1"), ("P@1", "Q", "2"), ("Q@2", "P", "0"), ("root", "X", "9"))
    known = frame(spark, "package string, rev string, src string", ("P", "1", "P@1"), ("Q", "2", "Q@2"))
    got = corpus.resolve_includes(includes, known, frame(spark, "node string", ("root",)))
    assert sorted((r.package, r.rev, r.is_known) for r in got.collect()) == [("P", "1", True), ("Q", "2", True), ("X", "9", False)]
    assert got.select(F.count("*")).first()[0] == 3


def test_whole_anchors_once(spark, tmp_path):
    flags = [(1, "The cone is\n bounded near the origin of it"), (1, "The cone is bounded near the origin of it"), (2, "the cone is open"), (3, "cone is closed here again"), (4, "cone"), (5, " "), (6, None), (7, "it is")]
    docs = [
        (1, "We see: the Cone is bounded\nnear the  origin of it."), (2, "The cone is bounded near the origin of it, as the cone is bounded near the origin of items."),
        (3, "The cone is open; the silicone is closed here againx"), (4, "The cone is bounded."), (5, None), (6, ""), (7, "Cones"),
    ]
    frame(spark, "flag_id bigint, anchor string", *flags).write.parquet(f"{tmp_path}/flag.parquet")
    frame(spark, "doc_id bigint, text string", *docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in plans.anchor_in_documents(spark, str(tmp_path)).collect())
    assert got == [(1, 1), (2, 3), (3, 3), (4, 1), (4, 4), (4, 7)]
