"""Audits: declared against inferred dependencies, the trust base that a paper states, exports, the manifest.

Declarations, their tokens, nodes, marks and pins are tables; closures are walks. Nothing here
gathers rows at the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import graph
from quire.plans.rules import _finding, by_label, edges, resolve
from quire.session import cut
from quire.sources.statements import LEDGER_KEY
from quire.sources.texts import parsed

#: Fixed value: kinds of labels that state something.
STATEMENT_KINDS = ("thm", "lem", "prop", "cor", "def")


# -- dependencies of declarations --------------------------------------------------------


def cited(decls: DataFrame) -> DataFrame:
    """``src, dst``: declarations of the article that the source of another one names, by full or only short name."""
    body = F.concat_ws(" ", "stmt", "proof")
    tokens = decls.select(F.col("fullname").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?U)([\p{L}_][\w'.]*)"), 1))).alias("token"))
    meant = resolve(tokens.select("token").distinct(), decls).filter("decl IS NOT NULL")
    return tokens.join(meant, "token").filter("src <> decl").select("src", F.col("decl").alias("dst")).distinct()


def exported(citations: DataFrame, export: DataFrame, decls: DataFrame) -> DataFrame:
    """``citations`` with those of an export (decl, const) in place of what the scan found for its declarations.

    Constants that are neither declared here nor exported belong to others and are left out.
    """
    own = decls.select(F.col("fullname").alias("const")).unionByName(export.select(F.col("decl").alias("const"))).distinct()
    given = export.join(own, "const", "left_semi").filter("decl <> const").select(F.col("decl").alias("src"), F.col("const").alias("dst"))
    rest = citations.join(export.select(F.col("decl").alias("src")).distinct(), "src", "left_anti")
    return rest.unionByName(given).distinct()


def node_declarations(nodes: DataFrame, decls: DataFrame) -> DataFrame:
    """``label, token, decl`` of all tags of nodes; ``decl`` is null where none is found."""
    tags = nodes.filter("label IS NOT NULL").select("label", F.explode("lean").alias("token")).distinct()
    return tags.join(resolve(tags.select("token").distinct(), decls), "token", "left").select("label", "token", "decl")


def uses_audit(nodes: DataFrame, decls: DataFrame, citations: DataFrame) -> DataFrame:
    """What nodes declare to use against what their declarations cite.

    ``closure``: a tag without a declaration; ``empty``: nothing cited though formalised nodes are
    used (then nothing else is said of the node); ``declared``: used, but in no closure;
    ``inferred``: cited directly by the declarations, but not reached by any path of uses;
    ``unused``: a lemma that neither a node uses nor a declaration cites.
    """
    node = cut(by_label(nodes))
    owned = cut(node_declarations(node, decls))
    audited = node.filter("leanok AND size(lean) > 0").select("label", "kind")
    lost = _finding(owned.join(audited, "label", "left_semi").filter("decl IS NULL"), "closure", "advisory", "label", F.col("token"))
    found = owned.filter("decl IS NOT NULL").select("label", "decl").distinct()
    mine = cut(found.join(audited, "label"))
    reached = graph.closure(citations, mine.select(F.col("decl").alias("node")).distinct())
    inferred = cut(mine.join(reached, mine.decl == reached.source).select("label", F.col("node").alias("target")).distinct())
    uses = node.select("label", F.explode("uses").alias("used")).distinct().join(node.filter("size(lean) > 0").select(F.col("label").alias("used")), "used", "left_semi")
    located = mine.select("label").distinct()
    nothing = located.join(inferred, "label", "left_anti").join(audited.filter(F.col("kind").isin(*STATEMENT_KINDS)), "label", "left_semi")
    empty = cut(nothing.join(uses, "label").groupBy("label").agg(F.count("*").alias("n")))
    rest = located.join(empty, "label", "left_anti")
    # a used node is met if one of its declarations is in the closure; without any it cannot be judged
    targets = uses.join(rest, "label", "left_semi").join(found.withColumnRenamed("label", "used").withColumnRenamed("decl", "target"), "used")
    met = targets.join(inferred, ["label", "target"], "left_semi").select("label", "used").distinct()
    gaps = targets.select("label", "used").distinct().join(met, ["label", "used"], "left_anti")
    walked = graph.closure(edges(node), rest.select(F.col("label").alias("node"))).select(F.col("source").alias("label"), F.col("node").alias("owner"))
    owner = found.groupBy(F.col("decl").alias("target")).agg(F.min("label").alias("owner"))
    direct = mine.join(rest, "label", "left_semi").join(citations, mine.decl == citations.src).select("label", F.col("dst").alias("target")).distinct().join(owner, "target").filter("owner <> label")
    routes = direct.join(walked, ["label", "owner"], "left_anti")
    used = node.select(F.explode("uses").alias("label")).distinct()
    lemmas = node.filter("kind = 'lem'").select("label").join(used, "label", "left_anti")
    live = found.join(citations.select(F.col("dst").alias("decl")).distinct(), "decl", "left_semi").select("label").distinct()
    parts = [
        lost, _finding(empty, "empty", "advisory", "label", F.concat(F.col("n").cast("string"), F.lit(" formalised nodes are used, nothing is cited"))),
        _finding(gaps, "declared", "advisory", "label", F.col("used")), _finding(routes, "inferred", "advisory", "label", F.concat_ws(" ", "target", "owner")),
        _finding(lemmas.join(live, "label", "left_anti"), "unused", "advisory", "label", ""),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def audit_totals(nodes: DataFrame, decls: DataFrame) -> DataFrame:
    """One row: distinct labels used and distinct declarations cited by nodes."""
    used = nodes.select(F.explode("uses").alias("x")).agg(F.count_distinct("x").alias("labels_used"))
    return used.crossJoin(node_declarations(nodes, decls).agg(F.count_distinct("decl").alias("decls_cited")))


def stale_export(stamped: DataFrame, current: DataFrame) -> DataFrame:
    """Sources (path, sha) of an export that changed, went or came since; an export without any is unstamped."""
    j = stamped.withColumnRenamed("sha", "was").join(current.withColumnRenamed("sha", "now"), "path", "full")
    what = F.when(F.col("was").isNull(), "came").when(F.col("now").isNull(), "went").when(F.col("was") != F.col("now"), "changed")
    return _finding(j.withColumn("w", what).filter("w IS NOT NULL"), "export", "advisory", "path", F.col("w"))


# -- the trust base that a paper states --------------------------------------------------

#: The words that open and close a stated trust base, and those that give a status.
REGION = "trust base"
CHECKED = r"(?i)machine[- ]checked|formali[sz]ed|verified in lean"
UNCHECKED = r"(?i)(?:not|un)[- ]?(?:yet )?(?:machine[- ]checked|formali[sz]ed)|prose only|on paper only"


def _regions(text: str) -> list[tuple]:
    """(line, problem, row, row_line): rows of marked regions; or a mark without its partner."""
    marks = [(m.start(), m.end(), m.group(1)) for m in re.finditer(rf"%[ \t]*{REGION}:[ \t]*(begin|end)\b[^\n]*", text)]
    out, k = [], 0
    line = lambda at: text.count("\n", 0, at) + 1
    while k < len(marks):
        start, end, what = marks[k]
        if what == "end":
            out.append((line(start), "end without begin", None, None))
        elif k + 1 < len(marks) and marks[k + 1][2] == "end":
            at = end
            for row in re.split(r"(\\\\|\\item\b|\n[ \t]*\n)", text[end : marks[k + 1][0]]):
                if row.strip():
                    out.append((line(start), None, row, line(at + len(row) - len(row.lstrip()))))
                at += len(row)
            k += 1
        else:
            out.append((line(start), "begin without end", None, None))
        k += 1
    return out


def regions(texts: DataFrame) -> DataFrame:
    return parsed(texts, _regions, "line int, problem string, row string, row_line int")


def label_map(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """``ref, label``: a label stands for itself, that of a marked paper statement for the nodes its mark names."""
    own = nodes.filter("label IS NOT NULL").select(F.col("label").alias("ref"), "label").distinct()
    first = Window.partitionBy("statement_label").orderBy("path", "pos")
    said = marks.filter("statement_label IS NOT NULL").withColumn("k", F.dense_rank().over(first)).filter("k = 1").select(F.col("statement_label").alias("ref"), "label")
    return own.unionByName(said.join(own.select("ref"), "ref", "left_anti").join(own.select("label"), "label", "left_semi").select("ref", "label").distinct())


def stated_status(found: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of a trust base that give a statement another status than its node has."""
    bare = F.regexp_replace("row", r"\\(?:label|ref|[cC]ref|eqref|autoref)\{[^}]*\}", " ")
    rows = found.filter("row IS NOT NULL").withColumns({"no": bare.rlike(UNCHECKED), "yes": F.regexp_replace(bare, UNCHECKED, " ").rlike(CHECKED), "at": F.concat_ws(":", "path", F.col("row_line").cast("string"))})
    refs = rows.select("at", "yes", "no", F.explode(fn.reference_labels(F.col("row"))).alias("ref"))
    both = _finding(refs.filter("yes AND no").select("at").distinct(), "trust-base", "advisory", "at", "both checked and not")
    told = refs.filter("yes <> no").join(labels, "ref", "left")
    unknown = _finding(told.filter("label IS NULL"), "trust-base", "advisory", "at", F.concat(F.col("ref"), F.lit(" is no node")))
    judged = told.join(by_label(nodes).select("label", "leanok"), "label").filter("yes <> leanok")
    wrong = _finding(judged, "trust-base", "fatal", "at", F.concat(F.col("ref"), F.when(F.col("yes"), F.lit(" is not formalised")).otherwise(F.lit(" is formalised"))))
    problem = _finding(found.filter("problem IS NOT NULL").withColumn("at", F.concat_ws(":", "path", F.col("line").cast("string"))), "trust-base", "fatal", "at", F.col("problem"))
    return both.unionAll(unknown).unionAll(wrong).unionAll(problem)


def axioms_of(tokens: DataFrame, printed: DataFrame, decls: DataFrame) -> DataFrame:
    """``token, axioms``: what was printed (decl, axioms) for the declaration a tag names: exact, then resolved, then the only short name."""
    full = tokens.select("token").distinct().join(resolve(tokens.select("token").distinct(), decls), "token", "left")
    p = printed.select(F.col("decl").alias("name"), "axioms").filter("axioms IS NOT NULL").dropDuplicates(["name"])
    short = p.groupBy(F.substring_index("name", ".", -1).alias("last")).agg(F.count("*").alias("n"), F.first("axioms").alias("short_axioms")).filter("n = 1").drop("n")
    j = full.join(p.select(F.col("name").alias("token"), F.col("axioms").alias("exact")), "token", "left").join(p.select(F.col("name").alias("decl"), F.col("axioms").alias("by_name")), "decl", "left")
    j = j.withColumn("last", F.substring_index("token", ".", -1)).join(short, "last", "left")
    return j.select("token", F.coalesce("exact", "by_name", "short_axioms").alias("axioms"))


def entries_read(nodes: DataFrame, printed: DataFrame, decls: DataFrame, entries: DataFrame, boundary: DataFrame) -> DataFrame:
    """``label, entry, unread``: ledger entries that a node rests on.

    A formalised node rests on the entries that ground the boundary names (name) in the axioms printed
    for its declarations; ``unread`` is a declaration without printed axioms. Any other node rests on
    the entries of the accepted nodes that it reaches ahead of the boundary.
    """
    node = cut(by_label(nodes))
    lean = node.filter("leanok AND size(lean) > 0").select("label", F.explode("lean").alias("token"))
    known = lean.join(axioms_of(lean.select("token"), printed, decls), "token", "left")
    last = lambda c: F.substring_index(c, ".", -1)
    ground = entries.select(F.col("id").alias("entry"), F.explode("lean").alias("decl")).select("entry", last("decl").alias("short")).distinct()
    names = boundary.select(last("name").alias("short")).distinct()
    read = known.filter("axioms IS NOT NULL").select("label", F.explode("axioms").alias("ax")).select("label", last("ax").alias("short")).join(names, "short", "left_semi").join(ground, "short")
    unread = known.filter("axioms IS NULL").select("label", F.lit(None).cast("string").alias("entry"), F.col("token").alias("unread"))
    other = node.filter("NOT (leanok AND size(lean) > 0)").select(F.col("label").alias("node"))
    accepted = node.filter("status = 'A'")
    ahead = graph.bfs(edges(node), other, accepted.select(F.col("label").alias("node"))).select("source", "node").unionByName(other.select(F.col("node").alias("source"), "node"))
    via = ahead.join(accepted.select(F.col("label").alias("node"), F.explode("ledger").alias("entry")), "node").select(F.col("source").alias("label"), "entry")
    none = F.lit(None).cast("string").alias("unread")
    return read.select("label", "entry", none).unionByName(via.select("label", "entry", none)).unionByName(unread).distinct()


def stated_entries(found: DataFrame, labels: DataFrame, read: DataFrame, entries: DataFrame, boundary: DataFrame) -> DataFrame:
    """Entries that a trust base names and none of its statements rests on, and the reverse.

    Where axioms of a statement could not be read, only the reverse is a finding.
    """
    rows = found.filter("row IS NOT NULL").withColumn("at", F.concat_ws(":", "path", F.col("line").cast("string")))
    plain = F.replace(F.regexp_replace("row", r"\\(?:label|ref|[cC]ref|eqref|autoref)\{[^}]*\}", " "), F.lit("\\_"), F.lit("_"))
    words = rows.select("at", F.explode(F.regexp_extract_all(plain, F.lit(r"(?U)([\w'-]+)"), 1)).alias("word")).distinct()
    last = F.substring_index("name", ".", -1)
    ground = entries.select(F.col("id").alias("entry"), F.explode("lean").alias("name")).select("entry", last.alias("word")).join(boundary.select(last.alias("word")).distinct(), "word", "left_semi")
    named = words.filter(F.col("word").rlike(f"^(?:{LEDGER_KEY})$")).select("at", F.col("word").alias("entry")).unionByName(words.join(ground, "word").select("at", "entry")).distinct()
    refs = rows.select("at", F.explode(fn.reference_labels(F.col("row"))).alias("ref")).distinct().join(labels, "ref").select("at", "label").distinct()
    rests = cut(refs.join(read, "label"))
    blind = rests.filter("unread IS NOT NULL").select("at").distinct()
    on = rests.filter("entry IS NOT NULL").select("at", "entry").distinct()
    left = _finding(named.join(on, ["at", "entry"], "left_anti").join(blind, "at", "left_anti"), "trust-base", "fatal", "at", F.concat(F.col("entry"), F.lit(" is named but not read")))
    gone = _finding(on.join(named, ["at", "entry"], "left_anti"), "trust-base", "fatal", "at", F.concat(F.col("entry"), F.lit(" is read but not named")))
    return left.unionAll(gone).unionAll(_finding(rests.filter("unread IS NOT NULL").select("at", "unread").distinct(), "trust-base", "advisory", "at", F.concat(F.lit("no axioms of "), F.col("unread"))))


# -- manifest ----------------------------------------------------------------------------


def quoted(text: Column) -> Column:
    """A string as JSON; ``null`` for null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def manifest(nodes: DataFrame, entries: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """``label, json``: each node with all keys, nulls kept; of repeated labels the last node counts.

    ``rendered``: label, title_md, statement_md, proof_md where a renderer ran; ``rendered_sha``
    covers what a derived block shows, as a JSON array with a blank after each comma and colon. References of the ledger carry the primary citation of an
    own entry; those of a module carry its name.
    """
    node = by_label(nodes)
    refs = node.select("label", F.posexplode("ledger").alias("at", "ref"))
    has = F.contains("ref", F.lit(":"))
    refs = refs.withColumns({"module": F.when(has, F.substring_index("ref", ":", 1)), "id": F.when(has, F.regexp_replace("ref", "^[^:]*:", "")).otherwise(F.col("ref"))})
    refs = refs.join(entries.select(F.col("id").alias("eid"), "citekey", "anchor"), (F.col("id") == F.col("eid")) & F.col("module").isNull(), "left")
    pair = lambda c: F.concat(F.lit(f'"{c}": '), quoted(F.col(c)))
    members = lambda *names: F.concat(F.lit("{"), F.concat_ws(", ", *[pair(c) for c in names]), F.lit("}"))
    own, of_module = members("id", "citekey", "anchor"), members("id", "module", "citekey", "anchor")
    listed = refs.withColumn("j", F.when(F.col("module").isNull(), own).otherwise(of_module)).groupBy("label").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "j"))), lambda e: e["j"]), ", "), F.lit("]")).alias("ledger_json"))
    j = node.join(listed, "label", "left").withColumn("ledger_json", F.coalesce("ledger_json", F.lit("[]")))
    if rendered is None:
        j = j.withColumns({c: F.lit(None).cast("string") for c in ("title_md", "statement_md", "proof_md")})
    else:
        j = j.join(rendered.select("label", "title_md", "statement_md", "proof_md"), "label", "left")
    text = lambda c: quoted(F.col(c))
    flag = lambda c: F.col(c).cast("string")
    lean = F.concat(F.lit("["), F.array_join(F.transform("lean", quoted), ", "), F.lit("]"))
    shown = F.concat(F.lit("["), F.concat_ws(", ", text("env"), text("title_md"), text("status"), F.col("ledger_json"), lean, flag("leanok"), flag("notready"), text("statement_md"), text("proof_md")), F.lit("]"))
    j = j.withColumn("rendered_sha", F.when(F.col("statement_md").isNotNull(), fn.sha12(shown)))
    j = j.withColumns({"statement_sha": fn.sha12(F.col("statement")), "proof_sha": F.when(F.col("proof").isNotNull(), fn.sha12(F.col("proof")))})
    head = F.to_json(F.struct("kind", "env", "title", "status"), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct("leanok", "notready", "lean", "uses", "statement", "statement_sha", "proof", "proof_sha", "statement_md", "proof_md", "rendered_sha", "title_md"), {"ignoreNullFields": "false"})
    return j.select("label", F.concat(F.left(head, F.length(head) - 1), F.lit(',"ledger":'), F.col("ledger_json"), F.lit(","), F.substring(tail, F.lit(2), F.length(tail))).alias("json"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: numbers of findings by severity and the exit status, 1 if any is fatal."""
    return findings.agg(F.count_if(F.col("severity") == "fatal").alias("fatal"), F.count_if(F.col("severity") == "advisory").alias("advisory")).withColumn("exit_status", (F.col("fatal") > 0).cast("int"))


def report(findings: DataFrame) -> DataFrame:
    """``line`` of each finding in the order of a report: advisory before fatal, then by tag and subject."""
    said = F.concat(F.when(F.col("severity") == "fatal", "  FAIL [").otherwise("  advisory ["), F.col("tag"), F.lit("] "), F.col("subject"), F.lit(": "), F.col("detail"))
    return findings.orderBy("severity", "tag", "subject", "detail").select(said.alias("line"))
