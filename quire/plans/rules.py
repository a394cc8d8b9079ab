"""Integrity rules over the node, ledger, marker and declaration tables.

Each rule gives rows ``tag, severity, subject, detail``. Rules join, filter or walk; none
gathers rows at the driver. Severity is ``fatal`` or ``advisory``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import graph
from quire.session import cut
from quire.sources.statements import ASSIGNMENT, CLAIMS, LEDGER_KEY


def _finding(df: DataFrame, tag: str, severity: str | Column, subject: str | Column, detail: str | Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select(F.lit(tag).alias("tag"), lit(severity).alias("severity"), subject.cast("string").alias("subject"), lit(detail).alias("detail"))


def _proof_of_record() -> Column:
    return F.trim(F.coalesce("proof", F.lit("")))


def by_label(nodes: DataFrame) -> DataFrame:
    """One node for each label: the last one counts. Nodes without a label are left out."""
    w = Window.partitionBy("label").orderBy(F.desc("path"), F.desc("pos"))
    return nodes.filter("label IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def declared(nodes: DataFrame, decls: DataFrame) -> DataFrame:
    """Formalised nodes whose declarations are not there, by the last part of their names."""
    names = decls.select(F.substring_index("name", ".", -1).alias("last")).distinct()
    tags = nodes.filter("leanok").select(F.coalesce("label", "env").alias("subject"), F.explode("lean").alias("decl")).withColumn("last", F.substring_index("decl", ".", -1))
    missing = _finding(tags.join(names, "last", "left_anti"), "lean", "fatal", "subject", F.concat(F.col("decl"), F.lit(" is not declared")))
    bare = _finding(nodes.filter("leanok AND size(lean) = 0"), "lean", "advisory", F.coalesce("label", "env"), "formalised without a declaration")
    both = _finding(nodes.filter("leanok AND notready"), "lean", "advisory", F.coalesce("label", "env"), "formalised and not ready")
    return missing.unionAll(bare).unionAll(both)


def flags_agree(nodes: DataFrame) -> DataFrame:
    proved = nodes.filter("label IS NOT NULL AND proof IS NOT NULL")
    over = _finding(proved.filter("proof_leanok AND NOT leanok"), "leanok", "fatal", "label", "the proof is formalised, the statement is not")
    under = _finding(proved.filter("leanok AND NOT proof_leanok AND NOT notready").filter(F.col("kind").isin(*CLAIMS)), "leanok", "advisory", "label", "the statement is formalised, its proof is not marked")
    return over.unionAll(under)


def ledger_refs(texts: DataFrame) -> DataFrame:
    """``ref``: what whole documents cite of the ledger, comments included: by macro, or in words as older texts do."""
    macro = F.regexp_extract_all("text", F.lit(r"\\ledger\{([^}]+)\}"), 1)
    prose = F.regexp_extract_all("text", F.lit(r"ledger~?\s*(" + LEDGER_KEY + ")"), 1)
    return texts.select(F.explode(F.array_union(macro, prose)).alias("ref")).distinct()


def ledger(refs: DataFrame, entries: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """References (``ref``, of ``ledger_refs``) that no entry has, or whose entry has no citation line.

    ``required``: module, id, has_cite_line of the ledgers of included modules; a reference
    ``module:id`` resolves there only.
    """
    named = refs.withColumn("module", F.when(F.contains("ref", F.lit(":")), F.substring_index("ref", ":", 1))).withColumn("id", F.regexp_replace("ref", "^[^:]*:", ""))
    own = entries.select(F.lit(None).cast("string").alias("module"), "id", "has_cite_line")
    known = own if required is None else own.unionByName(required.select("module", "id", "has_cite_line"))
    known = known.select(F.col("module").alias("m"), F.col("id").alias("i"), "has_cite_line")
    j = named.join(known, F.col("module").eqNullSafe(F.col("m")) & (F.col("id") == F.col("i")), "left")
    modules = known.select(F.col("m").alias("included")).distinct()
    j = j.join(modules, F.col("module") == F.col("included"), "left")
    detail = F.when(F.col("module").isNotNull() & F.col("included").isNull(), "the module is not included").when(F.col("has_cite_line").isNull(), "no entry").when(~F.col("has_cite_line"), "no citation line")
    return _finding(j.withColumn("d", detail).filter("d IS NOT NULL"), "ledger", "fatal", "ref", F.col("d"))


def status(nodes: DataFrame) -> DataFrame:
    none = _finding(nodes.filter("label IS NOT NULL AND status IS NULL"), "status", "fatal", "label", "no status")
    accepted = nodes.filter("label IS NOT NULL AND status = 'A'")
    clause = F.substring_index("status_note", ASSIGNMENT, -1)
    missing = _finding(accepted.filter(~F.contains("status_note", F.lit(ASSIGNMENT))), "assign", "fatal", "label", "no assignment clause")
    vague = _finding(accepted.filter(F.contains("status_note", F.lit(ASSIGNMENT)) & ~clause.rlike(LEDGER_KEY)), "assign", "fatal", "label", "the assignment names no entry")
    return none.unionAll(missing).unionAll(vague)


def render_safe(nodes: DataFrame, safe: DataFrame) -> DataFrame:
    """Commands of statements and proofs that are neither defined nor vetted (``safe``: name)."""
    parts = nodes.select(F.coalesce("label", "env").alias("subject"), F.explode(F.array(F.struct(F.lit("statement").alias("part"), F.col("statement").alias("t")), F.struct(F.lit("proof").alias("part"), F.col("proof").alias("t")))).alias("p"))
    used = parts.select("subject", "p.part", F.explode(F.array_distinct(F.regexp_extract_all("p.t", F.lit(r"\\([A-Za-z]+)"), 1))).alias("name"))
    return _finding(used.join(safe.select("name").distinct(), "name", "left_anti"), "render", "fatal", "subject", F.concat_ws(" ", F.lit("command"), "name", F.lit("in"), "part"))


def edges(nodes: DataFrame) -> DataFrame:
    return by_label(nodes).select(F.col("label").alias("src"), F.posexplode("uses").alias("pos", "dst"))


def dependencies(nodes: DataFrame) -> DataFrame:
    """Formalised nodes that rest on statements proved nowhere (fatal) or on paper only (advisory)."""
    node = cut(by_label(nodes))
    links = edges(node)
    starts = nodes.filter("leanok AND label IS NOT NULL").select(F.col("label").alias("node"))
    claim = node.filter(F.col("kind").isin(*CLAIMS) & (F.col("status") == "T") & ~F.col("leanok"))
    unproved = claim.filter(_proof_of_record() == "").select(F.col("label").alias("node"))
    on_paper = claim.filter(_proof_of_record() != "").select(F.col("label").alias("node"))
    walked = graph.bfs(links, starts)
    ahead = graph.bfs(links, starts, node.filter("status = 'A'").select(F.col("label").alias("node")))
    hit = walked.join(unproved, "node").groupBy("node").agg(F.count("*").alias("n"), F.min_by("path", F.struct("dist", "source")).alias("path"))
    fatal = _finding(hit, "depend", "fatal", "node", F.concat(F.col("n").cast("string"), F.lit(" rest on it: "), F.array_join("path", " -> ")))
    all_on = walked.join(on_paper, "node").groupBy("node").agg(F.count("*").alias("n"))
    direct = ahead.join(on_paper, "node").groupBy("node").agg(F.count("*").alias("ahead"))
    debt = all_on.join(direct, "node", "left")
    return fatal.unionAll(_finding(debt, "depend", "advisory", "node", F.concat(F.coalesce("ahead", F.lit(0)).cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" rest on it ahead of the boundary"))))


def interfaces(nodes: DataFrame) -> DataFrame:
    """Formalised nodes that name an entry whose interface node they do not reach."""
    node = cut(by_label(nodes))
    faces = node.filter("status = 'A' AND proof IS NULL AND size(status_ledger) = 1").select(F.col("status_ledger")[0].alias("entry"), F.col("label").alias("node"))
    asks = node.filter("leanok").select(F.col("label").alias("source"), F.explode("status_ledger").alias("entry"))
    reach = graph.closure(edges(node), asks.select(F.col("source").alias("node"))).unionByName(asks.select("source", F.col("source").alias("node")).distinct())
    met = reach.join(faces, "node").select("source", "entry").distinct()
    return _finding(asks.join(met, ["source", "entry"], "left_anti"), "iface", "advisory", "source", F.concat(F.lit("does not reach the interface of "), F.col("entry")))


def shared(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Marked paper statements against their blueprint nodes: missing, drifted, or a stale pin."""
    node = by_label(nodes).select(F.col("label"), F.col("shared_statement").alias("theirs"), "shared_sha", "shared_proof_sha", F.col("shared_proof").alias("their_proof"), F.col("uses").alias("their_uses"))
    j = marks.join(node, "label", "left")
    missing = _finding(j.filter("shared_sha IS NULL"), "shared", "fatal", "label", "no such node")
    rest = j.filter("shared_sha IS NOT NULL")
    same = F.col("shared_statement").eqNullSafe(F.col("theirs"))
    outcome = (
        F.when(F.col("shared_statement").isNull(), "no statement follows the mark").when(same, F.lit(None).cast("string"))
        .when(F.col("pinned") == F.col("shared_sha"), F.lit(None).cast("string")).when(F.col("pinned").isNotNull(), "the blueprint changed since it was pinned").otherwise("the texts differ and nothing is pinned")
    )
    drift = _finding(rest.withColumn("o", outcome).filter("o IS NOT NULL"), "drift", F.when(F.col("pinned").isNotNull(), "fatal").otherwise("advisory"), "label", F.col("o"))
    proof = rest.filter("shared_proof IS NOT NULL AND their_proof IS NOT NULL AND shared_proof <> their_proof AND NOT (proof_pinned <=> shared_proof_sha)")
    unused = rest.filter("proof_refs IS NOT NULL").select("label", F.array_except("their_uses", "proof_refs").alias("never")).filter("size(never) > 0")
    return missing.unionAll(drift).unionAll(_finding(proof, "proof", "advisory", "label", "the proofs differ")).unionAll(_finding(unused, "uses", "advisory", "label", F.array_join("never", " ")))


def check(nodes: DataFrame, decls: DataFrame, entries: DataFrame, marks: DataFrame, safe: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All findings of the blueprint rules. ``texts``: the whole documents, for what they cite of the ledger; without them only the nodes count."""
    refs = ledger_refs(texts) if texts is not None else nodes.select(F.explode("ledger").alias("ref")).distinct()
    parts = [declared(nodes, decls), flags_agree(nodes), render_safe(nodes, safe), ledger(refs, entries), status(nodes), dependencies(nodes), interfaces(nodes), shared(nodes, marks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def statistics(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes"), F.count_if("leanok").alias("formalised"), F.count_if("proof_leanok").alias("formalised_proofs"), F.count_if(F.col("kind").isin(*CLAIMS) & (F.col("status") == "T") & ~F.col("leanok") & (_proof_of_record() == "")).alias("unproved"))


def paper(tables: dict[str, DataFrame], bib: DataFrame) -> DataFrame:
    """References without a label, statement labels never referred to, citations without an entry or a DOI."""
    refs, labels, cites = tables["refs"], tables["labels"], tables["cites"]
    dangling = _finding(refs.select("label").distinct().join(labels, "label", "left_anti"), "ref", "fatal", "label", "no such label")
    orphan = _finding(labels.filter(F.substring_index("label", ":", 1).isin(*CLAIMS)).join(refs, "label", "left_anti"), "orphan", "advisory", "label", "never referred to")
    # without any bibliography citations cannot be judged: the check then says nothing
    some = bib.limit(1).select(F.lit(True).alias("some"))
    judged = cites.select("key").distinct().crossJoin(F.broadcast(some)).join(bib, "key", "left")
    return dangling.unionAll(orphan).unionAll(_finding(judged.filter("has_doi IS NULL"), "cite", "fatal", "key", "no such entry")).unionAll(_finding(judged.filter("NOT has_doi"), "doi", "advisory", "key", "no DOI"))


def manifest(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """``label, json``: each node as a JSON object with all keys, nulls kept."""
    cited = nodes.filter("label IS NOT NULL").select("label", F.posexplode_outer("ledger").alias("at", "id")).join(entries.select("id", "citekey", "anchor"), "id", "left")
    listed = cited.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "id", "citekey", "anchor"))).alias("l")).select("label", F.filter("l", lambda e: e["at"].isNotNull()).alias("sources"))
    j = by_label(nodes).join(listed, "label", "left")
    return j.select("label", F.to_json(F.struct("kind", "title", "status", "leanok", "lean", "uses", "statement", "shared_sha", "proof", "shared_proof_sha", "sources"), {"ignoreNullFields": "false"}).alias("json"))


def demand(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The worklist ``wanted`` (pos, label) against the nodes: proved ones dropped, order kept."""
    node = by_label(nodes).select("label", "leanok", "status")
    state = F.when(F.col("status").isNull(), "not in the blueprint").when(F.col("status") == "A", "accepted").otherwise("open")
    return wanted.join(node, "label", "left").filter(~F.coalesce("leanok", F.lit(False))).select("pos", "label", state.alias("state"))


def trust(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Trusted names that no ledger entry mentions, and entries that mention none."""
    said = entries.select("id", F.explode_outer("lean").alias("decl")).withColumn("last", F.substring_index("decl", ".", -1))
    own = names.select("name", F.substring_index("name", ".", -1).alias("last"))
    ungrounded = _finding(own.join(said, "last", "left_anti"), "trust", "fatal", "name", "grounded by no entry")
    silent = _finding(entries.filter("size(lean) = 0"), "trust", "advisory", "id", "names no declaration")
    return ungrounded.unionAll(silent)


def axioms(pins: DataFrame, names: DataFrame) -> DataFrame:
    """Pinned axiom lists that go beyond the trusted names; pins without a guard."""
    open_pin = _finding(pins.filter("NOT guarded"), "pin", "advisory", "decl", "not guarded")
    listed = pins.filter("axioms IS NOT NULL").select("decl", F.explode("axioms").alias("name"))
    return open_pin.unionAll(_finding(listed.join(names.select("name"), "name", "left_anti"), "axiom", "fatal", "decl", F.col("name")))


def resolve(tokens: DataFrame, decls: DataFrame) -> DataFrame:
    """Each token with the declaration it means: the full name, else the only one with that last part, else null."""
    full = decls.select("fullname").distinct()
    short = full.groupBy(F.substring_index("fullname", ".", -1).alias("last")).agg(F.count("*").alias("n"), F.min("fullname").alias("only")).filter("n = 1")
    j = tokens.join(full, tokens.token == full.fullname, "left").withColumn("last", F.substring_index("token", ".", -1)).join(short, "last", "left")
    return j.select("token", F.coalesce("fullname", "only").alias("decl"))


#: Marks of who wrote a text and what they are, and the mark of a line that may have them.
IDENTITY = (
    (r"github\.com", "repository URL"),
    (r"@[A-Za-z0-9._%+-]+\.[A-Za-z]{2,}", "e-mail address"),
    (r"\\thanks\b", "funding or affiliation"),
    (r"\\email\b", "e-mail macro"),
    (r"\\institute\b", "affiliation"),
    (r"\bour (earlier|previous|prior) (work|paper|article)\b", "first-person self-citation"),
    (r"\bin our\b.*\bwe (show|prove|introduce)\b", "first-person self-citation"),
    (r"\bas we (showed|proved|argued) in\b", "first-person self-citation"),
)
EXEMPT = "anonymity-ok"


def folded(text: Column) -> Column:
    """The text without accents: letters that are composed with marks become plain ones."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}", "")


_COMPOSED = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(k))) > 1]
_ACCENTED, _PLAIN = "".join(a for a, _ in _COMPOSED), "".join(b for _, b in _COMPOSED)


def anonymity(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``path, line_no, what``: lines that give an author away, by each mark of identity they hold.

    ``names``: name, as written; it is looked for as written and without accents, in words of any
    case. Arguments of citations are no text. Lines with the mark of exemption and names in
    bibliographies (paths in .bib) do not count.
    """
    open_lines = lines.filter(~F.contains("line", F.lit(EXEMPT)))
    plain = F.regexp_replace("line", r"\\(?:ss|no)?cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", "")
    what = F.array_distinct(F.array_compact(F.array(*[F.when(plain.rlike(f"(?i){p}"), F.lit(k)) for p, k in IDENTITY])))
    marked = open_lines.select("path", "line_no", F.explode(what).alias("what"))
    words = open_lines.filter(~F.endswith("path", F.lit(".bib"))).select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(r"(?U)\w[\w'-]*"), 0))).alias("name"))
    forms = names.select(F.explode(F.array(F.lower("name"), F.lower(folded(F.col("name"))))).alias("name")).distinct()
    named = words.join(forms, "name", "left_semi").select("path", "line_no", F.lit("identifying name").alias("what"))
    return marked.unionByName(named).distinct()


def sync_directions(theirs: DataFrame, ours: DataFrame, recorded: DataFrame) -> DataFrame:
    """``path, direction`` from three digest tables (path, sha): who changed a file since it was recorded."""
    j = theirs.withColumnRenamed("sha", "t").join(ours.withColumnRenamed("sha", "o"), "path", "full").join(recorded.withColumnRenamed("sha", "r"), "path", "full")
    direction = (
        F.when(F.col("o").isNull() & F.col("t").isNull(), "gone").when(F.col("o").isNull(), "missing here").when(F.col("t").isNull(), "missing there")
        .when(F.col("o") == F.col("t"), "same").when(F.col("r") == F.col("o"), "update").when(F.col("r") == F.col("t"), "local change").otherwise("conflict")
    )
    return j.select("path", direction.alias("direction"))
