"""The readers of statements, declarations and prose run over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import repair
from quire.plans import corpus, papers, releases, rules
from quire.session import cut, spread, table
from quire.sources import lean, prose, records, statements, texts


def _texts(s, d, *sources):
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    if sources:
        docs = docs.filter(F.col("source").isin(*sources))
    return spread(docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text"), "path")


def blueprint_nodes(s, d):
    """Statements of papers and blueprints with their label and the digest of their text."""
    return statements.nodes(_texts(s, d, "paper", "blueprint")).select("path", "pos", "env", "label", "kind", F.size("proof_refs").alias("n_proof_refs"), "shared_sha")


def statement_labels(s, d):
    """Statements by environment and kind of label."""
    return statements.nodes(_texts(s, d, "paper", "blueprint")).filter("label IS NOT NULL").groupBy("env", "kind").agg(F.count("*").alias("n"))


def blueprint_findings(s, d):
    """What the rules say about the statements of blueprints, by rule; none of them is formalised or has a status."""
    nodes = cut(statements.nodes(_texts(s, d, "paper", "blueprint")))
    safe = table(s, d, "documents").filter("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(r"\\([a-z]+)\{"), 1)).alias("name")).distinct()
    found = rules.status(nodes).unionAll(rules.flags_agree(nodes)).unionAll(rules.render_safe(nodes, safe)).unionAll(rules.dependencies(nodes))
    return found.groupBy("tag", "severity").agg(F.count("*").alias("n"))


def paper_findings(s, d):
    """References without a label and statement labels never referred to, over papers and blueprints."""
    tables = statements.paper_tables(_texts(s, d, "paper", "blueprint"))
    none = statements.bib_entries(_texts(s, d, "bibliography"))
    return rules.paper(tables, none).groupBy("tag", "severity").agg(F.count("*").alias("n"))


def lean_declarations(s, d):
    return lean.declarations(_texts(s, d, "lean")).select("path", "pos", "kind", "fullname", F.length("stmt").alias("stmt_chars"), F.length("proof").alias("proof_chars"))


def lean_kinds(s, d):
    return lean.declarations(_texts(s, d, "lean")).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def prose_blocks(s, d):
    """Paragraphs of typeset texts by kind."""
    return prose.blocks(_texts(s, d, "paper", "blueprint")).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def markdown_blocks(s, d):
    return prose.blocks(_texts(s, d, "adr", "handoff", "changelog", "wiki", "review"), markdown=True).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def prose_measures(s, d):
    """Words, sentences, upper median and share of long sentences of each typeset text."""
    return prose.measures(prose.blocks(_texts(s, d, "paper", "blueprint")))


def zone_register(s, d):
    """Em-dashes, semicolons and words by zone over typeset texts."""
    lines = texts.lines(_texts(s, d, "paper", "blueprint"))
    return prose.register(lines).filter("path IS NULL").select("zone", "em_dashes", "semicolons", "words")


def inline_dates(s, d):
    """Documents with dates in running text outside fenced blocks."""
    found = corpus.dated_lines(texts.lines(_texts(s, d, "adr", "handoff", "wiki")))
    return found.select("path", "n", F.concat_ws(",", F.transform("first_lines", lambda x: x.cast("string"))).alias("first_lines"))


def identity_lines(s, d):
    """Lines of papers that name one of the persons whom reviewers' texts name."""
    lines = texts.lines(_texts(s, d, "paper"))
    names = table(s, d, "documents").filter("text IS NOT NULL AND source = 'review'").select(F.explode(F.regexp_extract_all("text", F.lit(r"all been read by ([A-Z]\w+)"), 1)).alias("name")).distinct()
    return rules.anonymity(lines, names).groupBy("what").agg(F.count("*").alias("n"))


def unmarked_statements(s, d):
    """Statements of papers and blueprints over which no mark of sharing stands."""
    docs = _texts(s, d, "paper", "blueprint")
    return papers.unmarked(docs, papers.declared_environments(docs))


def changelog_dates(s, d):
    """Versions of changelogs with the day of their heading, as a date and in words."""
    found = releases.changelog_dates(_texts(s, d, "changelog"))
    return found.select("path", "tag", F.col("day").cast("string").alias("day"), releases.long_date(F.col("day")).alias("said"))


def newest_versions(s, d):
    """The newest version of each path, by its digest."""
    docs = table(s, d, "documents").filter("text IS NOT NULL AND path IS NOT NULL").select("path", "rev", "text", "added_at")
    return records.at_revision(docs).select("path", fn.sha12(F.col("text")).alias("sha"))


def residue_ratios(s, d):
    """Share of words of one letter by source of documents."""
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    return repair.residue_ratio(docs, "source").select("source", F.round("residue", 6).alias("residue"))


def feature_ratios(s, d):
    """Features of each language over their rate in all texts, as text."""
    blocks = table(s, d, "documents").filter("text IS NOT NULL").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.lit("prose").alias("kind"), "text", F.lit("all").alias("all"))
    rates, base = repair.feature_table(blocks, "lang"), repair.feature_table(blocks, "all").select("feature", F.col("rate").alias("base"))
    return rates.join(base, "feature").select("lang", "feature", fn.ratio(F.col("rate"), F.col("base")).alias("ratio"))


def repaired_documents(s, d):
    """What was mended in each document: repeated heads, broken words, split paragraphs; only documents with anything to mend."""
    return repair.repaired(_texts(s, d)).filter("heads + joined + reflowed > 0").select("path", "heads", "joined", "reflowed", F.length("text").alias("n_chars"))


def lean_flags(s, d):
    """Declarations that are left open, say nothing or lack a doc, by kind of fault."""
    found = releases.sorries(lean.declarations(_texts(s, d, "lean")))
    return found.agg(F.count("*").alias("n"), F.count_if("is_sorry").alias("open"), F.count_if("is_vacuous").alias("vacuous"), F.count_if(~F.col("has_doc")).alias("without_doc"))


_IN = "(SELECT text FROM documents WHERE source IN ('paper', 'blueprint') AND text IS NOT NULL)"
_ENVS = "|".join(statements.ENVIRONMENTS)
QUERIES = {f.__name__: f for f in (blueprint_nodes, statement_labels, blueprint_findings, paper_findings, lean_declarations, lean_kinds, prose_blocks, markdown_blocks, prose_measures, zone_register, inline_dates, identity_lines, unmarked_statements, changelog_dates, newest_versions, residue_ratios, feature_ratios, repaired_documents, lean_flags)}
_LINE = "unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)))"
_FEATURE_SUMS = ", ".join(f"""sum(len(regexp_extract_all(lower(text), '{p.replace("'", "''")}')))::DOUBLE AS {k}""" for k, p in fn.FAMILIES.items())
_FEATURE_WORDS = "sum(len(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{024F}][A-Za-z\\x{00C0}-\\x{024F}…''’\\-]+')))::DOUBLE AS w"
_NAMES = ", ".join(fn.FAMILIES)
SQL = {
    "unmarked_statements": f"""SELECT 'doc/' || doc_id AS path, regexp_extract(x, 'begin\\{{(\\w+)', 1) AS env, regexp_extract(x, 'label\\{{([^}}]+)', 1) AS label, k::INT AS line
      FROM (SELECT doc_id, unnest(regexp_extract_all(l, '\\\\begin\\{{(?:{_ENVS})\\}}\\\\label\\{{[^}}]+\\}}')) AS x, k
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents WHERE source IN ('paper', 'blueprint') AND text IS NOT NULL))""",
    "changelog_dates": """SELECT 'doc/' || doc_id AS path, split_part(h, ' — ', 1) AS tag, split_part(h, ' — ', 2)::DATE::VARCHAR AS day, strftime(split_part(h, ' — ', 2)::DATE, '%B %-d, %Y') AS said
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^## (v?\\d+\\.\\d+\\.\\d+ — \\d{4}-\\d{2}-\\d{2})\\b', 1)) AS h FROM documents WHERE source = 'changelog' AND text IS NOT NULL)""",
    "newest_versions": "SELECT path, left(sha256(arg_max(text, (added_at, rev))), 12) AS sha FROM documents WHERE text IS NOT NULL AND path IS NOT NULL GROUP BY path",
    "residue_ratios": """SELECT source, round(CASE WHEN sum(len(w)) > 0 THEN sum(len(list_filter(w, lambda x: length(x) = 1))) / sum(len(w)) ELSE 0 END, 6)::DOUBLE AS residue
      FROM (SELECT source, regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{024F}][A-Za-z\\x{00C0}-\\x{024F}''’-]*') AS w FROM documents WHERE text IS NOT NULL) GROUP BY source""",
    "feature_ratios": f"""WITH l AS (SELECT coalesce(lang, 'none') AS lang, {_FEATURE_WORDS}, {_FEATURE_SUMS} FROM documents WHERE text IS NOT NULL GROUP BY 1),
      u AS (UNPIVOT l ON {_NAMES} INTO NAME feature VALUE n), b AS (SELECT feature, 1000.0 * sum(n) / sum(w) AS base FROM u GROUP BY 1),
      r AS (SELECT lang, feature, CASE WHEN w > 0 THEN 1000.0 * n / w ELSE 0 END AS rate, base FROM u JOIN b USING (feature))
      SELECT lang, feature, CASE WHEN base <= 0 THEN CASE WHEN rate > 0 THEN 'new' ELSE '-' END WHEN rate / base > 99 THEN '>99x' ELSE printf('%.1fx', rate / base) END AS ratio FROM r""",
    "statement_labels": f"""SELECT regexp_extract(x, '^.begin\\{{(\\w+)', 1) AS env, split_part(regexp_extract(x, 'label\\{{([^}}]+)', 1), ':', 1) AS kind, count(*)::BIGINT AS n
      FROM (SELECT unnest(regexp_extract_all(text, '\\\\begin\\{{(?:{_ENVS})\\}}\\\\label\\{{[^}}]+\\}}')) AS x FROM {_IN}) GROUP BY 1, 2""",
    "lean_kinds": """SELECT split_part(x, ' ', 1) AS kind, count(*)::BIGINT AS n, count(DISTINCT split_part(x, ' ', 2))::BIGINT AS names
      FROM (SELECT unnest(regexp_extract_all(text, '(?m)^((?:""" + "|".join(lean.KINDS) + """) [^\\s:({\\[]+)', 1)) AS x FROM documents WHERE source = 'lean' AND text IS NOT NULL) GROUP BY 1""",
}
