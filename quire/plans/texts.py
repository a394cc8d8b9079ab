"""Queries over texts: lines, words, features, references, digests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators.review import normal
from quire.session import table

T = table


def scan_lines(s, d):
    b = T(s, d, "block").filter("text IS NOT NULL")
    return b.select("block_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("block_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("n_chars"))


def word_counts(s, d):
    return T(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(fn.words(F.col("text"))).alias("n_words"))


def feature_rates(s, d):
    """Prose features by language, per thousand words."""
    docs = T(s, d, "documents").filter("text IS NOT NULL")
    rows = docs.select(F.coalesce("lang", F.lit("none")).alias("lang"), F.size(fn.words(F.col("text"))).alias("w"), *[c.alias(k) for k, c in fn.feature_counts(F.col("text")).items()])
    sums = rows.groupBy("lang").agg(F.sum("w").alias("n_words"), *[F.sum(k).alias(k) for k in fn.FAMILIES])
    return sums.select("lang", "n_words", *[F.round(fn.per_thousand(F.col(k), F.col("n_words")), 6).alias(k) for k in fn.FAMILIES])


def feature_verdicts(s, d):
    """Features of each source against two baselines: papers and all texts."""
    docs = T(s, d, "documents").filter("text IS NOT NULL")
    rows = docs.select("source", F.size(fn.words(F.col("text"))).alias("w"), *[c.alias(k) for k, c in fn.feature_counts(F.col("text")).items()])
    long = rows.groupBy("source").agg(F.sum("w").alias("w"), *[F.sum(k).alias(k) for k in fn.FAMILIES])
    long = long.select("source", "w", F.stack(F.lit(len(fn.FAMILIES)), *[x for k in fn.FAMILIES for x in (F.lit(k), F.col(k))]).alias("feature", "n"))
    genre = long.groupBy("feature").agg(fn.per_thousand(F.sum("n"), F.sum("w")).alias("genre"))
    author = long.filter("source = 'paper'").select("feature", fn.per_thousand(F.col("n"), F.col("w")).alias("author"))
    j = long.join(genre, "feature").join(author, "feature")
    return j.select("source", "feature", "n", fn.verdict(F.col("n"), fn.per_thousand(F.col("n"), F.col("w")), F.col("author"), F.col("genre")).alias("verdict"))


#: Words of the longest running head, and how often it must repeat.
HEAD_WORDS, HEAD_REPEATS = 12, 3


def running_heads(s, d):
    """Short blocks (between empty lines) that a document repeats, numbers alike."""
    blocks = T(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n\n")).alias("b")).select("doc_id", F.regexp_replace("b", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("b"))
    short = blocks.filter((F.length("b") > 0) & (F.regexp_count("b", F.lit("[A-Za-z]{2,}")) <= HEAD_WORDS))
    return short.groupBy("doc_id", F.regexp_replace("b", "[0-9]+", "#").alias("head")).agg(F.count("*").alias("n")).filter(F.col("n") >= HEAD_REPEATS)


def dup_by_hash(s, d):
    """Texts that occur under several ids, by digest, the least id first."""
    docs = T(s, d, "documents").filter("text IS NOT NULL")
    return docs.groupBy(fn.sha12(F.col("text")).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


def control_chars(s, d):
    docs = T(s, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", fn.control_chars(F.col("text")).alias("n")).filter("n > 0")


def reference_edges(s, d):
    """Labels that documents refer to."""
    docs = T(s, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.explode(fn.reference_labels(F.col("text"))).alias("label"))


def reference_orphans(s, d):
    """Labels set by documents that none refers to, and labels referred to that none sets."""
    docs = T(s, d, "documents").filter("text IS NOT NULL")
    put = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\\label\{([^}]+)\}"), 1)).alias("label")).distinct()
    got = reference_edges(s, d).select("label").distinct()
    return put.join(got, "label", "left_anti").withColumn("side", F.lit("orphan")).unionByName(got.join(put, "label", "left_anti").withColumn("side", F.lit("dangling")))


def section_tree(s, d):
    """Headings of markdown documents with their level and the level-two heading they stand under."""
    lines = T(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    # carried over all lines of a heading only: the others are filtered first
    heads = lines.filter(F.col("line").rlike(r"^#{1,6} ")).withColumn("level", F.length(F.regexp_extract("line", r"^(#+)", 1)))
    under = F.last(F.when(F.col("level") <= 2, F.col("line")), ignorenulls=True).over(w)
    return heads.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "level", under.alias("under"))


#: Words of an anchor that are looked up, by the least number of words of the anchor.
_LOOKED_UP = ((8, 6), (6, 4), (5, 3), (4, 2), (3, 1))
#: Runs of anchors that may be broadcast; more are joined by shuffle.
_MOST_RUNS = 2_000_000


def _once_in(anchors, docs):
    """``anchor, doc_id`` where the whole text of ``anchor`` occurs exactly once in ``text``; both are normalised.

    The words of an anchor but its first and last are whole words of a text that holds it: the first
    of them are looked up among all runs of as many words. Anchors of one or two words have none and
    are compared with every text.
    """
    words = F.split("anchor", " ")
    size = F.coalesce(*[F.when(F.size(words) >= least, k) for least, k in _LOOKED_UP])
    keyed = anchors.withColumn("run", F.xxhash64(F.concat_ws(" ", F.slice(words, 2, size)))).filter(size.isNotNull())
    sizes = [r.k for r in anchors.select(size.alias("k")).distinct().collect() if r.k]
    sought = keyed.select("run").distinct()
    few = sought.limit(_MOST_RUNS + 1).count() <= _MOST_RUNS
    run = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("held") - k + 1, F.lit(1))), lambda at: F.xxhash64(F.concat_ws(" ", F.slice("held", at, F.lit(k)))))
    # divided once: an expression within transform is computed for each element
    split = docs.select("doc_id", F.split("text", " ").alias("held")).filter("size(held) > 0")
    runs = split.select("doc_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[run(k) for k in sorted(sizes)]))).alias("run"))
    runs = runs.join(sought.hint("broadcast" if few else "merge"), "run", "left_semi")
    likely = runs.join(keyed.hint("merge"), "run").select("doc_id", "anchor").distinct().join(docs.hint("merge"), "doc_id")
    short = docs.join(anchors.filter(size.isNull()).hint("shuffle_replicate_nl"), F.expr("contains(text, anchor)")).select("doc_id", "anchor", "text")
    once = F.expr("contains(text, anchor) AND length(text) - length(replace(text, anchor, '')) = length(anchor)")
    return likely.unionByName(short).filter(once).select("anchor", "doc_id").distinct()


def anchor_in_documents(s, d):
    """Flags with each document in which their whole anchor occurs exactly once, case and white space alike.

    No table holds the files that flags name. Blank anchors occur nowhere.
    """
    f = T(s, d, "flag").dropDuplicates(["flag_id"]).select("flag_id", normal(F.col("anchor")).alias("anchor")).filter("anchor <> ''")
    docs = T(s, d, "documents").filter("text IS NOT NULL").select("doc_id", normal(F.col("text")).alias("text"))
    return f.join(_once_in(f.select("anchor").distinct(), docs), "anchor").select("flag_id", "doc_id")


def resident_load(s, d):
    """Files, words, lines and estimated tokens of each source of documents; the estimate is rounded per file."""
    docs = T(s, d, "documents").filter("text IS NOT NULL")
    return docs.groupBy("source").agg(
        F.count("*").alias("files"), F.sum(F.size(F.filter(F.split("text", "[ \\n\\t\\r]+"), lambda w: w != ""))).alias("words"),
        F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(fn.tokens(F.col("text"))).cast("bigint").alias("tokens"),
    )


#: Fixed value: characters of a tail and the prose after it that are looked up in the base version.
SWALLOWED_CHARS = 60


def swallowed_prose(current, base):
    """``path, line_no, tail``: comment lines that took in prose of the base version (path, text both).

    An added comment line that prose follows directly; some tail of its words and that prose stand as
    unbroken prose in the base version. Tails that end a sentence or a group end the search. The
    longest tail is given.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    lines = current.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    w = W.partitionBy("path").orderBy("pos")
    lines = lines.withColumn("next", F.coalesce(F.lead("line").over(w), F.lit(""))).filter(r"ltrim(line) LIKE '\%%' AND NOT ltrim(next) LIKE '\%%' AND trim(next) <> ''")
    before = base.select("path", F.explode(F.split("text", "\r\n|\n|\r")).alias("line"))
    added = lines.withColumn("line", F.rtrim("line")).join(before.select("path", F.rtrim("line").alias("line")).distinct(), ["path", "line"], "left_anti")
    words = F.split(F.trim(F.substr(F.ltrim("line"), F.lit(2))), " ")
    tails = added.withColumn("words", words).filter("size(words) > 1").select("path", "pos", "next", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("words")), lambda k: squeezed(F.concat_ws(" ", F.slice("words", k, F.size("words")))))).alias("k", "tail"))
    # the tails of a line are the ends of it: they all end alike
    tails = tails.filter(~F.endswith("tail", F.lit(".")) & ~F.endswith("tail", F.lit("}")) & (F.col("tail") != ""))
    prose = base.select("path", squeezed(F.array_join(F.filter(F.split("text", "\r\n|\n|\r"), lambda x: ~F.ltrim(x).startswith("%")), " ")).alias("prose"))
    hit = tails.join(prose, "path").filter(F.contains("prose", F.left(squeezed(F.concat_ws(" ", "tail", "next")), F.lit(SWALLOWED_CHARS))))
    return hit.groupBy("path", (F.col("pos") + 1).alias("line_no")).agg(F.min_by("tail", "k").alias("tail"))


def swallowed_lines(s, d):
    """Comment lines of documents that took in prose of the last version before them (the same path at another revision)."""
    docs = T(s, d, "documents").filter("text IS NOT NULL AND path IS NOT NULL AND source IN ('paper', 'blueprint')")
    w = W.partitionBy("path").orderBy("added_at", "doc_id")
    versions = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.lag("text").over(w).alias("base")).filter("base IS NOT NULL")
    found = swallowed_prose(versions.select(F.col("id").alias("path"), "text"), versions.select(F.col("id").alias("path"), F.col("base").alias("text")))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"), "tail")


def decl_normal_forms(s, d):
    """Declarations with one normal form of their anchor, counted over members."""
    c = T(s, d, "clone_decl").filter("anchor.text IS NOT NULL")
    return c.groupBy(fn.sha12(fn.alpha_normal(F.col("anchor.text"))).alias("form")).agg(F.count_distinct("member").alias("members"), F.count("*").alias("n")).filter("n > 1")


def release_order(s, d):
    """Versions that changelogs name, each with the greatest one before it."""
    docs = T(s, d, "documents").filter("source = 'changelog' AND text IS NOT NULL")
    tag = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^## (\d+\.\d+\.\d+)"), 1)).alias("tag")).distinct()
    v = tag.withColumn("v", fn.version(F.col("tag"))).withColumn("series", F.col("v.major"))
    return v.select("tag", F.lag("tag").over(W.partitionBy("series").orderBy("v.minor", "v.patch")).alias("before"))


_WORDS = r"[A-Za-z\x{00C0}-\x{024F}][A-Za-z\x{00C0}-\x{024F}…''’\-]+"
_NW = f"len(regexp_extract_all(text, '{_WORDS}'))"


def _family(name: str) -> str:
    pattern = fn.FAMILIES[name].replace("'", "''")
    return f"len(regexp_extract_all(lower(text), '{pattern}'))"


_SUMS = ", ".join(f"sum({_family(k)})::BIGINT AS {k}" for k in fn.FAMILIES)
_LINES = "unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)))"
_LABELS = """unnest(list_distinct(list_filter(list_transform(string_split(array_to_string(regexp_extract_all(regexp_replace(replace(text, '\\%', ''), '%[^\\n]*', '', 'g'), '\\\\(?:[cC]ref|[vV]ref|autoref|eqref|ref)\\*?\\{([^}]*)\\}', 1), ','), ','), lambda x: trim(x)), lambda x: x <> ''))) AS label"""

QUERIES = {
    f.__name__: f
    for f in (scan_lines, word_counts, feature_rates, feature_verdicts, running_heads, dup_by_hash, control_chars, reference_edges, reference_orphans, section_tree, anchor_in_documents, resident_load, swallowed_lines, decl_normal_forms, release_order)
}
SQL = {
    "scan_lines": "SELECT block_id, unnest(generate_series(1, len(string_split(text, chr(10)))))::INT AS line_no, length(unnest(string_split(text, chr(10))))::INT AS n_chars FROM block WHERE text IS NOT NULL",
    "word_counts": f"SELECT doc_id, {_NW}::INT AS n_words FROM documents WHERE text IS NOT NULL",
    "feature_rates": f"SELECT lang, n_words, {', '.join(f'round(CASE WHEN n_words > 0 THEN 1000.0 * {k} / n_words ELSE 0 END, 6)::DOUBLE AS {k}' for k in fn.FAMILIES)} FROM (SELECT coalesce(lang, 'none') AS lang, sum({_NW})::BIGINT AS n_words, {_SUMS} FROM documents WHERE text IS NOT NULL GROUP BY 1)",
    "feature_verdicts": f"""WITH l AS (SELECT source, sum({_NW})::BIGINT AS w, {_SUMS} FROM documents WHERE text IS NOT NULL GROUP BY 1),
      u AS (UNPIVOT l ON {", ".join(fn.FAMILIES)} INTO NAME feature VALUE n),
      g AS (SELECT feature, 1000.0 * sum(n) / sum(w) AS genre FROM u GROUP BY 1), a AS (SELECT feature, 1000.0 * n / w AS author FROM u WHERE source = 'paper'),
      o AS (SELECT source, feature, n, CASE WHEN author <= 0 THEN n > 0 ELSE 1000.0 * n / w / author >= 2 END AS over_a, CASE WHEN genre <= 0 THEN n > 0 ELSE 1000.0 * n / w / genre >= 2 END AS over_g FROM u JOIN g USING (feature) JOIN a USING (feature))
      SELECT source, feature, n, CASE WHEN n < 5 THEN '' WHEN over_a AND over_g THEN 'BOTH' WHEN over_a THEN 'voice' WHEN over_g THEN 'genre' ELSE '' END AS verdict FROM o""",
    "running_heads": f"""SELECT doc_id, regexp_replace(b, '[0-9]+', '#', 'g') AS head, count(*)::BIGINT AS n
      FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10) || chr(10))), ' ' || chr(9) || chr(10) || chr(13)) AS b FROM documents WHERE text IS NOT NULL)
      WHERE b <> '' AND len(regexp_extract_all(b, '[A-Za-z]{{2,}}')) <= 12 GROUP BY 1, 2 HAVING count(*) >= 3""",
    "dup_by_hash": "SELECT left(sha256(text), 12) AS sha, min(doc_id) AS first_id, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "control_chars": "SELECT * FROM (SELECT doc_id, len(regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '[\\x00-\\x09\\x0B-\\x1F]'))::INT AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0",
    "reference_edges": f"SELECT doc_id, {_LABELS} FROM documents WHERE text IS NOT NULL",
    "reference_orphans": f"""WITH g AS (SELECT DISTINCT label FROM (SELECT {_LABELS} FROM documents WHERE text IS NOT NULL)),
      p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\\\label\\{{([^}}]+)\\}}', 1)) AS label FROM documents WHERE text IS NOT NULL)
      SELECT label, 'orphan' AS side FROM p WHERE label NOT IN (SELECT label FROM g) UNION ALL SELECT label, 'dangling' FROM g WHERE label NOT IN (SELECT label FROM p)""",
    "section_tree": """WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line,
        unnest(generate_series(0, len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) - 1)) AS pos FROM documents WHERE text IS NOT NULL),
      h AS (SELECT *, length(regexp_extract(line, '^(#+)', 1))::INT AS level FROM l WHERE regexp_matches(line, '^#{1,6} '))
      SELECT doc_id, pos::BIGINT AS pos, level, last_value(CASE WHEN level <= 2 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS under FROM h""",
    "anchor_in_documents": """WITH f AS (SELECT flag_id, trim(regexp_replace(lower(any_value(anchor)), '\\s+', ' ', 'g')) AS a FROM flag GROUP BY flag_id),
      t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS x FROM documents WHERE text IS NOT NULL),
      m AS (SELECT DISTINCT a, doc_id FROM (SELECT DISTINCT a FROM f WHERE a <> '') JOIN t ON contains(x, a) WHERE len(string_split(x, a)) = 2)
      SELECT flag_id, doc_id FROM f JOIN m USING (a)""",
    "resident_load": "SELECT source, count(*)::BIGINT AS files, sum(len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda w: w <> '')))::BIGINT AS words, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "swallowed_lines": """WITH v AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY path ORDER BY added_at, doc_id) AS base FROM documents WHERE text IS NOT NULL AND path IS NOT NULL AND source IN ('paper', 'blueprint')),
      s AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS cur, string_split(replace(replace(base, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS old FROM v WHERE base IS NOT NULL),
      p AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(old, lambda x: NOT starts_with(ltrim(x), '%')), ' '), '\\s+', ' ', 'g')) AS prose FROM s),
      l AS (SELECT doc_id, prose, unnest(generate_series(1, len(cur))) AS k, cur, list_transform(old, lambda x: rtrim(x)) AS old FROM p),
      c AS (SELECT doc_id, prose, k, string_split(trim(ltrim(cur[k])[2:]), ' ') AS words, coalesce(cur[k + 1], '') AS nxt FROM l
        WHERE starts_with(ltrim(cur[k]), '%') AND NOT list_contains(old, rtrim(cur[k])) AND NOT starts_with(ltrim(coalesce(cur[k + 1], '')), '%') AND trim(coalesce(cur[k + 1], '')) <> ''),
      t AS (SELECT doc_id, prose, k, nxt, unnest(generate_series(2, len(words))) AS j, words FROM c WHERE len(words) > 1),
      u AS (SELECT doc_id, prose, k, nxt, j, trim(regexp_replace(array_to_string(words[j:], ' '), '\\s+', ' ', 'g')) AS tail FROM t)
      SELECT doc_id, k::INT AS line_no, min_by(tail, j) AS tail FROM u WHERE tail <> '' AND NOT ends_with(tail, '.') AND NOT ends_with(tail, '}')
        AND contains(prose, left(trim(regexp_replace(tail || ' ' || nxt, '\\s+', ' ', 'g')), 60)) GROUP BY 1, 2""",
    "decl_normal_forms": """SELECT left(sha256(array_to_string(list_transform(regexp_extract_all(anchor.text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}''.]+|\\S'), lambda t: CASE WHEN regexp_full_match(t, '[a-z]') THEN 'ν' ELSE t END), ' ')), 12) AS form,
      count(DISTINCT member)::BIGINT AS members, count(*)::BIGINT AS n FROM clone_decl WHERE anchor.text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "release_order": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?m)^## ([0-9]+\\.[0-9]+\\.[0-9]+)', 1)) AS tag FROM documents WHERE source = 'changelog' AND text IS NOT NULL),
      v AS (SELECT tag, split_part(tag, '.', 1)::INT AS a, split_part(tag, '.', 2)::INT AS b, split_part(tag, '.', 3)::INT AS c FROM t)
      SELECT tag, lag(tag) OVER (PARTITION BY a ORDER BY b, c) AS before FROM v""",
}
