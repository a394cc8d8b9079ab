"""Rules over whole repositories: instruction files, homes of declarations, boundary checks, releases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import graph

DEPTH = 4
#: What all files that are read at the start may hold, and the tokens of a long file.
BUDGET_WORDS, BUDGET_LINES, LONG_TOKENS = 2000, 200, 5000


# -- instruction files -------------------------------------------------------------------


def instruction_imports(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst, pos``: files that a line names with ``@path`` outside fences and code, if they exist."""
    plain = F.regexp_replace("line", "`[^`]*`", "")
    named = lines.filter("NOT fenced").select(F.col("path").alias("src"), "line_no", F.posexplode(F.regexp_extract_all(plain, F.lit(r"(?:^|\s)@([\w./~-]+)"), 1)).alias("k", "name"))
    folder = F.regexp_extract("src", r"^(.*/)?[^/]*$", 1)
    target = F.concat(folder, F.regexp_replace("name", r"[.,;:]+$", ""))
    edge = named.select("src", target.alias("dst"), (F.col("line_no").cast("bigint") * 1000 + F.col("k")).alias("pos"))
    return edge.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "pos")


def resident(texts: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Files that are read with the roots, up to a depth; their load, and whether a budget is passed."""
    met = graph.bfs(edges, roots, max_rounds=DEPTH).select("source", "node").unionByName(roots.select(F.col("node").alias("source"), "node"))
    t = F.col("text")
    load = met.join(texts.withColumnRenamed("path", "node"), "node").groupBy("source").agg(
        F.count("*").alias("files"), F.sum(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))).alias("words"), F.sum(F.size(F.split(t, "\n"))).alias("lines"), F.sum(fn.tokens(t)).cast("bigint").alias("tokens")
    )
    return load.withColumn("is_over", (F.col("words") > BUDGET_WORDS) | (F.col("lines") > BUDGET_LINES))


def dated_lines(lines: DataFrame) -> DataFrame:
    """Lines outside fences that carry a date in running text; a bold opener and code do not count."""
    plain = F.regexp_replace(F.regexp_replace("line", r"^\s*[-*]?\s*\*\*[^*]*\*\*", ""), "`[^`]*`", "")
    found = lines.filter(~F.col("fenced") & plain.rlike(r"\b20\d\d-\d\d-\d\d\b"))
    listed = found.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line_no")).alias("at"))
    return listed.select("path", "n", F.slice("at", 1, 6).alias("first_lines"))


def read_pointers(sentences: DataFrame, texts: DataFrame) -> DataFrame:
    """Sentences that ask to read a long file in full; the first for each file and target."""
    asks = sentences.filter(F.col("sentence").rlike(r"(?i)\bread\b") & F.col("sentence").rlike(r"(?i)\b(?:first|before|in full)\b"))
    after = F.regexp_extract("sentence", r"(?is)\bread\b(.*)$", 1)
    named = asks.select("path", "pos", F.explode(F.regexp_extract_all(after, F.lit(r"([\w./-]+\.(?:md|tex|lean))"), 1)).alias("target"))
    long = texts.filter(fn.tokens(F.col("text")) > LONG_TOKENS).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("leaf")).distinct()
    hit = named.withColumn("leaf", F.regexp_extract("target", r"([^/]+)$", 1)).join(long, "leaf", "left_semi")
    return hit.groupBy("path", "target").agg(F.min("pos").alias("pos"))


# -- homes -------------------------------------------------------------------------------


#: From what has to be mended first to what is in order.
HOME_CLASSES = ("not in the record", "module without entry", "owed", "home elsewhere", "no home needed", "at home")


def homes(nodes: DataFrame, decls: DataFrame, modules: DataFrame) -> DataFrame:
    """``label, class``: where the declarations of a node have their home.

    ``decls``: name, module; ``modules``: module, home (home, none, owed), labels. The order
    of the classes decides when declarations differ: the first of ``HOME_CLASSES``.
    """
    tags = nodes.filter("label IS NOT NULL").select("label", F.explode("lean").alias("name"))
    j = tags.join(decls.select("name", "module").distinct(), "name", "left").join(modules, "module", "left")
    what = (
        F.when(F.col("module").isNull(), "not in the record").when(F.col("home").isNull(), "module without entry").when(F.col("home") == "owed", "owed")
        .when(F.col("home") == "none", "no home needed").when(F.array_contains("labels", F.col("label")), "at home").otherwise("home elsewhere")
    )
    place = F.array_position(F.array(*[F.lit(c) for c in HOME_CLASSES]), what)
    return j.groupBy("label").agg(F.min_by(what, place).alias("class"), F.count_distinct(what).alias("n_classes"))


def home_counts(classes: DataFrame) -> DataFrame:
    """``class, n`` of every class, those without a label too. The labels are the rows of ``classes``."""
    every = classes.sparkSession.createDataFrame([(c,) for c in HOME_CLASSES], "class string")
    return every.join(classes.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def owed(modules: DataFrame, decls: DataFrame) -> DataFrame:
    """Modules whose home is still owed, with their number of declarations."""
    owing = modules.filter("home = 'owed'").select("module").distinct()
    return owing.join(decls.groupBy("module").agg(F.count_distinct("name").alias("n")), "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("n"))


# -- boundary ----------------------------------------------------------------------------


def shadows(decls: DataFrame, standard: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Local declarations named like a standard notion; acknowledgements of what no longer is."""
    short = decls.select("fullname", F.substring_index("fullname", ".", -1).alias("name")).distinct()
    hit = short.join(standard.select("name").distinct(), "name", "left_semi")
    new = hit.join(acknowledged.select("name"), "name", "left_anti").select("name", F.lit("shadow").alias("what"))
    stale = acknowledged.select("name").distinct().join(hit.select("name"), "name", "left_anti").select("name", F.lit("stale acknowledgement").alias("what"))
    return new.unionAll(stale).distinct()


def unprobed(headline: DataFrame, probes: DataFrame) -> DataFrame:
    """Headline declarations that no probe mentions by full or short name.

    Probes are cut into names, so the check is a join of names and not of every pair.
    """
    said = probes.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)([\w'.]+)"), 1)).alias("name")).distinct()
    names = headline.select("fullname", F.explode(F.array_distinct(F.array("fullname", F.substring_index("fullname", ".", -1)))).alias("name"))
    met = names.join(said, "name", "left_semi").select("fullname").distinct()
    return headline.select("fullname").distinct().join(met, "fullname", "left_anti")


def imported_by_others(imports: DataFrame, isolated: DataFrame) -> DataFrame:
    """Modules that must stand alone and that another module imports."""
    return imports.join(isolated.select(F.col("module").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("module"), F.col("src").alias("importer"))


# -- releases ----------------------------------------------------------------------------


def carried(imports: DataFrame, roots: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """Modules a release carries: all that its roots import, with the first importer. An import of a library root means all of it."""
    edges = imports.select("src", "dst", "pos")
    if libraries is not None:
        edges = edges.unionByName(libraries.select(F.col("root").alias("src"), F.col("module").alias("dst"), F.lit(0).alias("pos")))
    return graph.first_parents(edges, roots)


def compared(ours: DataFrame, released: DataFrame) -> DataFrame:
    """Modules of two revisions (module, text): same, differing, added, gone; line ends do not count."""
    flat = lambda c: F.regexp_replace(c, r"\r\n?", "\n")
    j = ours.withColumnRenamed("text", "o").join(released.withColumnRenamed("text", "r"), "module", "full")
    return j.select("module", F.when(F.col("r").isNull(), "added").when(F.col("o").isNull(), "gone").when(flat("o") == flat("r"), "same").otherwise("differs").alias("outcome"))


def redacted(texts: DataFrame, folders: list[str]) -> DataFrame:
    """Texts with local folders replaced, and how often."""
    out, n = F.col("text"), F.lit(0)
    for folder in sorted(folders, key=len, reverse=True):
        # a longer folder is replaced first; what it left is not counted again
        n = n + (F.length(out) - F.length(F.replace(out, F.lit(folder), F.lit("")))) / len(folder)
        out = F.replace(out, F.lit(folder), F.lit("<path>"))
    return texts.select("path", out.alias("text"), n.cast("int").alias("n"))


def dangling_uses(nodes: DataFrame) -> DataFrame:
    """Labels that nodes use and none has, with the files that use them."""
    used = nodes.select("path", F.explode("uses").alias("label"))
    missing = used.join(nodes.filter("label IS NOT NULL").select("label"), "label", "left_anti")
    return missing.groupBy("label").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def divergence(pairs: DataFrame, context: int = 72) -> DataFrame:
    """``key, at, ours, theirs``: the first character in which two texts (key, a, b) differ, with what follows; equal texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a is None or b is None or a == b:
                    continue
                low, high = 0, min(len(a), len(b))
                while low < high:  # the longest common start, by halving
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
                rows.append((key, low, a[low : low + context], b[low : low + context]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["key", "at", "ours", "theirs"])

    return pairs.select(F.col("key").cast("string"), "a", "b").mapInArrow(run, "key string, at int, ours string, theirs string")


def resolve_includes(includes: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, package, rev`` of everything that trust files include, each package once, the nearest first.

    ``includes``: src, package, rev; ``known``: package, rev, src (the trust file there).
    """
    step = includes.join(known.withColumnRenamed("src", "inner"), ["package", "rev"], "left")
    place = F.row_number().over(Window.partitionBy("src").orderBy("package", "rev"))
    edges = step.filter("inner IS NOT NULL").withColumn("pos", place).select("src", F.col("inner").alias("dst"), "pos")
    met = graph.bfs(edges, roots).select(F.col("source").alias("root"), F.col("node").alias("src"), "dist").unionByName(roots.select(F.col("node").alias("root"), F.col("node").alias("src"), F.lit(0).alias("dist")))
    found = met.join(step.select("src", "package", "rev", F.col("inner").isNotNull().alias("is_known")), "src")
    return found.groupBy("root", "package").agg(F.min_by(F.struct("rev", "is_known"), F.struct("dist", "src", "rev")).alias("e")).select("root", "package", "e.rev", "e.is_known")
