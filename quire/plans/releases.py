"""Releases: dates and versions, parts of an article by phase, printed axioms against a guard, tags to modules, pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.rules import _finding
from quire.sources import statements
from quire.sources.texts import parsed

#: Phases of an article in order, its parts, and the phase from which each part must exist.
PHASES = ("idea", "draft", "review", "released")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def long_date(day: Column) -> Column:
    """A date as ``Month D, YYYY``."""
    return F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"))


def changelog_dates(texts: DataFrame) -> DataFrame:
    """``path, tag, day``: versions of changelogs with the day their heading names."""
    heads = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^## (v?\d+\.\d+\.\d+ — \d{4}-\d{2}-\d{2})\b"), 1)).alias("h"))
    return heads.select("path", F.substring_index("h", " — ", 1).alias("tag"), F.try_to_date(F.substring_index("h", " — ", -1)).alias("day")).filter("day IS NOT NULL")


def deposit_date(flag: Column, changelog: Column, today: Column) -> Column:
    return F.coalesce(flag, changelog, today)


def parts_state(listed: DataFrame, present: DataFrame, required_from: DataFrame, phase: str) -> DataFrame:
    """Parts (part) that the phase requires and that are missing, and parts that are there and not listed.

    ``required_from``: part, phase from which it must exist.
    """
    reached = [p for p in PHASES if PHASES.index(p) <= PHASES.index(phase)]
    due = listed.select("part").distinct().join(required_from.filter(F.col("phase").isin(*reached)).select("part"), "part", "left_semi")
    missing = _finding(due.join(present.select("part"), "part", "left_anti"), "phase", "fatal", "part", F.lit(f"required in phase {phase}"))
    return missing.unionAll(_finding(present.select("part").distinct().join(listed.select("part"), "part", "left_anti"), "parts", "fatal", "part", "there, but not listed"))


def most_advanced(modules: DataFrame, by: str = "article") -> DataFrame:
    """The most advanced phase of the modules (``by``, phase)."""
    place = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    return modules.filter(place > 0).groupBy(by).agg(F.max_by("phase", place).alias("phase"))


def newest_source(sources: DataFrame, pdfs: DataFrame) -> DataFrame:
    """``article, newest, is_stale``: the newest source (path, changed_at) of each article, and whether it is newer than its PDF."""
    new = sources.groupBy("article").agg(F.max_by("path", F.struct("changed_at", "path")).alias("newest"), F.max("changed_at").alias("at"))
    j = new.join(pdfs.groupBy("article").agg(F.max("changed_at").alias("printed_at")), "article", "left")
    return j.select("article", "newest", F.coalesce(F.col("at") > F.col("printed_at"), F.lit(True)).alias("is_stale"))


def axiom_lines(texts: DataFrame, within: str | None = None) -> DataFrame:
    """``decl, line, axioms`` of printed axiom lists, white space collapsed; ``within``: only in that environment. The last line of a declaration counts."""
    source = texts.select("path", "text")
    if within:
        source = source.select("path", F.array_join(F.regexp_extract_all("text", F.lit(rf"(?s)\\begin\{{{within}\}}(.*?)\\end\{{{within}\}}"), 1), "\n").alias("text"))
    said = source.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)('[^'\s]+'*'\s+depends\s+on\s+axioms:\s*\[[^\]]*\])"), 1)).alias("pos", "line"))
    rows = said.select("path", "pos", F.regexp_extract("line", r"^'(\S+)'\s", 1).alias("decl"), F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"))
    rows = rows.groupBy("decl").agg(F.max_by("line", F.struct("path", "pos")).alias("line"))
    return rows.withColumn("axioms", F.filter(F.transform(F.split(F.regexp_extract("line", r"\[([^\]]*)\]", 1), ","), lambda a: F.trim(a)), lambda a: a != ""))


def axiom_mismatches(paper: DataFrame, guard: DataFrame) -> DataFrame:
    """Lines (decl, line) that the paper prints and the guard lacks or prints otherwise; more lines of the guard are none."""
    j = paper.select("decl", "line").join(guard.select("decl", F.col("line").alias("guarded")), "decl", "left")
    what = F.when(F.col("guarded").isNull(), "not printed by the guard").when(F.col("guarded") != F.col("line"), "printed otherwise by the guard")
    return _finding(j.withColumn("w", what).filter("w IS NOT NULL"), "axioms", "fatal", "decl", F.col("w"))


def tag_modules(tags: DataFrame, decls: DataFrame, libraries: list[str], shared: list[str]) -> DataFrame:
    """``tag, module``: modules that declare the short name of a tag (``decls``: fullname, module).

    A name of a shared namespace is of no module here. If several modules have the short name, those
    count that declare it under the tag's innermost namespace, else all; then those of the library
    that the tag begins with, else all.
    """
    own = tags.select("tag").distinct()
    for package in shared:
        own = own.filter(~F.startswith("tag", F.lit(package + ".")))
    parts = F.split("tag", r"\.")
    inner = F.when(F.size(parts) > 2, F.element_at(parts, -2))
    library = F.coalesce(*[F.when(F.startswith("tag", F.lit(lib + ".")), F.lit(lib)) for lib in libraries]) if libraries else F.lit(None).cast("string")
    known = decls.select(F.substring_index("fullname", ".", -1).alias("short"), "fullname", "module").distinct()
    hit = own.withColumns({"short": F.substring_index("tag", ".", -1), "inner": inner, "library": library}).join(known, "short")
    fits = F.regexp_extract("fullname", r"([^.]+)\.[^.]+$", 1)
    hit = hit.groupBy("tag", "inner", "library", "module").agg(F.bool_or(fits == F.col("inner")).alias("fits"))
    w = Window.partitionBy("tag")
    hit = hit.withColumns({"n": F.count("*").over(w), "any": F.max(F.coalesce("fits", F.lit(False)).cast("int")).over(w)})
    hit = hit.filter(F.col("inner").isNull() | (F.col("n") == 1) | (F.col("any") == 0) | F.col("fits"))
    in_library = F.coalesce(F.startswith("module", F.concat("library", F.lit("."))), F.lit(False)).cast("int")
    hit = hit.withColumn("narrow", F.max(in_library).over(w)).filter((F.col("narrow") == 0) | (in_library == 1))
    return hit.select("tag", "module")


def stale_exceptions(allowed: DataFrame, used: DataFrame) -> DataFrame:
    """Exceptions that matched nothing."""
    return allowed.join(used, allowed.columns, "left_anti")


def stale_files(on_disk: DataFrame, written: DataFrame) -> DataFrame:
    """Files of an export that it no longer writes; case and a leading ``./`` do not count."""
    key = lambda c: F.lower(F.regexp_replace(c, r"^(?:\./)+", ""))
    return on_disk.withColumn("k", key(F.col("path"))).join(written.select(key(F.col("path")).alias("k")).distinct(), "k", "left_anti").drop("k")


def lost_notes(texts: DataFrame, files: DataFrame) -> DataFrame:
    """``slug``: notes that texts name and no file has as its stem."""
    stems = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("slug")).distinct()
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\\notes\{([^}]+)\}"), 1)).alias("slug")).distinct().join(stems, "slug", "left_anti")


def untranscribed(entries: DataFrame, transcribed: DataFrame, declared: DataFrame) -> DataFrame:
    """Admitted entries (id, lean) without a transcription (id): fatal if one of their names is declared, else advisory."""
    bare = entries.join(transcribed.select("id"), "id", "left_anti").select("id", F.explode_outer("lean").alias("name"))
    names = declared.select(F.substring_index("name", ".", -1).alias("short"), F.lit(True).alias("is_declared")).distinct()
    j = bare.withColumn("short", F.substring_index("name", ".", -1)).join(names, "short", "left").groupBy("id").agg(F.bool_or(F.coalesce("is_declared", F.lit(False))).alias("d"))
    return _finding(j, "admitted", F.when(F.col("d"), "fatal").otherwise("advisory"), "id", "not transcribed")


def chapters_of(modules: DataFrame, served: DataFrame) -> DataFrame:
    """``module, chapters``: the chapters that a module serves, in order; untagged modules have none."""
    listed = served.groupBy("module").agg(F.array_sort(F.collect_set("chapter")).alias("chapters"))
    return modules.select("module").distinct().join(listed, "module", "left").select("module", F.coalesce("chapters", F.array().cast("array<string>")).alias("chapters"))


def leaks(chapters: DataFrame, private: list[str]) -> DataFrame:
    """Modules that serve both a private chapter and another one."""
    mine = F.array(*map(F.lit, private)).cast("array<string>")
    return chapters.filter(F.arrays_overlap("chapters", mine) & (F.size(F.array_except("chapters", mine)) > 0))


def sorries(decls: DataFrame) -> DataFrame:
    """``fullname, is_sorry, is_vacuous, has_doc`` of declarations."""
    body = F.concat_ws(" := ", "stmt", "proof")
    return decls.select("fullname", body.rlike(r"(?:^|[^`\w])sorry(?:[^`\w-]|$)").alias("is_sorry"), F.col("stmt").rlike(r":\s*True\s*$").alias("is_vacuous"), (F.trim(F.coalesce("doc", F.lit(""))) != "").alias("has_doc"))


def repinned(texts: DataFrame, shas: dict[str, str], proof_shas: dict[str, str] | None = None) -> DataFrame:
    """``path, text, n`` of the texts whose marks change when each label is pinned to the digest given for it.

    A pin for which no digest is given stays. Marks are replaced from the last to the first.
    """
    proofs = proof_shas or {}

    def run(text: str) -> list[tuple]:
        out, n = text, 0
        for start, end, refs in reversed(statements._marks(text)):
            head = text.index(statements.WITH, start) + len(statements.WITH)
            begin = head + len(text[head:end]) - len(text[head:end].lstrip())
            said = ", ".join(
                r["label"] + (f"@{p}" if (p := shas.get(r["label"], r["pinned"])) else "") + (f"+{q}" if (q := proofs.get(r["label"], r["proof_pinned"])) else "") for r in refs
            )
            if said != text[begin:end]:
                out, n = out[:begin] + said + out[end:], n + 1
        return [(out, n)] if n else []

    return parsed(texts, run, "text string, n int")


def import_chains(parents: DataFrame) -> DataFrame:
    """``node, chain``: the way from a root to each node of ``first_parents`` as text; a walk of joins, one a step."""
    from quire.session import cut

    known = parents.select("node", "parent")
    walk = cut(known.select("node", F.col("parent").alias("up"), F.array("node").alias("trail")))
    done = walk.filter("up IS NULL")
    front = walk.filter("up IS NOT NULL")
    while not front.isEmpty():
        front = cut(front.join(known.select(F.col("node").alias("up"), F.col("parent").alias("next")), "up").select("node", F.col("next").alias("up"), F.concat(F.array("up"), F.col("trail")).alias("trail")))
        done = done.unionByName(front.filter("up IS NULL"))
        front = front.filter("up IS NOT NULL")
    return done.select("node", F.array_join("trail", " -> ").alias("chain"))


def package_list(packages: DataFrame) -> DataFrame:
    """``line`` of each package, its fields apart by tabs."""
    return packages.select(F.concat_ws("\t", "name", F.coalesce("url", F.lit("")), F.coalesce("rev", F.lit(""))).alias("line"))
