"""Records of tools and of the configuration: manifests, constants, homes, demands, members, macros, settings, revisions.

Sources are tables of texts (path, text), so that a file on disk, at a commit or in an archive
reads alike. JSON stays in the JVM.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.sources.texts import parsed


def at_revision(texts: DataFrame, rev: str | None = None) -> DataFrame:
    """``path, text`` of a table with a column ``rev``: at one revision (a full name or seven digits or more of it), or the newest of each path.

    Needed: path, rev, text, added_at. Readers take the result like any other table of texts.
    """
    if rev is not None:
        return texts.filter(fn.revision_matches(F.lit(rev), F.col("rev"), F.col("rev"))).select("path", "text")
    newest = Window.partitionBy("path").orderBy(F.desc_nulls_last("added_at"), F.desc("rev"))
    return texts.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("path", "text")


def lake_packages(texts: DataFrame) -> DataFrame:
    """``path, name, url, rev, folder`` of the packages of manifests; the resolved revision before the asked one. A text that is no JSON has none."""
    shape = "packages array<struct<name string, type string, url string, rev string, inputRev string>>, packagesDir string"
    j = texts.select("path", F.from_json("text", shape).alias("m")).select("path", F.coalesce("m.packagesDir", F.lit(".lake/packages")).alias("folder"), F.explode("m.packages").alias("p"))
    return j.filter("p.name IS NOT NULL").select("path", "p.name", "p.url", F.coalesce("p.rev", "p.inputRev").alias("rev"), "folder")


def package_projection(wanted: DataFrame, packages: DataFrame) -> DataFrame:
    """``name, url, rev, is_known`` of the packages that the configuration names (name)."""
    j = wanted.select("name").distinct().join(packages.select("name", "url", "rev", F.lit(True).alias("k")), "name", "left")
    return j.select("name", "url", "rev", F.coalesce("k", F.lit(False)).alias("is_known"))


#: Fixed value: the key of an export that holds its stamp.
SOURCES_KEY = "_sources"


def constants(texts: DataFrame) -> DataFrame:
    """``decl, const`` of exported maps from declarations to the constants they use."""
    each = texts.select(F.explode(F.from_json("text", "map<string, string>")).alias("decl", "body")).filter(F.col("decl") != SOURCES_KEY)
    return each.select("decl", F.explode(F.from_json("body", "array<string>")).alias("const")).distinct()


def constants_stamp(texts: DataFrame) -> DataFrame:
    """``path, sha`` of the sources that an export was made from."""
    stamp = F.try_element_at(F.from_json("text", "map<string, string>"), F.lit(SOURCES_KEY))
    return texts.select(F.explode(F.from_json(stamp, "map<string, string>")).alias("path", "sha"))


def homes_record(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules, declarations) of a record of homes: module, home, article, labels, reason; name, module, kind."""
    shape = (
        "modules map<string, struct<home: struct<kind: string, article: string, labels: array<string>, reason: string, reference: string, missing: string>>>, "
        "declarations array<struct<name: string, module: string, kind: string>>"
    )
    r = texts.select(F.from_json("text", shape).alias("r"))
    modules = r.select(F.explode("r.modules").alias("module", "m")).select("module", F.col("m.home.kind").alias("home"), "m.home.article", F.coalesce("m.home.labels", F.array().cast("array<string>")).alias("labels"), "m.home.reason", "m.home.reference", "m.home.missing")
    return modules, r.select(F.explode("r.declarations").alias("d")).select("d.name", "d.module", "d.kind").filter("name IS NOT NULL")


def demands(texts: DataFrame) -> DataFrame:
    """``pos, label, confidence, claim_count, frontier_only, notes`` of a feed of demanded labels, its order kept."""
    shape = "demands array<struct<label: string, confidence: double, claim_count: int, frontier_only: boolean, claims: array<struct<note: string>>>>"
    rows = texts.select(F.posexplode(F.from_json("text", shape)["demands"]).alias("pos", "d"))
    return rows.select("pos", "d.label", "d.confidence", "d.claim_count", "d.frontier_only", F.transform("d.claims", lambda c: c["note"]).alias("notes"))


def members(texts: DataFrame, present: DataFrame) -> DataFrame:
    """``slug, dir, state`` of the members of a constellation; ``present``: dir, has_lean of the folders that are there."""
    shape = "version int, workspace struct<root: string>, members array<struct<slug: string, dir: string>>"
    m = texts.select(F.explode(F.from_json("text", shape)["members"]).alias("m")).select("m.slug", F.coalesce("m.dir", "m.slug").alias("dir"))
    state = F.when(F.col("has_lean").isNull(), "not checked out").when(~F.col("has_lean"), "no declarations").otherwise("member")
    return m.join(present, "dir", "left").select("slug", "dir", state.alias("state"))


def safe_commands(macros: DataFrame, allowed: DataFrame) -> DataFrame:
    """``name`` of commands that macro files define, starred or not, or that a vetted list has, one in a line, ``#`` before a remark."""
    made = macros.select(F.explode(F.regexp_extract_all(fn.without_comments(F.col("text")), F.lit(r"\\(?:new|renew|provide)command\*?\s*\{?\s*\\([A-Za-z]+)"), 1)).alias("name"))
    vetted = allowed.select(F.explode(F.split("text", r"\r\n|\n|\r")).alias("name")).select(F.trim("name").alias("name")).filter("name <> '' AND NOT name LIKE '#%'")
    return made.unionByName(vetted.select(F.ltrim(F.regexp_replace("name", r"^\\", "")).alias("name"))).distinct()


def settings(base: DataFrame, local: DataFrame) -> DataFrame:
    """``key, value`` of a JSON object of settings, overridden by a local one; a byte order mark before either is passed over."""
    read = lambda t, k: t.select(F.explode(F.from_json(F.regexp_replace("text", "^\ufeff", ""), "map<string, string>")).alias("key", "value"), F.lit(k).alias("k"))
    return read(base, 0).unionByName(read(local, 1)).groupBy("key").agg(F.max_by("value", "k").alias("value"))


# -- configuration -----------------------------------------------------------------------


def _flat(value, prefix: str = "") -> list[tuple]:
    if isinstance(value, dict):
        return [row for k, v in value.items() for row in _flat(v, f"{prefix}.{k}" if prefix else k)]
    if isinstance(value, list) and value and isinstance(value[0], dict):
        return [row for n, v in enumerate(value) for row in _flat(v, f"{prefix}[{n}]")]
    values = value if isinstance(value, list) else [value]
    return [(prefix, n, str(v).lower() if isinstance(v, bool) else str(v)) for n, v in enumerate(values)]


def _toml(text: str) -> list[tuple]:
    try:
        return [(*row, None) for row in _flat(tomllib.loads(text.removeprefix("\ufeff")))]
    except tomllib.TOMLDecodeError as error:
        return [(None, None, None, str(error))]


def toml_values(texts: DataFrame) -> DataFrame:
    """``path, key, at, value, problem`` of TOML texts: dotted keys, ``[n]`` for the tables of an array, a row for each element of a list."""
    return parsed(texts, _toml, "key string, at int, value string, problem string")


def missing_paths(values: DataFrame, keys: list[str], files: DataFrame) -> DataFrame:
    """All paths that the configuration gives for ``keys`` and no file has, not only the first."""
    named = values.filter(F.col("key").isin(*keys)).select("path", "key", F.col("value").alias("named"))
    return named.join(files.select(F.col("path").alias("named")).distinct(), "named", "left_anti").select("path", "key", "named")


def discovered(starts: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """``start, config``: the nearest file of that name in a folder or one above it; null where there is none."""
    parts = F.split("start", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n > 0, "/").otherwise(""), F.lit(name)))
    tried = starts.select("start", F.posexplode(above).alias("up", "config")).join(files.select(F.col("path").alias("config")).distinct(), "config")
    return starts.join(tried.groupBy("start").agg(F.min_by("config", "up").alias("config")), "start", "left")


def module_of(path: Column, folders: list[str]) -> Column:
    """The first of the folders that holds a path; null for none."""
    return F.coalesce(*[F.when((path == f) | F.startswith(path, F.lit(f.rstrip("/") + "/")), F.lit(f)) for f in folders]) if folders else F.lit(None).cast("string")
