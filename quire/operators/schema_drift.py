"""Fields that are added, renamed, removed or retyped between the files of a series.

The fields of every file are counted by type where the lines are; only these counts (a few
rows a file) are compared. The comparison finds the cheapest edit script between the nested
schemas of neighbouring files, and the scripts are compiled into one projection that gives
all lines the same columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.schema_tree import Node, cheapest, parse_type
from quire.session import cut

#: Buckets of a value profile.
BUCKETS = 512
#: Field names that a table may have for its projection to be compiled; more is an error, not a cut.
MAX_NAMES = 20_000
FACTS = ["kind", "series", "seq", "src_file"]


def lines_of(raw: DataFrame) -> DataFrame:
    """Each line once, parsed; blank bodies and bodies that are no JSON object are left out."""
    body = F.try_parse_json(F.col("body"))
    once = raw.select("series", "seq", "src_file", "line_no", "body").filter("trim(body) <> ''").dropDuplicates(["src_file", "line_no", "body"])
    return (
        once.withColumn("v", body)
        .filter(F.schema_of_variant("v").startswith("OBJECT"))
        .withColumn("kind", F.coalesce(F.try_variant_get("v", "$.kind", "string"), F.lit("")))
    )


def unparsed(raw: DataFrame) -> DataFrame:
    """Lines with a body that is no JSON object (blank ones are not listed)."""
    schema = F.schema_of_variant(F.try_parse_json(F.col("body")))
    return raw.filter("trim(body) <> ''").filter(~F.coalesce(schema.startswith("OBJECT"), F.lit(False))).select("src_file", "line_no", "body")


def field_values(lines: DataFrame) -> DataFrame:
    """One row for each top-level field of each line: name, variant type and text of the value."""
    spark = lines.sparkSession
    exploded = lines.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return exploded.select(*FACTS, F.col("key").alias("name"), F.schema_of_variant("value").alias("type"), F.to_json("value").alias("text"), "value")


def _class(kind) -> F.Column:
    """``schema_tree.type_class`` as an expression."""
    head = F.regexp_extract(kind, "^[A-Z_]+", 0)
    numbers = F.regexp_extract_all(kind, F.lit(r"(\d+)"), 1)
    whole = (F.element_at(numbers, 1).cast("int") > 18) & (F.element_at(numbers, 2) == "0")
    return (
        F.when(head == "DECIMAL", F.when(whole, "integer").otherwise("decimal"))
        .when(head == "BOOLEAN", "boolean").when(head == "BIGINT", "integer").when(head.isin("DOUBLE", "FLOAT"), "decimal")
        .when(head == "ARRAY", "array").when(head == "OBJECT", "object").when(head == "VOID", "void").otherwise("string")
    )


def _profiles(values: DataFrame) -> DataFrame:
    """Counts of hashed words and number shapes of the values, by file, field and type class."""
    # each distinct value of a file is divided once: most fields have few
    values = values.filter("class <> 'void'").groupBy(*FACTS, "name", "class", "text").agg(F.count("*").alias("times"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+|[0-9]+|[^\p{L}0-9\s\"])"), 1)
    shaped = F.transform(words, lambda w: F.when(w.rlike("^[0-9]{2,}$"), F.concat(F.lit("#"), F.least(F.length(w), F.lit(6)).cast("string"))).otherwise(w))
    tokens = values.select(*FACTS, "name", "class", "times", F.explode(shaped).alias("word"))
    return tokens.groupBy(*FACTS, "name", "class", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.sum("times").alias("n"))


def _as_map(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias(name))


def facts(values: DataFrame) -> DataFrame:
    """One row for each file, kind of line and field: its type, type class, and numbers of lines.

    The type of an object or array is merged from all its lines; an inner field of several types is a VARIANT.
    """
    nested = values.filter("class IN ('object', 'array')").groupBy(*FACTS, "name", "class").agg(F.schema_of_variant_agg("value").alias("merged"))
    typed = values.groupBy(*FACTS, "name", "type", "class").agg(F.count("*").alias("n"))
    typed = typed.withColumn("of_class", F.sum("n").over(Window.partitionBy(*FACTS, "name", "class")))
    order = F.struct((F.col("class") != "void").cast("int"), F.col("of_class"), F.col("n"), F.col("type"))
    known = typed.groupBy(*FACTS, "name").agg(
        F.max_by("type", order).alias("type"),
        F.max_by("class", order).alias("class"),
        F.sum(F.when(F.col("class") != "void", F.col("n")).otherwise(0)).alias("n"),
        F.sum("n").alias("n_lines"),
    )
    return known.join(nested.hint("merge"), [*FACTS, "name", "class"], "left").withColumn("type", F.coalesce("merged", "type")).drop("merged")


def typed_values(raw: DataFrame) -> DataFrame:
    return field_values(lines_of(raw)).withColumn("class", _class(F.col("type")))


def _with_profiles(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Value profiles for fields that came or went: in their file, and of their name in all files.

    The profile of a name over all files counts, because a file may hold a single value.
    Values of other fields are not read for it.
    """
    alone = rows.filter("alone")
    names = alone.select("kind", "name").distinct()
    counted = cut(_profiles(values.join(names, ["kind", "name"], "left_semi")))
    here = alone.select("kind", "src_file", "name").distinct()
    local = _as_map(counted.join(here, ["kind", "src_file", "name"], "left_semi"), ["kind", "src_file", "name", "class"], "local")
    of_names = counted.groupBy("kind", "name", "class", "bucket").agg(F.sum("n").alias("n"))
    of_any = of_names.groupBy("kind", "name", "bucket").agg(F.sum("n").alias("n")).withColumn("class", F.lit("void"))
    general = _as_map(of_names.unionByName(of_any), ["kind", "name", "class"], "general")
    return rows.join(local, ["kind", "src_file", "name", "class"], "left").join(general, ["kind", "name", "class"], "left")


def _node(row: dict) -> Node:
    node = parse_type(row["type"], row["name"])
    node.n, node.local, node.general = float(row["n"]), dict(row["local"] or ()), dict(row["general"] or ())
    return node


CHANGES = "series string, kind string, src_file string, before_file string, change_kind string, path string, before_path string, type_before string, type_after string, depth int, depth_before int"


def _compare(rows: Iterator[dict]) -> Iterator[tuple]:
    """Changes of each step; the rows of a step follow each other."""
    for (series, kind, _), group in itertools.groupby(rows, key=lambda r: (r["series"], r["kind"], r["step"])):
        step = list(group)
        sides = {side: [_node(r) for r in step if r["side"] == side] for side in ("before", "after")}
        _, found = cheapest(sides["before"], sides["after"])
        for c in found:
            yield series, kind, step[0]["file_after"], step[0]["file_before"], c.kind, c.path, c.before, c.type_before, c.type_after, c.depth, c.depth_before


def changes(raw: DataFrame) -> DataFrame:
    """Every change between a file and the one before it in its series, by kind of line.

    Columns ``CHANGES``. Changes inside objects have dotted paths; a field that goes from
    one object to another is ``moved``. A type that only null values witness counts as
    unknown and is no change. A line delivered twice counts once; a file without lines of
    a kind is passed over for that kind. The first file of a series has no changes, an
    empty table none at all.
    """
    values = typed_values(raw)
    known = cut(facts(values))
    place = Window.partitionBy("series", "kind").orderBy("seq", "src_file")
    files = known.select(*FACTS).distinct().withColumn("step", F.row_number().over(place)).withColumn("file_before", F.lag("src_file").over(place)).withColumn("file_after", F.lead("src_file").over(place))
    ranked = known.join(files, FACTS)
    after = ranked.filter("file_before IS NOT NULL").withColumns({"side": F.lit("after"), "file_after": F.col("src_file")})
    before = ranked.filter("file_after IS NOT NULL").withColumns({"side": F.lit("before"), "step": F.col("step") + 1, "file_before": F.col("src_file")})
    columns = ["series", "kind", "step", "side", "src_file", "file_before", "file_after", "name", "type", "class", "n"]
    same_name = Window.partitionBy("series", "kind", "step", "name")
    both = after.select(columns).unionAll(before.select(columns)).withColumn("alone", F.count("*").over(same_name) == 1)
    # fields that stand in both files with one type take no part in any script
    differing = cut(both.withColumn("other", F.max("type").over(same_name) != F.min("type").over(same_name)).filter("alone OR other").drop("other"))
    ready = _with_profiles(differing, values).select(*columns, "local", "general")
    ordered = ready.repartition("series", "kind", "step").sortWithinPartitions("series", "kind", "step", "side", "name")
    names = [c.split()[0] for c in CHANGES.split(", ")]
    target = pa.schema([(n, pa.int32() if n.startswith("depth") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _compare(row for batch in batches for row in batch.to_pylist(maps_as_pydicts="lossy"))
        while part := list(itertools.islice(found, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), target.types, strict=True)], schema=target)

    return ordered.mapInArrow(run, CHANGES)


def top_level(found: DataFrame) -> DataFrame:
    """The changes of top-level fields as added, removed, renamed and retyped only.

    A field that moves into an object is removed from the top level, one that moves out of
    an object is added to it.
    """
    piece = lambda what, where, depth: F.struct(F.lit(what).alias("what") if isinstance(what, str) else what.alias("what"), F.col(where).alias("where"), F.col(depth).alias("level"))
    moved = F.array(piece("removed", "before_path", "depth_before"), piece("added", "path", "depth"))
    same = F.array(piece(F.col("change_kind"), "path", "depth"))
    flat = found.select("src_file", "kind", F.inline(F.when(F.col("change_kind") == "moved", moved).otherwise(same)))
    return flat.filter("level = 1").select("src_file", "kind", F.col("where").alias("field_name"), F.col("what").alias("change_kind"))


LINEAGE = "kind string, src_file string, name string, origin string, generation int"


def _lineage(rows: Iterator[dict]) -> Iterator[tuple]:
    """What each name of each file stands for; the rows of a series and kind follow each other, by step, renames first.

    A field is known by the name it came with. A name that is used for another field after a rename
    begins a further generation; one that comes back after it was removed is the field that it was.
    """
    for (_, kind), group in itertools.groupby(rows, key=lambda r: (r["series"], r["kind"])):
        ever: dict[str, int] = {}  # generations of a name
        gone: dict[str, tuple[str, int]] = {}
        before: dict[str, tuple[str, int]] = {}
        for _, of_file in itertools.groupby(group, key=lambda r: r["step"]):
            here = list(of_file)
            renamed = {r["name"]: r["was"] for r in here if r["was"] is not None}
            left = set(renamed.values())
            now: dict[str, tuple[str, int]] = {}
            fields = [r for r in here if r["was"] is None]
            for r in fields:
                name = r["name"]
                if name in renamed and renamed[name] in before:
                    now[name] = before[renamed[name]]
                elif name in before and name not in left:
                    now[name] = before[name]
                elif name in gone:
                    now[name] = gone.pop(name)
                else:
                    ever[name] = ever.get(name, 0) + 1
                    now[name] = (name, ever[name])
            gone.update({n: k for n, k in before.items() if n not in now and n not in left})
            before = now
            for r in fields:
                yield kind, r["src_file"], r["name"], *now[r["name"]]


def lineages(known: DataFrame, found: DataFrame) -> DataFrame:
    """``LINEAGE``: the compiled scripts, one row for each name of each file. ``known``: of ``facts``, ``found``: of ``changes``."""
    place = Window.partitionBy("series", "kind").orderBy("seq", "src_file")
    files = known.select(*FACTS).distinct().withColumn("step", F.row_number().over(place))
    fields = known.select(*FACTS, "name").distinct().join(files, FACTS).select("series", "kind", "step", "src_file", "name", F.lit(None).cast("string").alias("was"))
    renames = found.filter("change_kind = 'renamed' AND depth = 1").select("series", "kind", "src_file", F.col("path").alias("name"), F.col("before_path").alias("was"))
    renames = renames.join(files.select("series", "kind", "src_file", "step"), ["series", "kind", "src_file"]).select(*fields.columns)
    ordered = fields.unionByName(renames).repartition("series", "kind").sortWithinPartitions("series", "kind", "step", F.desc_nulls_last("was"), "name")
    target = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.string()) for c in LINEAGE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _lineage(row for batch in batches for row in batch.to_pylist())
        while part := list(itertools.islice(rows, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), target.types, strict=True)], schema=target)

    return ordered.mapInArrow(run, LINEAGE)


def _common(links: list[tuple[str, str, str]], seen: dict[tuple[str, str], int]) -> dict[tuple[str, str], str]:
    """The common name of the names that fields of several series go by, by kind: the most used one."""
    parent: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for kind, a, b in links:
        parent[root((kind, a))] = root((kind, b))
    groups: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for (kind, name), n in seen.items():
        groups.setdefault(root((kind, name)), []).append((-n, name))
    return {(kind, name): min(groups[root((kind, name))])[1] for kind, name in seen}


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} {what}; compile projections for fewer kinds at a time")
    return rows


SQL_TYPE = {"string": "string", "boolean": "boolean", "integer": "bigint", "decimal": "double", "array": "string", "object": "string", "void": "string"}


#: Files (by kind of line) whose projections are broadcast; more are joined by shuffle.
MOST_PROJECTIONS = 50_000


def unified(raw: DataFrame) -> DataFrame:
    """All lines in one table: a column for each field, whatever its name in a file, typed by its most common type.

    The scripts of a series are compiled into a projection for each of its files, from names to
    fields; a name that is used for another field later has another column then. Fields of
    several series are one if they share the name they came with, or one came with a name that
    the other was given, unless a file has both. A value that the column's type cannot hold is
    kept as text in ``other``, a map of field name to JSON text, as is every field whose column a
    line fills twice; arrays and objects are JSON text. Keys that differ only in case from a
    column are told apart by a number. Lines without a JSON object are in ``unparsed``. The names
    of fields are gathered at the driver: their number is checked, and it is a property of the
    format, not of the number of lines.
    """
    known = cut(facts(typed_values(raw)))
    of_file = cut(lineages(known, changes(raw)))
    first = of_file.filter("generation = 1")
    # a field that came as one name and is called by another that some field came with
    links = first.filter("name <> origin").select("kind", F.col("origin").alias("a"), F.col("name").alias("b")).distinct().join(first.select("kind", F.col("origin").alias("b")).distinct(), ["kind", "b"])
    both = first.select("kind", "src_file", F.col("origin").alias("a")).distinct().join(links, ["kind", "a"]).join(first.select("kind", "src_file", F.col("origin").alias("b")).distinct(), ["kind", "src_file", "b"]).select("kind", "a", "b").distinct()
    apart = links.join(both, ["kind", "a", "b"], "left_anti")
    weighed = known.select("kind", "src_file", "name", "class", "n_lines").join(of_file, ["kind", "src_file", "name"])
    sums = _bounded(weighed.groupBy("kind", "origin", "generation", "name", "class").agg(F.sum("n_lines").alias("n")), "names of fields")
    totals: dict[tuple[str, str], int] = {}
    for r in sums:
        totals[r.kind, r.origin] = totals.get((r.kind, r.origin), 0) + r.n
    common = _common([(r.kind, r.a, r.b) for r in _bounded(apart.select("kind", "a", "b"), "renames")], totals)
    column = {(r.kind, r.origin, r.generation): common[r.kind, r.origin] + (f"_{r.generation}" if r.generation > 1 else "") for r in sums}
    weight: dict[str, dict[str, int]] = {}
    names: dict[str, set[str]] = {}
    for r in sums:
        c = column[r.kind, r.origin, r.generation]
        names.setdefault(c, set()).add(r.name)
        if r["class"] != "void":
            weight.setdefault(c, {})[r["class"]] = weight.get(c, {}).get(r["class"], 0) + r.n
    labels = raw.sparkSession.createDataFrame([(*k, c) for k, c in column.items()], "kind string, origin string, generation int, label string")
    to = of_file.join(F.broadcast(labels), ["kind", "origin", "generation"]).groupBy("kind", "src_file").agg(F.map_from_entries(F.collect_list(F.struct("name", "label"))).alias("to"))
    to = cut(to)
    lines = lines_of(raw).withColumn("all", F.from_json("body", "map<string,string>")).join(F.broadcast(to) if to.count() <= MOST_PROJECTIONS else to.hint("merge"), ["kind", "src_file"], "left")
    fixed = ["series", "seq", "src_file", "line_no", "kind"]
    used, out, held = {c.lower() for c in [*fixed, "other", "all", "body", "v", "to"]}, [], []
    for name in sorted(set(names) - {"kind"}):
        aliases = sorted(names[name], key=lambda n: (n != name, n))
        typed = max((n, c) for c, n in {"string": 0, **weight.get(name, {})}.items())[1]
        mine = lambda alias: F.try_element_at("to", F.lit(alias)) == name  # noqa: E731, B023
        value = F.coalesce(*[F.when(mine(alias), F.try_element_at("all", F.lit(alias))) for alias in aliases]).try_cast(SQL_TYPE[typed])
        label, k = name, 2
        while label.lower() in used:
            label, k = f"{name}_{k}", k + 1
        used.add(label.lower())
        out.append(value.alias(label))
        # what a column does not hold stays: a value of another type, or the second alias in one line
        held.append(F.when(value.isNotNull(), F.coalesce(*[F.when(mine(a) & F.try_element_at("all", F.lit(a)).isNotNull(), F.lit(a)) for a in aliases])))
    other = F.map_filter("all", lambda k, v: v.isNotNull() & (k != "kind") & ~F.array_contains(F.col("held"), k))
    every = F.array(*held) if held else F.array().cast("array<string>")
    return lines.withColumn("held", F.array_compact(every)).select(*fixed, *out, F.to_json(other).alias("other"))
