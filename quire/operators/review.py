"""Review flags pooled into defects, defects clustered into threads, both ranked by breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import graph
from quire.session import cut


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def problems(flags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``flag_id, message`` for everything that is wrong with a flag, not only the first thing."""
    known = vocabulary.select("tag", F.col("layer").alias("tag_layer")).distinct()
    rows = flags.join(known, "tag", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [
        F.when(blank("file"), "file is missing"),
        F.when(blank("anchor"), "anchor is missing"),
        F.when(blank("claim"), "claim is missing"),
        F.when(F.col("tag_layer").isNull(), "tag is unknown").when(~F.col("layer").eqNullSafe(F.col("tag_layer")), "layer is not the one of the tag"),
        F.when(F.col("severity").isNull() | ~F.col("severity").between(1, 3), "severity is not 1, 2 or 3"),
    ]
    return rows.select("flag_id", F.explode(F.array_compact(F.array(*checks))).alias("message"))


def valid(flags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each flag once, without those that have a problem, former tags as their current name."""
    once = flags.dropDuplicates(["flag_id"])
    names = vocabulary.select("tag", "current_tag").distinct()
    good = once.join(problems(once, vocabulary).select("flag_id").distinct(), "flag_id", "left_anti")
    return good.join(names, "tag").withColumn("tag", F.col("current_tag")).drop("current_tag")


def _contained(anchors: DataFrame) -> DataFrame:
    """Pairs (a, b) of flags of one file and tag where one normalised anchor holds the other.

    A text that holds another holds each of its trigrams; so the shorter one is looked up
    by one of its trigrams, in all trigrams of the others. Only texts under three
    characters are compared with their whole group.
    """
    texts = anchors.groupBy("file", "tag", "norm").agg(F.min("flag_id").alias("id"))
    size = F.length("norm")
    grams = lambda: F.transform(F.sequence(F.lit(1), F.length("norm") - 2), lambda k: F.substring("norm", k, F.lit(3)))
    long = texts.filter(size >= 3).withColumn("grams", F.array_distinct(grams()))
    # the trigram with the largest hash stands for the text: common starts such as "the" do not pile up
    probe = long.select("file", "tag", "norm", "id", F.element_at(F.sort_array(F.transform("grams", lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), -1)["g"].alias("gram"))
    holders = long.select("file", "tag", F.col("norm").alias("whole"), F.col("id").alias("other"), F.explode("grams").alias("gram"))
    by_gram = probe.join(holders, ["file", "tag", "gram"]).filter("id <> other AND contains(whole, norm)")
    short = texts.filter(size < 3).select("file", "tag", "norm", "id")
    by_group = short.join(texts.select("file", "tag", F.col("norm").alias("whole"), F.col("id").alias("other")), ["file", "tag"]).filter("id <> other AND contains(whole, norm)")
    same = anchors.join(texts, ["file", "tag", "norm"]).select(F.col("flag_id").alias("a"), F.col("id").alias("b"))
    return by_gram.select(F.col("id").alias("a"), F.col("other").alias("b")).unionAll(by_group.select(F.col("id").alias("a"), F.col("other").alias("b"))).unionAll(same)


def pooled(flags: DataFrame) -> DataFrame:
    """``flag_id, pool``: flags of one file and tag that share a label, or that cite none and have one's anchor in the other's.

    Flags that share a label are all linked to the least of them: links grow with the flags,
    not with their pairs.
    """
    cites = flags.select("file", "tag", "flag_id", F.explode("refs").alias("ref"))
    hub = cites.groupBy("file", "tag", "ref").agg(F.min("flag_id").alias("b"))
    shared = cites.join(hub, ["file", "tag", "ref"]).select(F.col("flag_id").alias("a"), "b")
    silent = flags.filter(F.coalesce(F.size("refs"), F.lit(0)) <= 0).select("file", "tag", "flag_id", normal(F.col("anchor")).alias("norm"))
    edges = shared.unionAll(_contained(silent))
    return graph.components(flags.select(F.col("flag_id").alias("node")), edges).select(F.col("node").alias("flag_id"), F.col("component").alias("pool"))


def defects(flags: DataFrame) -> DataFrame:
    """One row for each pool: key, file, tag, layer, breadth (distinct reviews), flags, severity, refs, primary refs, elsewhere."""
    rows = flags.join(pooled(flags), "flag_id")
    grouped = rows.groupBy("pool").agg(
        F.first("file").alias("file"), F.first("tag").alias("tag"), F.first("layer").alias("layer"),
        F.countDistinct("review_id").alias("breadth"), F.count("*").alias("n_flags"), F.max("severity").alias("severity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("refs")))).alias("refs"),
        F.array_sort(F.collect_set(F.try_element_at("refs", F.lit(1)))).alias("primary_refs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("elsewhere")))).alias("elsewhere"),
        F.min(normal(F.col("anchor"))).alias("norm"),
    )
    referent = F.coalesce(F.array_min("refs"), F.concat(F.lit("anchor:"), F.left(F.sha1("norm"), F.lit(8))))
    return grouped.withColumn("key", F.concat_ws("::", "file", "tag", referent)).drop("norm")


#: Broadest first, with the key as a total order.
RANK = ["breadth", "n_flags", "severity"]


def top(defect: DataFrame, n: int = 0) -> DataFrame:
    """Defects with their rank in their layer; the first ``n`` of each, or all for 0."""
    ranked = defect.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(*[F.desc(c) for c in RANK], "key")))
    return ranked.filter(F.col("place") <= n) if n else ranked


def threads(defect: DataFrame) -> DataFrame:
    """``thread, key`` of defects that reach across files, the broadest thread first.

    Defects are joined by a shared primary label or, within one tag, where one names the
    other's file as elsewhere. All that name one file, and all defects of it, meet in one
    hub. Threads of one defect or one file are none.
    """
    base = cut(defect.select("pool", "key", "file", "tag", "breadth", "n_flags", "severity", "primary_refs", "elsewhere"))
    cites = base.select("pool", F.explode("primary_refs").alias("ref"))
    by_ref = cites.join(cites.groupBy("ref").agg(F.min("pool").alias("b")), "ref").select(F.col("pool").alias("a"), "b")
    named = base.select("tag", "pool", F.explode("elsewhere").alias("file"))
    hub = base.groupBy("tag", "file").agg(F.min("pool").alias("b")).join(named.select("tag", "file").distinct(), ["tag", "file"], "left_semi")
    to_hub = named.select("tag", "file", "pool").unionAll(base.select("tag", "file", "pool")).join(hub, ["tag", "file"]).select(F.col("pool").alias("a"), "b")
    found = graph.components(base.select(F.col("pool").alias("node")), by_ref.unionAll(to_hub)).select(F.col("node").alias("pool"), "component")
    member = cut(base.join(found, "pool"))
    size = member.groupBy("component").agg(F.count("*").alias("n_defects"), F.countDistinct("file").alias("n_files"), F.max("severity").alias("worst"), F.min_by("key", F.struct(-F.col("breadth"), -F.col("n_flags"), -F.col("severity"), F.col("key"))).alias("first_key"))
    return member.join(size.filter("n_defects > 1 AND n_files > 1"), "component").select("component", "key", "file", "tag", "breadth", "n_defects", "n_files", "worst", "first_key")


def conflicts(reviews: DataFrame) -> DataFrame:
    """Targets that reviews read under more than one contract."""
    return reviews.groupBy("target").agg(F.countDistinct("contract").alias("n_contracts")).filter("n_contracts > 1")
