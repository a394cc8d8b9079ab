"""Exact clones between members: one-to-one matches of declarations with one anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

#: Priorities of a match: each pass pairs what agrees in these columns, in order of place.
PASSES = (("whole", "name"), ("whole",), ("name",), ())


#: Members whose pairs are listed; more is an error, since pairs grow with the square of their number.
MOST_MEMBERS = 5_000


def pairs_of_members(members: DataFrame) -> DataFrame:
    """All unordered pairs of members. Members are repositories; their number is checked."""
    if members.limit(MOST_MEMBERS + 1).count() > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members")
    a, b = members.select(F.col("member").alias("a")), members.select(F.col("member").alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def matches(decls: DataFrame) -> DataFrame:
    """``anchor, left, right, left_id, right_id, pass_no``: matches within each anchor and pair of members.

    ``decls``: member, anchor, whole, name, place (order in its member), decl_id. Every pass
    pairs equal classes by their row number, so no pass compares pairs. Declarations are
    matched once for each other member. Null members, anchors or wholes match nothing.
    """
    rows = decls.filter("member IS NOT NULL AND anchor IS NOT NULL AND whole IS NOT NULL").select("member", "anchor", "whole", "name", "place", "decl_id")
    # only anchors that occur in two members can match; each declaration then meets each other member of its anchor
    members = rows.select("anchor", F.col("member").alias("other")).distinct()
    meets = rows.join(members, "anchor").filter("member <> other")
    meets = meets.select("anchor", F.least("member", "other").alias("left"), F.greatest("member", "other").alias("right"), (F.col("member") < F.col("other")).alias("is_left"), "whole", "name", "place", "decl_id")
    rest = cut(meets)
    found: DataFrame | None = None
    for number, columns in enumerate(PASSES, 1):
        key = ["anchor", "left", "right", *columns]
        numbered = rest.withColumn("n", F.row_number().over(Window.partitionBy(*key, "is_left").orderBy("place", "decl_id")))
        a = numbered.filter("is_left").select(*key, "n", F.col("decl_id").alias("left_id"), F.col("whole").alias("whole_a"), F.col("name").alias("name_a"))
        b = numbered.filter("NOT is_left").select(*key, "n", F.col("decl_id").alias("right_id"), F.col("whole").alias("whole_b"), F.col("name").alias("name_b"))
        hit = cut(a.join(b, [*key, "n"]).select("anchor", "left", "right", "left_id", "right_id", (F.col("whole_a") == F.col("whole_b")).alias("is_clone"), F.coalesce(F.col("name_a") != F.col("name_b"), F.lit(False)).alias("is_renamed"), F.lit(number).alias("pass_no")))
        used = hit.select("left", "right", F.explode(F.array("left_id", "right_id")).alias("decl_id"))
        rest = cut(rest.join(used, ["left", "right", "decl_id"], "left_anti"))
        found = hit if found is None else found.unionByName(hit)
    return found


def report(found: DataFrame, decls: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Counts for each pair of members: matches, clones, renamed, excepted, counted, lines that could go."""
    lines = decls.select("decl_id", "src_lines", "name")
    rows = found.join(lines.toDF("left_id", "lines_a", "left_name"), "left_id").join(lines.toDF("right_id", "lines_b", "right_name"), "right_id")
    if allowed is not None:
        names = allowed.select(F.col("name").alias("allowed_name")).distinct()
        rows = rows.join(names.toDF("left_name").withColumn("ok_a", F.lit(True)), "left_name", "left").join(names.toDF("right_name").withColumn("ok_b", F.lit(True)), "right_name", "left")
    else:
        rows = rows.withColumn("ok_a", F.lit(None).cast("boolean")).withColumn("ok_b", F.lit(None).cast("boolean"))
    excepted = F.coalesce("ok_a", "ok_b", F.lit(False))
    return rows.groupBy("left", "right").agg(
        F.count("*").alias("n_matches"), F.count_if("is_clone").alias("n_clones"), F.count_if(F.col("is_clone") & F.col("is_renamed")).alias("n_renamed"),
        F.count_if(F.col("is_clone") & excepted).alias("n_excepted"), F.count_if(F.col("is_clone") & ~excepted).alias("n_counted"),
        F.sum(F.when(F.col("is_clone"), F.least("lines_a", "lines_b")).otherwise(0)).alias("lines"),
    )
