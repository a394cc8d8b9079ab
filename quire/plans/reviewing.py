"""Queries over review flags and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import review
from quire.session import cut, table


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(review.valid(table(spark, sf_dir, "flag"), table(spark, sf_dir, "tag_layer")))


def review_problems(spark, sf_dir):
    flags = table(spark, sf_dir, "flag").dropDuplicates(["flag_id"])
    return review.problems(flags, table(spark, sf_dir, "tag_layer"))


def review_pools(spark, sf_dir):
    return review.pooled(_valid(spark, sf_dir))


def review_breadth(spark, sf_dir):
    found = review.top(review.defects(_valid(spark, sf_dir)))
    return found.select("layer", "place", "key", "breadth", "n_flags", "severity", F.array_join("refs", " ").alias("labels"))


def review_top(spark, sf_dir):
    return review.top(review.defects(_valid(spark, sf_dir)), 10).select("layer", "place", "key")


def review_threads(spark, sf_dir):
    return review.threads(review.defects(_valid(spark, sf_dir))).select("key", "file", "tag", "n_defects", "n_files", "worst", "first_key")


def review_conflicts(spark, sf_dir):
    return review.conflicts(table(spark, sf_dir, "review"))


def review_unknown_labels(spark, sf_dir):
    """Labels that flags cite and no paper has, with the number of flags."""
    cited = table(spark, sf_dir, "flag").dropDuplicates(["flag_id"]).select("flag_id", F.explode("refs").alias("label")).distinct()
    return cited.join(table(spark, sf_dir, "paper_label"), "label", "left_anti").groupBy("label").agg(F.count("*").alias("n_flags"))


def review_duplicate_ids(spark, sf_dir):
    """Each review once, a repeated id made unique by quotes in the order of the rows."""
    from pyspark.sql import Window

    once = table(spark, sf_dir, "review").select("review_id", "id", "source").distinct()
    n = F.row_number().over(Window.partitionBy("id").orderBy("review_id", "source"))
    return once.withColumn("n", n).select("review_id", "source", F.when(F.col("id").isNotNull(), F.concat("id", F.repeat(F.lit("'"), F.col("n") - 1))).alias("unique_id"))


_ONCE = "once AS (SELECT flag_id, any_value(item_id) AS item_id, any_value(review_id) AS review_id, any_value(source) AS source, any_value(file) AS file, any_value(anchor) AS anchor, any_value(tag) AS tag, any_value(layer) AS layer, any_value(severity) AS severity, any_value(claim) AS claim, any_value(refs) AS refs, any_value(elsewhere) AS elsewhere FROM flag GROUP BY flag_id)"
_PROBLEM = """problem AS (
  SELECT o.flag_id, unnest(list_filter([
    CASE WHEN coalesce(trim(o.file), '') = '' THEN 'file is missing' END,
    CASE WHEN coalesce(trim(o.anchor), '') = '' THEN 'anchor is missing' END,
    CASE WHEN coalesce(trim(o.claim), '') = '' THEN 'claim is missing' END,
    CASE WHEN t.tag IS NULL THEN 'tag is unknown' WHEN o.layer IS DISTINCT FROM t.layer THEN 'layer is not the one of the tag' END,
    CASE WHEN o.severity IS NULL OR o.severity NOT BETWEEN 1 AND 3 THEN 'severity is not 1, 2 or 3' END], lambda x: x IS NOT NULL)) AS message
  FROM once o LEFT JOIN (SELECT DISTINCT tag, layer FROM tag_layer) t ON o.tag = t.tag)"""
_GOOD = f"""{_ONCE}, {_PROBLEM}, good AS MATERIALIZED (
  SELECT o.* EXCLUDE (tag), t.current_tag AS tag, trim(regexp_replace(lower(o.anchor), '\\s+', ' ', 'g')) AS norm
  FROM once o JOIN (SELECT DISTINCT tag, current_tag FROM tag_layer) t ON o.tag = t.tag
  WHERE o.flag_id NOT IN (SELECT flag_id FROM problem))"""
_POOL = f"""{_GOOD}, cite AS MATERIALIZED (SELECT DISTINCT flag_id, file, tag, unnest(refs) AS ref FROM good),
edge AS MATERIALIZED (
  SELECT DISTINCT a.flag_id AS a, b.flag_id AS b FROM cite a JOIN cite b USING (file, tag, ref) WHERE a.flag_id <> b.flag_id
  UNION SELECT a.flag_id, b.flag_id FROM good a JOIN good b ON a.file = b.file AND a.tag = b.tag AND a.flag_id <> b.flag_id
    AND coalesce(len(a.refs), 0) = 0 AND coalesce(len(b.refs), 0) = 0 AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm))),
reach AS (SELECT flag_id, flag_id AS other FROM good UNION SELECT r.flag_id, e.b FROM reach r JOIN edge e ON r.other = e.a),
pool AS MATERIALIZED (SELECT flag_id, min(other) AS pool FROM reach GROUP BY flag_id)"""
_DEFECT = f"""{_POOL}, defect AS MATERIALIZED (
  SELECT p.pool, any_value(g.file) AS file, any_value(g.tag) AS tag, any_value(g.layer) AS layer, count(DISTINCT g.review_id)::BIGINT AS breadth,
    count(*)::BIGINT AS n_flags, max(g.severity) AS severity, list_sort(list_distinct(flatten(list(g.refs)))) AS refs,
    list_distinct(list(g.refs[1])) AS primary_refs, list_distinct(flatten(list(g.elsewhere))) AS elsewhere, min(g.norm) AS norm
  FROM good g JOIN pool p USING (flag_id) GROUP BY p.pool),
keyed AS MATERIALIZED (SELECT *, file || '::' || tag || '::' || coalesce(refs[1], 'anchor:' || left(sha1(norm), 8)) AS key FROM defect),
ranked AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY breadth DESC, n_flags DESC, severity DESC, key)::INTEGER AS place FROM keyed)"""

QUERIES = {
    "review_problems": review_problems, "review_pools": review_pools, "review_breadth": review_breadth, "review_top": review_top,
    "review_threads": review_threads, "review_conflicts": review_conflicts, "review_unknown_labels": review_unknown_labels, "review_duplicate_ids": review_duplicate_ids,
}
SQL = {
    "review_problems": f"WITH {_ONCE}, {_PROBLEM} SELECT flag_id, message FROM problem",
    "review_pools": f"WITH RECURSIVE {_POOL} SELECT flag_id, pool FROM pool",
    "review_breadth": f"WITH RECURSIVE {_DEFECT} SELECT layer, place, key, breadth, n_flags, severity, array_to_string(refs, ' ') AS labels FROM ranked",
    "review_top": f"WITH RECURSIVE {_DEFECT} SELECT layer, place, key FROM ranked WHERE place <= 10",
    "review_conflicts": "SELECT target, count(DISTINCT contract)::BIGINT AS n_contracts FROM review GROUP BY target HAVING count(DISTINCT contract) > 1",
    "review_unknown_labels": """SELECT label, count(DISTINCT flag_id)::BIGINT AS n_flags FROM (SELECT flag_id, unnest(refs) AS label FROM flag)
      WHERE label NOT IN (SELECT label FROM paper_label) GROUP BY label""",
    "review_duplicate_ids": """SELECT review_id, source, id || repeat('''', (row_number() OVER (PARTITION BY id ORDER BY review_id, source) - 1)::INTEGER) AS unique_id
      FROM (SELECT DISTINCT review_id, id, source FROM review)""",
}
