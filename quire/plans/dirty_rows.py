"""Queries over lines that do not parse (problem 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import strict_load
from quire.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.rejects(table(spark, sf_dir, "flag_export"), table(spark, sf_dir, "tag_layer")).select("line_id", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = strict_load.load(table(spark, sf_dir, "flag_export"), table(spark, sf_dir, "tag_layer"))
    return got.withColumn("refs", F.array_join("refs", ";")).drop("received_at")


def p4_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of lines that fail, by file and reason."""
    raw, vocabulary = table(spark, sf_dir, "flag_export"), table(spark, sf_dir, "tag_layer")
    failed = strict_load.rejects(raw, vocabulary).groupBy("src_file").pivot("reason", ["quoting", "columns", "values"]).count()
    lines = raw.groupBy("src_file").agg(F.count("*").alias("n_lines"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}")
    return lines.join(failed, "src_file", "left").select("src_file", "n_lines", zero("quoting"), zero("columns"), zero("values"))


_FIELD = r'("(?:[^"]|"")*"|[^",]*)'
_PARSED = f"""
WITH line AS (
  SELECT line_id, src_file, line_no, regexp_replace(coalesce(raw, ''), '^\\x{{FEFF}}|\\r?\\n$|\\r$', '') AS raw FROM flag_export
), shape AS (
  SELECT *, regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*', 's') AS quoting,
    regexp_full_match(raw, '{",".join([_FIELD] * 8)}', 's') AS width,
    regexp_extract(raw, '^{",".join([_FIELD] * 8)}$', ['f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7', 'f8'], 's') AS f
  FROM line
), plain AS (
  SELECT line_id, src_file, line_no, quoting, width,
    {", ".join(f"CASE WHEN f.f{k} LIKE '\"%' THEN replace(substr(f.f{k}, 2, length(f.f{k}) - 2), '\"\"', '\"') ELSE f.f{k} END AS f{k}" for k in range(1, 9))}
  FROM shape
), named AS (
  SELECT *, regexp_replace(f4, '^\\s+|\\s+$', '', 'g') AS tag, regexp_replace(f5, '^\\s+|\\s+$', '', 'g') AS layer,
    regexp_replace(f6, '^\\s+|\\s+$', '', 'g') AS severity,
    line_no = 1 AND width AND trim(f1) = 'file' AND trim(f2) = 'line' AND trim(f3) = 'anchor' AND trim(f4) = 'tag'
      AND trim(f5) = 'layer' AND trim(f6) = 'severity' AND trim(f7) = 'claim' AND trim(f8) = 'refs' AS is_header
  FROM plain
), judged AS (
  SELECT *, CASE WHEN NOT quoting THEN 'quoting' WHEN NOT width THEN 'columns'
    WHEN severity NOT IN ('1', '2', '3') OR NOT EXISTS (SELECT 1 FROM tag_layer t WHERE t.tag = named.tag AND t.layer = named.layer) THEN 'values' END AS reason
  FROM named WHERE NOT is_header
)
"""

QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded, "p4_by_file": p4_by_file}
SQL = {
    "p4_found": _PARSED + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": _PARSED
    + """SELECT line_id, src_file, line_no, f1 AS file, f2 AS line_text, TRY_CAST(CASE WHEN regexp_full_match(trim(f2), '[+-]?[0-9]+') THEN trim(f2) END AS INTEGER) AS line,
    f3 AS anchor, tag, layer, severity::INTEGER AS severity, f7 AS claim,
    array_to_string(list_filter(list_transform(string_split(f8, ';'), lambda x: trim(x)), lambda x: x <> ''), ';') AS refs
    FROM judged WHERE reason IS NULL""",
    "p4_by_file": _PARSED
    + """SELECT l.src_file, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE reason = 'quoting')::BIGINT AS n_quoting,
    count(*) FILTER (WHERE reason = 'columns')::BIGINT AS n_columns, count(*) FILTER (WHERE reason = 'values')::BIGINT AS n_values
    FROM flag_export l LEFT JOIN judged USING (line_id) GROUP BY l.src_file""",
}
