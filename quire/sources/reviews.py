"""Reviewer files: one JSON object a line, a review and then its flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REVIEW_FIELDS = ("target", "contract", "contract_why", "strengths")


def records(texts: DataFrame) -> DataFrame:
    """``path, line_no, kind, problem, review_line, v``: every line that is not blank.

    A flag belongs to the last review line before it in its file. A line that is no JSON
    object, has an unknown kind or no review before it carries the problem instead.
    """
    rows = texts.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "body")).filter("trim(body) <> ''")
    v = F.try_parse_json("body")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rows = rows.select("path", (F.col("pos") + 1).alias("line_no"), F.when(is_object, v).alias("v"))
    rows = rows.withColumn("kind", F.try_variant_get("v", "$.kind", "string"))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("review_line", F.last(F.when(F.col("kind") == "review", F.col("line_no")), ignorenulls=True).over(order))
    problem = (
        F.when(F.col("v").isNull(), "not a JSON object").when(~F.coalesce(F.col("kind").isin("review", "flag"), F.lit(False)), "unknown kind")
        .when((F.col("kind") == "flag") & F.col("review_line").isNull(), "flag before any review")
    )
    return rows.withColumn("problem", problem)


def flags(texts: DataFrame) -> DataFrame:
    """Typed flags; a severity that JSON holds as true, text or a fraction is none."""
    rows = records(texts).filter("problem IS NULL AND kind = 'flag'")
    whole = F.schema_of_variant(F.try_variant_get("v", "$.severity", "variant")) == "BIGINT"
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    listed = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "array<string>"), F.array().cast("array<string>")).alias(k)
    return rows.select(
        F.col("path").alias("source"), "line_no", "review_line", *[text(k) for k in ("file", "anchor", "tag", "layer", "claim", "probe")],
        F.when(whole, F.try_variant_get("v", "$.severity", "int")).alias("severity"), listed("refs"), listed("elsewhere"),
    )
