"""Trust-boundary files and workflow files, read line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as fn


def boundary(lines: DataFrame) -> dict[str, DataFrame]:
    """``names``, ``includes`` (package, rev, file) and ``malformed`` of ``path, line_no, line``; comments and blanks are none."""
    rows = lines.withColumn("entry", F.trim(F.regexp_replace("line", r"#.*$", ""))).filter("entry <> ''")
    include = F.col("entry").rlike(r"^include\b")
    part = lambda k: F.regexp_extract("entry", r"^include\s+([\w.-]+)\s+@\s+(\S+)(?:\s+(\S+))?$", k)
    good = rows.filter(include & (part(1) != ""))
    return {
        "names": rows.filter(~include & ~F.col("entry").rlike(r"\s")).select("path", "line_no", F.col("entry").alias("name")),
        "includes": good.select("path", "line_no", part(1).alias("package"), part(2).alias("rev"), F.when(part(3) != "", part(3)).alias("file")),
        "malformed": rows.filter((include & (part(1) == "")) | (~include & F.col("entry").rlike(r"\s"))).select("path", "line_no", "entry"),
    }


def unpinned(lines: DataFrame) -> DataFrame:
    """Workflow steps whose reference is neither a full version nor a full digest."""
    ref = F.regexp_extract("line", r"^\s*-?\s*uses:\s*['\"]?([\w./-]+)@([^\s'\"#]+)", 2)
    return lines.filter((ref != "") & ~fn.is_pinned(ref)).select("path", "line_no", ref.alias("ref"))


def allowed(lines: DataFrame) -> DataFrame:
    """Entries of an exception list: comments stripped, blanks dropped."""
    return lines.select(F.trim(F.split_part("line", F.lit("#"), F.lit(1))).alias("name")).filter("name <> ''").distinct()
