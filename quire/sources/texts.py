"""Whole texts, lines and bytes of a tree of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that are never read.
SKIPPED = (".git", ".claude", "_build", "node_modules", ".lake", "__pycache__")


def _pruned(df: DataFrame) -> DataFrame:
    return df.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, text`` of every file under ``root`` whose name matches, in order-free form."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return _pruned(raw.select(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")).alias("path"), F.col("value").alias("text")))


def read_bytes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _pruned(raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"))


def lines(texts: DataFrame) -> DataFrame:
    """``path, line_no, line, fenced``: lines from 1, and whether a line is inside a fenced block."""
    from pyspark.sql import Window

    rows = texts.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    before = F.sum(fence).over(Window.partitionBy("path").orderBy("pos"))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "line", ((before % 2 == 1) | (fence == 1)).alias("fenced"))


def control_chars(files: DataFrame) -> DataFrame:
    """``path, line_no, code`` of bytes under a blank, except line feeds and returns before them."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    rows = files.select("path", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    found = rows.select("path", (F.col("pos") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(r"([\x00-\x09\x0B-\x1F])"), 1)).alias("c"))
    return found.select("path", "line_no", F.ascii("c").alias("code"))


def parsed(texts: DataFrame, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``parse`` finds in each text, with its path before them."""
    spark = texts.sparkSession
    target = spark.createDataFrame([], f"path string, {schema}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *row) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text is not None for row in parse(text)]
            columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return texts.select("path", "text").mapInArrow(run, target)
