"""Loading delimited lines strictly and explaining what did not load.

A line is parsed with expressions only: it is split at its quotes, so that every second
segment lies inside quotes. What conforms is loaded with types. The rest is what remains
of all record offsets after an anti join with the loaded ones, and only that rest is
diagnosed. No line is changed, dropped or repaired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("file", "line", "anchor", "tag", "layer", "severity", "claim", "refs")
SEVERITIES = ("1", "2", "3")
BLANKS = r"(?U)^\s+|\s+$"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, BLANKS, "")


def _segments(raw: Column) -> Column:
    """The text between quotes; odd places (from 0) lie inside quotes if quoting is right."""
    line = F.regexp_replace(raw, r"^\x{FEFF}|\r?\n$|\r$", "")
    return F.split(line, '"', -1)


def _middle(segments: Column) -> Column:
    """All segments but the first and the last; place 0 of it lies inside quotes."""
    return F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0)))


def quoting_ok(segments: Column) -> Column:
    """Quotes stand only around whole fields or, doubled, inside quoted ones.

    Their number is even, and every outer segment is empty in the middle (a doubled
    quote) or meets its quotes with commas.
    """
    first, last = F.element_at(segments, 1), F.element_at(segments, -1)
    # the lambda uses its own element only: the cost stays linear in the length of the line
    middle = F.transform(_middle(segments), lambda part, at: (at % 2 == 0) | (part == "") | (part.startswith(",") & part.endswith(",")))
    return (
        (F.size(segments) % 2 == 1)
        & ((F.size(segments) == 1) | (((first == "") | first.endswith(",")) & ((last == "") | last.startswith(","))))
        & F.forall(middle, lambda ok: ok)
    )


def fields(segments: Column) -> Column:
    """The fields of a line whose quoting is right, without their quotes."""
    # commas inside quotes are written as an escape while the line is split at the others
    escape = lambda part: F.replace(part, F.lit("\x01"), F.lit("\x01e"))
    first, last = escape(F.element_at(segments, 1)), escape(F.element_at(segments, -1))

    def piece(part: Column, at: Column) -> Column:
        inside = F.replace(escape(part), F.lit(","), F.lit("\x01c"))
        return F.when(at % 2 == 0, inside).when(part == "", F.lit('"')).otherwise(escape(part))

    whole = F.concat(first, F.array_join(F.transform(_middle(segments), piece), ""), F.when(F.size(segments) > 1, last).otherwise(""))
    return F.transform(F.split(whole, ",", -1), lambda f: F.replace(F.replace(f, F.lit("\x01c"), F.lit(",")), F.lit("\x01e"), F.lit("\x01")))


def _parsed(raw: DataFrame, vocabulary: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = list(columns)
    at = {name: k for k, name in enumerate(names)}
    parts = raw.select(
        F.col("line_id"), F.col("src_file"), F.col("line_no"), F.col("raw"), F.col("received_at"),
        _segments(F.coalesce("raw", F.lit(""))).alias("segments"),
    ).withColumn("quoting", quoting_ok(F.col("segments")))
    parts = parts.withColumn("fields", F.when(F.col("quoting"), fields(F.col("segments")))).drop("segments")
    value = lambda name: F.try_element_at("fields", F.lit(at[name] + 1))
    header = F.forall(F.zip_with("fields", F.array(*map(F.lit, names)), lambda a, b: F.coalesce(trimmed(a) == b, F.lit(False))), lambda ok: ok)
    known = vocabulary.select(F.col("tag").alias("known_tag"), F.col("layer").alias("known_layer"), F.lit(True).alias("known")).distinct()
    parts = parts.select(
        "line_id", "src_file", "line_no", "raw", "received_at", "quoting", "fields",
        ((F.col("line_no") == 1) & F.coalesce(header, F.lit(False))).alias("is_header"),
        (F.coalesce(F.size("fields"), F.lit(0)) == len(names)).alias("width"),
        trimmed(value("tag")).alias("known_tag"), trimmed(value("layer")).alias("known_layer"),
        trimmed(value("severity")).isin(*SEVERITIES).alias("severity_ok"),
    )
    return parts.join(known, ["known_tag", "known_layer"], "left").withColumn("values_ok", F.coalesce(F.col("known") & F.col("severity_ok"), F.lit(False)))


def load(raw: DataFrame, vocabulary: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The lines that conform, typed. Headers in line 1 are not data.

    ``line`` is null where the text is no whole number (``line_text`` keeps it). A null
    raw line never conforms. Repeated lines are loaded as often as they occur.
    """
    good = _parsed(raw, vocabulary, columns).filter(~F.coalesce("is_header", F.lit(False)) & F.col("quoting") & F.col("width") & F.col("values_ok"))
    value = lambda k: F.element_at("fields", k)
    return good.select(
        "line_id", "src_file", "line_no", "received_at",
        value(1).alias("file"), value(2).alias("line_text"), trimmed(value(2)).try_cast("int").alias("line"), value(3).alias("anchor"),
        F.col("known_tag").alias("tag"), F.col("known_layer").alias("layer"), trimmed(value(6)).cast("int").alias("severity"), value(7).alias("claim"),
        F.filter(F.transform(F.split(value(8), ";"), trimmed), lambda label: label != "").alias("refs"),
    )


def rejects(raw: DataFrame, vocabulary: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """``line_id, src_file, line_no, raw, reason`` of every data line that does not load.

    The offsets of the loaded lines are taken from all offsets by an anti join that also
    matches null keys; the remainder is diagnosed: ``quoting``, else ``columns``, else
    ``values``. A null or empty line has one empty column. An empty table has no rejects.
    """
    key = ["line_id", "src_file", "line_no"]
    loaded = load(raw, vocabulary, columns).select(*[F.col(k).alias(f"loaded_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"loaded_{k}")) for k in key]
    rest = raw.join(loaded, on=same[0] & same[1] & same[2], how="left_anti")
    reason = F.when(~F.col("quoting"), "quoting").when(~F.col("width"), "columns").when(~F.col("values_ok"), "values")
    found = _parsed(rest, vocabulary, columns).filter(~F.coalesce("is_header", F.lit(False)))
    return found.select(*key, "raw", reason.alias("reason"))
