"""Joins by position or time without pairing everything: as-of, bounded, ranges, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str, alias: str) -> DataFrame:
    """Each left row with ``value`` of the last right row of its group at or before ``at``.

    Both sides are put in one order and the last value is carried forward: one shuffle by
    group, no pairs. Right rows of equal position count in the order of ``value``, before
    left rows of that position.
    """
    keys = list(by)
    marked = F.struct(F.col(value).alias("value"), F.col(at).alias("at"))
    r = right.select(*keys, at, value).withColumn("_side", F.lit(0)).withColumn("_seen", marked).drop(value)
    l = left.withColumn("_side", F.lit(1)).withColumn("_seen", F.lit(None).cast(r.schema["_seen"].dataType))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "_side", F.col("_seen.value")).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(order))
    return carried.filter("_side = 1").select(*left.columns, F.col("_last.value").alias(alias), F.col("_last.at").alias(f"{alias}_at"))


def next_before_next(events: DataFrame, by: Sequence[str], at: Sequence[str], opens: Column, closes: Column, value: str, alias: str) -> DataFrame:
    """Each opening row with the first closing row before the next opening one (null: none).

    Rows are read backwards and what lies ahead is carried along, so that every frame only grows.
    """
    order = Window.partitionBy(*by).orderBy(*at)
    back = Window.partitionBy(*by).orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("_opens", opens).withColumn("_closes", closes).withColumn("_place", F.row_number().over(order))
    found = marked.withColumn("_close", F.last(F.when(F.col("_closes"), F.struct(F.col("_place").alias("p"), F.col(value).alias("v"))), ignorenulls=True).over(back))
    found = found.withColumn("_next", F.last(F.when(F.col("_opens"), F.col("_place")), ignorenulls=True).over(back))
    inside = F.col("_close.p") < F.coalesce("_next", F.lit(2**31 - 1))
    return found.filter("_opens").withColumn(alias, F.when(inside, F.col("_close.v"))).select(*events.columns, alias)


def none_within(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, seconds: int) -> DataFrame:
    """Left rows without a right row of their group within ``seconds`` before or after.

    Time is cut into bins as wide as the window; a left row looks into three of them.
    """
    keys = list(by)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    bin_of = lambda c: F.floor(micros(c) / F.lit(seconds * 1_000_000))
    l = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bin", F.explode(F.array(*[bin_of(F.col(at)) + k for k in (-1, 0, 1)])))  # noqa: E741
    r = right.select(*keys, F.col(at).alias("_at"), bin_of(F.col(at)).alias("_bin")).distinct()
    near = l.join(r, [*keys, "_bin"]).filter(F.abs(micros(F.col("_at")) - micros(F.col(at))) <= seconds * 1_000_000)
    hit = near.select(*left.columns).distinct()
    return left.join(hit, left.columns, "left_anti")


def islands(rows: DataFrame, by: Sequence[str], at: Sequence[str], inside: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive rows that are ``inside``: group, first place, length."""
    order = Window.partitionBy(*by).orderBy(*at)
    numbered = rows.withColumn("_n", F.row_number().over(order)).withColumn("_in", inside)
    kept = numbered.filter("_in").withColumn("_run", F.col("_n") - F.row_number().over(order))
    return kept.groupBy(*by, "_run").agg(F.min("_n").alias("start"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("_run")
