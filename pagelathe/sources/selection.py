"""Choosing pages, and cutting them into chunks and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.session import written

TITLE = r"<title>([^<]+)</title>"


def title_of(xml: Column) -> Column:
    """The first title in a page's XML, null if it has none."""
    return F.nullif(F.regexp_extract(xml, TITLE, 1), F.lit(""))


def selected(pages: DataFrame, text: str, title: str, least: int = 200_000, without: tuple[str, ...] = ("User:", "Talk:")) -> DataFrame:
    """Pages with at least ``least`` characters whose title has none of the patterns; a missing title has none."""
    keep = F.length(text) >= least
    if without:
        keep = keep & ~F.coalesce(F.col(title).rlike("|".join(f"(?:{p})" for p in without)), F.lit(False))
    return pages.where(keep)


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 0 in the order given, by sorted ranges and their sizes; no task gets all rows.

    Ranges are written first, so both passes see the same ones; the driver gets one row per range.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).orderBy("_range").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r._range, total))
        total += r._n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _before bigint"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def resumed_after(rows: DataFrame, order: list[str], title: str, last: str) -> DataFrame:
    """Rows after the first one with the title; none if there is no such row."""
    at = rows.where(F.col(title) == last).select(F.struct(*order).alias("at")).orderBy("at").limit(1).collect()
    if not at:
        return rows.limit(0)
    kinds = dict(rows.dtypes)
    return rows.where(F.struct(*order) > F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, at[0]["at"])]))


def chunks(rows: DataFrame, order: list[str], size: int, most: int | None = None, whole: bool = False) -> DataFrame:
    """Rows with ``chunk``, so many each, ``most`` chunks at most; ``whole``: without a last chunk that isn't full."""
    if size <= 0 or (most is not None and most <= 0):
        raise ValueError("sizes and numbers of chunks start at 1")
    out = numbered(rows, order).withColumn("chunk", F.floor(F.col("n") / size).cast("bigint")).drop("n")
    if most is not None:
        out = out.where(F.col("chunk") < most)
    if whole:
        full = out.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select("chunk")
        out = out.join(full, "chunk", "left_semi")
    return out


def rolling_parts(rows: DataFrame, order: list[str], size: Column, capacity: int) -> DataFrame:
    """Rows with ``part``: in order, a part ends with the row by which it exceeds the capacity.

    Sums of ranges of rows are exact, so a part's number is how many times the capacity has been filled before the row.
    """
    ranged = written(rows.withColumn("_size", size.cast("bigint")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_n")).orderBy("_range").collect()
    before, total = [], 0
    for r in sums:
        before.append((r._range, total))
        total += r._n or 0
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _before bigint"))
    window = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_size").over(window), F.lit(0))
    return ranged.withColumn("_inside", inside).join(offsets, "_range").withColumn("part", F.floor((F.col("_before") + F.col("_inside")) / capacity).cast("bigint")).drop("_range", "_before", "_inside", "_size")
