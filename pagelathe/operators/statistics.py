"""Statistics of pages: merged from shards, binned, as ratios, histograms and a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bin edges of the plots, and the values that are binned by them.
EDGES = {
    "links": [0, 100, 250, 500, 750, 1000],
    "revs": [0, 100, 250, 500, 750, 1000, 1500, 2000, 2500],
    "avg_tokens": [0, 1000, 1500, 2000, 3000, 4000, 5000],
}
FIRST = ["revs", "links", "avg_tokens"]
SECOND = ["inss", "dels", "added_tokens", "removed_tokens"]


def shard_union(shards: list[DataFrame], key: str = "page") -> DataFrame:
    """All rows of shards with disjoint keys; raises ValueError if a key occurs twice."""
    rows = reduce(DataFrame.unionByName, shards)
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"keys in more than one shard: {[r[0] for r in twice]}")
    return rows


def merge_statistics(first: DataFrame, second: DataFrame, how: str = "full") -> DataFrame:
    """Both statistics of each page, 0 where a side is missing; ``how``: ``full`` or ``left``."""
    both = first.join(second, "page", how)
    return both.select("page", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in FIRST + SECOND])


def edges_for(data: DataFrame, column: str, edges: list[int]) -> list[int]:
    """The edges, with one more where the largest value exceeds them: that value plus 50, rounded to hundreds (half to even)."""
    largest = data.agg(F.max(column)).first()[0]
    if largest is None:
        return edges
    top = round((largest + 50) / 100) * 100
    return [*edges, top] if top > edges[-1] else edges


def bin_counts(data: DataFrame, column: str, edges: list[int] | None = None) -> DataFrame:
    """``bin, label, lo, hi, n``: values in ``(lo, hi]``, bins without values included. The lowest edge is in no bin."""
    edges = edges_for(data, column, edges or EDGES[column])
    last = len(edges) - 2
    bins = [(i, f"[{edges[i]}-{'more' if i == last else edges[i + 1]})", edges[i], edges[i + 1]) for i in range(last + 1)]
    index: Column = F.lit(None).cast("int")
    for i, _, lo, hi in bins:
        index = F.when((F.col(column) > lo) & (F.col(column) <= hi), F.lit(i)).otherwise(index)
    counts = data.select(index.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    kind = "bigint" if all(isinstance(e, int) for e in edges) else "double"
    bins = [(i, label, *(e if kind == "bigint" else float(e) for e in ends)) for i, label, *ends in bins]
    all_bins = data.sparkSession.createDataFrame(bins, f"bin int, label string, lo {kind}, hi {kind}")
    return all_bins.join(counts, "bin", "left").select("bin", "label", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def edit_ratios(data: DataFrame) -> DataFrame:
    """``page, insertion_ratio, deletion_ratio, removed_ratio``: revs / (revs + inss), revs / (revs + dels), removed / added; null where the divisor's part is 0."""
    part = lambda c: F.when(F.col(c) != 0, F.col("revs") / (F.col("revs") + F.col(c)))
    return data.select("page", part("inss").alias("insertion_ratio"), part("dels").alias("deletion_ratio"), F.try_divide("removed_tokens", "added_tokens").alias("removed_ratio"))


def ratio_histogram(data: DataFrame, numerator: str, denominator: str, steps: int = 20) -> DataFrame:
    """``bin, n``: how many ratios lie in ``(bin, bin + 1] / steps``, the first bin with its lower end. Whole numbers only, so no edge is missed."""
    n, d = F.col(numerator).cast("bigint"), F.col(denominator).cast("bigint")
    bin_ = F.greatest(F.ceil((n * steps).cast("decimal(38,0)") / d.cast("decimal(38,0)")).cast("bigint") - 1, F.lit(0).cast("bigint"))
    return data.where((d != 0) & n.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def summary(data: DataFrame) -> DataFrame:
    """One row: pages, revisions, and the means of tokens, links and revisions rounded down."""
    mean = lambda c: F.floor(F.avg(c)).cast("bigint")
    return data.agg(F.count(F.lit(1)).alias("pages"), F.sum("revs").alias("revisions"), mean("avg_tokens").alias("mean_tokens"), mean("links").alias("mean_links"), mean("revs").alias("mean_revs"))
