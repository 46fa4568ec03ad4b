"""Mixing sources to target shares of tokens, small sources repeated at most so often (problem 8).

Every document gets a hash-random key. Within each source the keys are sorted by ranges; sums of tokens per range give
each range its offset, a running sum within the range the rest. A document is taken once per whole epoch of its source,
and once more if its place in the order lies within what is left of the source's budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions.text import strip

#: Ranges of keys per source: each has about a thousandth of a source's documents, so no task gets a whole source.
RANGE_BITS = 10


def source_name(c: Column) -> Column:
    """A source's name: no outer white space, lower case, underscores for spaces."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


@dataclass(frozen=True)
class Budget:
    """What a source gives: ``epochs`` times all its tokens and ``rest`` tokens more."""

    source: str
    target: float
    most: int
    available: int
    tokens: int

    @property
    def epochs(self) -> int:
        return self.tokens // self.available if self.available else 0

    @property
    def rest(self) -> int:
        return self.tokens - self.epochs * self.available


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> list[Budget]:
    """The tokens of each source for the largest mixture with the target shares (or one of ``total`` tokens, if smaller).

    A source without tokens gives nothing; the others keep their ratios.
    """
    live = [(s, w, m) for s, w, m in targets if w > 0 and m > 0 and available.get(s, 0) > 0]
    weight = sum(w for _, w, _ in live)
    size = min((available[s] * m * weight / w for s, w, m in live), default=0.0)
    size = min(size, total) if total is not None else size
    share = {s: min(int(size * w / weight + 1e-6), available[s] * m) for s, w, m in live}
    return [Budget(s, w, m, available.get(s, 0), share.get(s, 0)) for s, w, m in targets]


def target_list(targets: DataFrame) -> list[tuple[str, float, int]]:
    """The fixed table of targets: of rows with one source the first in order counts."""
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null")
    firsts = rows.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("x")).orderBy("source").collect()
    return [(r.source, r.x.target_share, r.x.max_repeats) for r in firsts]


def mixture(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, list[Budget]]:
    """``source, doc_id, copies, tokens`` of the documents chosen, and the budgets.

    sizes: ``doc_id, source, tokens`` (written). Sources may be spelled with other case, outer white space or spaces for
    underscores. Documents without tokens, without a source or of a source that isn't in ``targets`` are not chosen; no
    document is chosen more often than ``max_repeats``. A source ends at most one document below its budget. Rows with
    the same id are documents of their own. The driver gets one row per source and range of keys.
    """
    wanted = target_list(targets)
    key = F.xxhash64(F.lit(seed), "doc_id")
    docs = sizes.select("doc_id", source_name(F.col("source")).alias("source"), "tokens", key.alias("key")).where(F.col("source").isin([s for s, _, _ in wanted]) & (F.col("tokens") > 0))
    docs = docs.withColumn("span", F.shiftright("key", 64 - RANGE_BITS).cast("int"))
    sums = docs.groupBy("source", "span").agg(F.sum("tokens").alias("n")).orderBy("source", "span").collect()
    before, available = [], {}
    for r in sums:
        before.append((r.source, r.span, available.get(r.source, 0)))
        available[r.source] = available.get(r.source, 0) + r.n
    plan = budgets(wanted, available, total)
    spark = sizes.sparkSession
    offsets = F.broadcast(spark.createDataFrame(before, "source string, span int, before bigint"))
    rests = F.broadcast(spark.createDataFrame([(b.source, b.epochs, b.rest) for b in plan], "source string, epochs int, rest bigint"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "span").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = docs.withColumn("inside", inside).join(offsets, ["source", "span"]).join(rests, "source")
    more = (F.col("before") + F.col("inside") <= F.col("rest")).cast("int")
    return placed.select("source", "doc_id", (F.col("epochs") + more).alias("copies"), "tokens").where("copies > 0"), plan


def shares(chosen: DataFrame, plan: list[Budget]) -> DataFrame:
    """Per source: target and real share of the mixture's tokens, its tokens, documents and the most copies of one."""
    spark = chosen.sparkSession
    real = chosen.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    want = spark.createDataFrame([(b.source, b.target, b.most, b.available) for b in plan], "source string, target_share double, max_repeats int, available_tokens bigint")
    both = want.join(real, "source", "left").fillna(0, ["mixed_tokens", "documents", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    return both.withColumn("actual_share", F.round(F.try_divide("mixed_tokens", total), 6))
