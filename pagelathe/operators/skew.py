"""Per-key results where a few keys hold most rows (problem 4): fragment and replicate by estimated load.

The load of each key is counted. Keys are packed onto tasks, largest first onto the least loaded; a key with more than
a task's part is split into shards in proportion to its load. Rows go to the task of their key's shard; a matching side
is copied only to the shards of split keys. Shards of a key are merged at the end from their partial results.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.functions.text import page_title
from pagelathe.session import parallelism, written

#: Tasks per unit of parallelism at least, rows a task has at most, while there are no more than so many tasks.
TASKS, ROWS, MOST_TASKS = 2, 1_000_000, 1 << 14
#: Hash buckets of light keys per task, and the part of a task's load from which a key is heavy.
BUCKETS, HEAVY = 32, 0.25


@dataclass(frozen=True)
class LoadPlan:
    """heavy: key (may be None) to the tasks of its shards. light: task of each hash bucket of the other keys.

    places: a number for each task whose hash leads to it, so that an ordinary hash partitioning by the number puts rows
    on their tasks, and what follows needs no other shuffle.
    """

    tasks: int
    heavy: dict[str | None, list[int]]
    light: list[int]
    places: list[int]

    def heavy_table(self, spark: SparkSession) -> DataFrame:
        """``_key, _places``: at most ``tasks / HEAVY`` rows, whatever the data, so it may be broadcast."""
        rows = [(k, [self.places[t] for t in tasks]) for k, tasks in self.heavy.items()]
        return F.broadcast(spark.createDataFrame(rows, "_key string, _places array<bigint>"))

    def light_table(self, spark: SparkSession) -> DataFrame:
        """``_bucket, _light``: ``BUCKETS * tasks`` rows."""
        return F.broadcast(spark.createDataFrame([(b, self.places[t]) for b, t in enumerate(self.light)], "_bucket int, _light bigint"))


def task_places(spark: SparkSession, tasks: int) -> list[int]:
    """For each task the smallest number whose hash leads to it."""
    found: dict[int, int] = {}
    low = 0
    while len(found) < tasks:
        numbers = spark.range(low, low + 16 * tasks, 1, 1)
        for r in numbers.groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("t")).agg(F.min("id").alias("id")).collect():
            found.setdefault(r.t, r.id)
        low += 16 * tasks
    return [found[t] for t in range(tasks)]


def load_plan(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Count the load of each key, a null key like any other, and pack the keys onto tasks.

    What reaches the driver is bounded by the number of tasks: the heavy keys, of which there are at most
    ``tasks / HEAVY``, and the loads of the hash buckets that the other keys share. The table is read once.
    """
    spark = df.sparkSession
    counts = written(df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")), "loads")
    total = counts.agg(F.sum("n")).first()[0] or 0
    tasks = tasks or min(max(TASKS * parallelism(spark), math.ceil(total / ROWS)), max(MOST_TASKS, TASKS * parallelism(spark)))
    buckets = BUCKETS * tasks
    heavy = F.col("n") >= max(1.0, HEAVY * total / tasks)
    found = counts.groupBy(heavy.alias("heavy"), F.when(heavy, F.col("key")).alias("key"), F.when(~heavy, bucket(F.col("key"), buckets)).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    share = max(1.0, total / tasks)
    items = [(r.n / s, r.heavy, r.key, r.bucket) for r in found for s in [max(1, math.ceil(r.n / share)) if r.heavy else 1] for _ in range(s)]
    heap, chosen, light = [(0.0, t) for t in range(tasks)], {}, [t % tasks for t in range(buckets)]
    for n, split, k, b in sorted(items, key=lambda x: (-x[0], x[2] or "", x[3] or 0)):
        load, t = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, t))
        if split:
            chosen.setdefault(k, []).append(t)
        else:
            light[b] = t
    return LoadPlan(tasks, chosen, light, task_places(spark, tasks))


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def assigned(df: DataFrame, key: str, spread: list[str], plan: LoadPlan) -> DataFrame:
    """``df`` with the ``_place`` of its task and, of split keys, its ``_fragment``; ``spread``: columns whose hash spreads a key's rows."""
    spark = df.sparkSession
    found = df.join(plan.heavy_table(spark), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_bucket", bucket(F.col(key), len(plan.light)))
    found = found.join(plan.light_table(spark), "_bucket")
    fragment = F.when(F.col("_places").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.size("_places")).cast("int"))
    return found.withColumn("_fragment", fragment).withColumn("_place", F.coalesce(F.get("_places", F.col("_fragment")), F.col("_light"))).drop("_places", "_key", "_bucket", "_light")


def balanced_totals(df: DataFrame, key: str, value: str, spread: list[str], plan: LoadPlan | None = None) -> DataFrame:
    """Rows, sum and largest ``value`` of each key: ``key, n_rows, total, largest``; nulls of ``value`` don't add to the last two."""
    plan = plan or load_plan(df, key)
    rows = assigned(df.select(key, value, *spread), key, spread, plan).select(key, value, "_place", "_fragment").repartition(plan.tasks, "_place")
    parts = rows.groupBy(key, "_place", "_fragment").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return parts.groupBy(key).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"), F.max("largest").alias("largest"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Join (inner or left) on ``key`` where a few keys hold most rows of ``left``: the rows of a heavy key are spread over its
    fragments by the hash of ``spread``, and only the rows of ``right`` with such a key are copied, once to each fragment.

    Both sides go to the tasks of the plan in one shuffle; there the rows of ``right`` with one key are put beside each
    row of ``left`` with it. A null key matches nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    plan = plan or load_plan(left, key)
    spark = left.sparkSession
    copies = right.where(F.col(key).isNotNull()).join(plan.heavy_table(spark), F.col(key) == F.col("_key"), "left")
    copies = copies.withColumn("_bucket", bucket(F.col(key), len(plan.light))).join(plan.light_table(spark), "_bucket")
    copies = copies.select("*", F.posexplode(F.coalesce("_places", F.array("_light"))).alias("_fragment", "_place"))
    l_row, r_row = F.struct(*[c for c in left.columns if c != key]), F.struct(*[c for c in right.columns if c != key])
    rows = assigned(left, key, spread, plan).select(key, "_place", "_fragment", l_row.alias("_l"))
    matching = copies.select(key, "_place", "_fragment", r_row.alias("_r"))
    both = rows.unionByName(matching, allowMissingColumns=True).repartition(plan.tasks, "_place")
    beside = F.collect_list("_r").over(Window.partitionBy("_place", key, "_fragment"))
    found = both.withColumn("_rs", beside).where("_l is not null")
    one = F.explode if how == "inner" else F.explode_outer
    return found.select(key, "_l", one("_rs").alias("_r")).select(key, "_l.*", "_r.*")


def statistics_rows(stats: DataFrame, columns: tuple[str, ...] = ("page", "revs", "links", "avg_tokens")) -> DataFrame:
    """``shard, row_no, own`` and the columns: each (``shard``, ``row_no``) once, the row written last (ties: the row whose columns
    sort last); pages by the title rule, null if missing or blank.

    A row without shard or number has no name and counts by itself; ``own`` has a number of its own then, else null.
    """
    own = F.when(F.col("shard").isNull() | F.col("row_no").isNull(), F.monotonically_increasing_id())
    rows = stats.select("shard", "row_no", *[page_title(F.col(c)).alias(c) if c == "page" else c for c in columns], "written_at", own.alias("own"))
    latest = F.max(F.struct("written_at", *columns)).alias("x")
    # nearly all rows are unique: combining before the shuffle would sort them once more for nothing
    return rows.repartition("shard", "row_no", "own").groupBy("shard", "row_no", "own").agg(latest).select("shard", "row_no", "own", *[F.col(f"x.{c}") for c in columns])


def page_loads(stats: DataFrame) -> LoadPlan:
    """The loads of pages as estimated from all rows with revs, redelivered ones included: a pass over two columns."""
    return load_plan(stats.where("revs is not null").select(page_title(F.col("page")).alias("page")), "page")


#: What spreads the rows of a page: their names, or their own numbers where they have none.
SPREAD = ["shard", "row_no", "own"]


def page_results(stats: DataFrame, plan: LoadPlan | None = None) -> DataFrame:
    """``page, n_rows, total_revs, largest_revs`` of the rows with a page and revs; no rows for an empty table."""
    rows = statistics_rows(stats, ("page", "revs")).where("revs is not null and page is not null")
    return balanced_totals(rows, "page", "revs", SPREAD, plan or page_loads(stats)).select("page", "n_rows", F.col("total").alias("total_revs"), F.col("largest").alias("largest_revs"))


def heavy_pages(stats: DataFrame, least: float = 0.01) -> DataFrame:
    """The pages with at least ``least`` of the rows that have revs, whether or not these have a page."""
    rows = statistics_rows(stats, ("page", "revs")).where("revs is not null")
    totals = written(balanced_totals(rows, "page", "revs", SPREAD, page_loads(stats)), "totals")
    everything = totals.agg(F.sum("n_rows")).first()[0] or 0
    return totals.where((F.col("n_rows") >= F.lit(least * everything)) & F.col("page").isNotNull()).select("page")
