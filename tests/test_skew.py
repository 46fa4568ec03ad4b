import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from pagelathe.operators import skew

SCHEMA = "shard string, row_no int, page string, revs bigint, links bigint, avg_tokens bigint, written_at timestamp"


def test_load_plan_is_even(spark):
    keys = ["hot"] * 5000 + ["warm"] * 1500 + [f"k{i}" for i in range(1500)] + [None] * 2000
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    plan = skew.load_plan(df, "k", tasks=8)
    assert len(plan.heavy["hot"]) >= 4
    loads = Counter(r._place for r in skew.assigned(df, "k", ["i"], plan).collect())
    assert max(loads.values()) < 1.5 * len(keys) / 8 and set(loads) <= set(plan.places)
    placed = skew.assigned(df, "k", ["i"], plan).repartition(8, "_place").groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert max(r["count"] for r in placed) < 1.5 * len(keys) / 8


def test_nameless_rows_of_a_heavy_page_are_spread(spark):
    rows = [(None, None, "a" if i % 2 else None, i, 1, 1, None) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = skew.load_plan(skew.statistics_rows(df).select("page"), "page", tasks=8)
    loads = Counter(r._place for r in skew.assigned(skew.statistics_rows(df), "page", skew.SPREAD, plan).collect())
    assert len(loads) == 8 and max(loads.values()) < 1.5 * len(rows) / 8
    assert [tuple(r) for r in skew.page_results(df, plan).collect()] == [("A", 2000, sum(range(1, 4000, 2)), 3999)]


def test_results_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        page = rng.choice(["hot page", "Hot_page", " hot  page"]) if rng.random() < 0.5 else rng.choice([None, "", f"p{rng.randint(0, 200)}"])
        rows.append((f"s{i % 7}", i, page, None if rng.random() < 0.1 else rng.randint(0, 99), 1, 1, datetime(2020, 1, 1)))
    rows += [(*r[:6], datetime(2020, 1, 2)) for r in rows[:400]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as task", "2 as fragment", "'z' as own")
    want: dict = {}
    everything = 0
    for r in {(r[0], r[1]): r for r in rows}.values():
        if r[3] is None:
            continue
        everything += 1
        t = " ".join((r[2] or "").replace("_", " ").split())
        if t:
            want.setdefault(t[0].upper() + t[1:], []).append(r[3])
    got = {r.page: (r.n_rows, r.total_revs, r.largest_revs) for r in skew.page_results(df).collect()}
    assert got == {p: (len(v), sum(v), max(v)) for p, v in want.items()}
    assert {r.page for r in skew.heavy_pages(df).collect()} == {p for p, v in want.items() if len(v) >= 0.01 * everything}


def test_nameless_rows_count_by_themselves(spark):
    df = spark.createDataFrame([(None, 1, "a", 5, 1, 1, None)] * 3 + [("s", None, "a", 7, 1, 1, None)] * 2, SCHEMA)
    assert [tuple(r) for r in skew.page_results(df).collect()] == [("A", 5, 29, 7)]


def test_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)] + [(None, i) for i in range(500)], "k string, i int")
    right = spark.createDataFrame([(k, n) for n, k in enumerate(["hot", "hot", None, *[f"k{i}" for i in range(0, 40)]])], "k string, n int")
    got = skew.fragment_replicate_join(left, right, "k", ["i"])
    want = left.join(right, "k")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    outer = skew.fragment_replicate_join(left, right, "k", ["i"], "left")
    assert outer.where(F.col("n").isNull()).count() == left.join(right, "k", "left_anti").count()


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew.page_results(df).count() == 0 and skew.heavy_pages(df).count() == 0
