import random
from collections import defaultdict

from pagelathe.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").selectExpr("*", "1 as key", "2 as span", "'q' as before")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_repeats_and_spellings(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["big", " BIG\t", "Big"]), rng.randint(1, 300)) for i in range(4000)]
    rows += [(10_000 + i, rng.choice(["small one", "Small_One "]), rng.randint(1, 50)) for i in range(60)]
    rows += [(20_000 + i, rng.choice([None, "other", ""]), 100) for i in range(50)]
    rows += [(30_000 + i, "big", 0) for i in range(20)]
    want = [("big", 0.7, 1), ("small_one", 0.3, 4)]
    chosen, plan = mixing.mixture(docs(spark, rows), targets(spark, want))
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.tokens > 0 and 1 <= r.copies <= {"big": 1, "small_one": 4}[r.source] for r in got)
    sums = defaultdict(int)
    for r in got:
        sums[r.source] += r.copies * r.tokens
    available = sum(n for i, s, n in rows if 10_000 <= i < 20_000)
    assert sums["small_one"] == 4 * available  # the scarce source is used up
    report = {r.source: r for r in mixing.shares(chosen, plan).collect()}
    assert abs(report["big"].actual_share - 0.7) < 0.01 and abs(report["small_one"].actual_share - 0.3) < 0.01
    budget = next(b for b in plan if b.source == "big")
    assert 0 <= budget.tokens - sums["big"] <= 300


def test_cut_is_a_prefix_of_the_random_order(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(5000 + i, "b", 1) for i in range(100)]
    chosen, plan = mixing.mixture(docs(spark, rows), targets(spark, [("a", 0.5, 3), ("b", 0.5, 1)]))
    assert {r.doc_id for r in chosen.where("source = 'b'").collect()} == set(range(5000, 5100))
    assert chosen.where("source = 'a'").count() == 10
    again, _ = mixing.mixture(docs(spark, rows), targets(spark, [("a", 0.5, 3), ("b", 0.5, 1)]))
    assert chosen.exceptAll(again).count() == 0
    other, _ = mixing.mixture(docs(spark, rows), targets(spark, [("a", 0.5, 3), ("b", 0.5, 1)]), seed=1)
    assert chosen.exceptAll(other).count() > 0


def test_epochs_and_total(spark):
    rows = [(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(100)]
    chosen, _ = mixing.mixture(docs(spark, rows), targets(spark, [("a", 0.5, 5), ("b", 0.5, 5)]), total=500)
    copies = sorted(r.copies for r in chosen.where("source = 'a'").collect())
    assert copies == [2] * 5 + [3] * 5
    assert chosen.where("source = 'b'").count() == 25


def test_missing_sources_and_empty(spark):
    chosen, plan = mixing.mixture(docs(spark, [(1, "a", 5)]), targets(spark, [("a", 0.5, 2), ("none", 0.5, 2), (None, 0.1, 1)]))
    assert [(r.doc_id, r.copies) for r in chosen.collect()] == [(1, 2)]
    assert {r.source: r.mixed_tokens for r in mixing.shares(chosen, plan).collect()} == {"a": 10, "none": 0}
    chosen, plan = mixing.mixture(docs(spark, []), targets(spark, [("a", 1.0, 2)]))
    assert chosen.count() == 0 and mixing.shares(chosen, plan).first().actual_share is None
