import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelathe.llm import packing


def containers(patterns, capacity):
    got = defaultdict(int)
    for n, inside in patterns:
        assert n > 0 and sum(s * k for s, k in inside.items()) <= capacity
        for s, k in inside.items():
            got[s] += n * k
    return dict(got), sum(n for n, _ in patterns)


def fewest(sizes, capacity):
    """The optimum by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[i]}:
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=12))))
def test_every_item_is_packed_once(case):
    capacity, counts = case
    got, _ = containers(packing.pack(counts, capacity), capacity)
    assert got == counts


def test_reduction_keeps_the_optimum():
    rng = random.Random(6)
    for _ in range(600):
        capacity = rng.randint(6, 25)
        sizes = [rng.randint(2, capacity) for _ in range(rng.randint(1, 8))]
        counts = {s: sizes.count(s) for s in sizes}
        h = packing.Histogram(counts)
        fixed = packing.reduce(h, capacity)
        rest = [s for s, n in h.counts.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)


def test_little_space_is_left():
    rng = random.Random(7)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(512, int(rng.lognormvariate(4.8, 0.8)) + 1)] += 1
    _, n = containers(packing.pack(dict(counts), 512), 512)
    assert n <= 1.01 * math.ceil(sum(s * k for s, k in counts.items()) / 512) + 1


def test_sets_of_three_are_fixed():
    h = packing.Histogram({11: 3, 6: 3, 4: 3})
    assert packing.reduce(h, 21) == [(3, {11: 1, 6: 1, 4: 1})] and not h.counts
    assert packing.worth({11: 3, 6: 3, 4: 3}, 21) == {"items": 9, "fixed_items": 9, "fixed_containers": 3, "containers": 3, "best_fit_alone": 3, "at_least": 3}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=12))))
def test_bound_is_below_any_packing(case):
    capacity, counts = case
    worth = packing.worth(counts, capacity)
    assert worth["at_least"] <= min(worth["containers"], worth["best_fit_alone"]) and worth["fixed_items"] <= worth["items"]


@pytest.mark.parametrize("part_rows", [packing.PART_ROWS, 40])
def test_documents_in_containers(spark, monkeypatch, part_rows):
    monkeypatch.setattr(packing, "PART_ROWS", part_rows)
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 7, 99, 100, 101, 250, 1000, rng.randint(1, 130)])) for i in range(3000)] + [(5, 40), (5, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").selectExpr("*", "1 as part", "2 as slice", "3 as r")
    out = packing.packed(df, 100).collect()
    load, texts = defaultdict(int), defaultdict(int)
    for r in out:
        load[r.container_no] += r.tokens
        texts[r.doc_id] += r.tokens
    want = defaultdict(int)
    for i, n in rows:
        want[i] += n
    assert texts == want and max(load.values()) <= 100
    assert set(load) == set(range(len(load))) and len(load) <= 1.05 * sum(load.values()) / 100 + 1
    whole = {i for i, n in rows if n <= 100 and i != 5}
    assert all(r.part == 0 for r in out if r.doc_id in whole)
    assert len([r for r in out if r.doc_id in whole]) == len(whole)


def test_kinds_of_containers_and_empty(spark):
    kinds = spark.createDataFrame([("s", 10), ("m", 20), ("m", 20), (None, 5), ("bad", 0)], "container string, capacity_tokens int")
    df = spark.createDataFrame([(i, 7) for i in range(10)], "doc_id bigint, tokens bigint")
    out = packing.packed_all(df, kinds)
    got = {r.container: (r.containers, r.texts, r.tokens, r.free_share) for r in packing.use(out, kinds).collect()}
    assert got == {"s": (10, 10, 70, 0.3), "m": (5, 10, 70, 0.3)}
    assert packing.packed_all(df.limit(0), kinds).count() == 0
    assert packing.packed_all(df, kinds.limit(0)).count() == 0


@pytest.mark.parametrize("counts, n", [({}, 0), ({5: 1}, 1), ({10: 3}, 3), ({5: 4}, 2), ({6: 2, 4: 2}, 2), ({6: 1, 3: 1, 2: 1, 1: 1}, 2)])
def test_small_cases(counts, n):
    assert containers(packing.pack(counts, 10), 10)[1] == n
