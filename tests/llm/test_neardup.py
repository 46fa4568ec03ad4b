import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import bitslice, neardup

RULE = neardup.Rule(width=3, similarity=0.6, least=20)


def runs(tokens, width=3):
    t = [x.lower() for x in tokens if x is not None]
    return {tuple(t[i : i + width]) for i in range(len(t) - width + 1)}


def brute(records, rule=RULE):
    sets = {i: s for i, t in records if len(s := runs(t, rule.width)) >= rule.least}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= rule.similarity * len(sets[a] | sets[b]) - 1e-9}


def edited(rng, tokens, edits):
    out = list(tokens)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            out.insert(at, f"ins{rng.randrange(10**6)}")
        elif len(out) > 5:
            del out[at]
    return out


def corpus(rng, n, words=3000):
    records = []
    boiler = [f"b{i}" for i in range(25)]
    while len(records) < n:
        base = [f"w{rng.randrange(words)}" for _ in range(rng.choice([5, 21, 22, 23, 40, 80, 200]))]
        if rng.random() < 0.4:
            base = boiler + base
        for _ in range(rng.choice([1, 1, 1, 2, 3, 6])):
            records.append((len(records), edited(rng, base, rng.choice([0, 0, 1, 3, 6, 12, 25]))))
    return records


def found(spark, records, rule=RULE, nested=False):
    if nested:
        rows = [(i, [t[: len(t) // 2], t[len(t) // 2 :]]) for i, t in records]
        df = spark.createDataFrame(rows, "id bigint, tokens array<array<string>>")
    else:
        df = spark.createDataFrame(records, "id bigint, tokens array<string>")
    alike = neardup.near_duplicates([df.withColumn("codes", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("class", F.lit(2))], rule)
    rows = [(r.id_a, r.id_b) for r in neardup.all_pairs(alike).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_pairs_match_brute_force(spark):
    records = corpus(random.Random(1), 700)
    want = brute(records)
    assert len(want) > 100 and found(spark, records) == want
    assert found(spark, records, nested=True) == want


def test_five_words_at_eighty_percent(spark):
    rule = neardup.Rule()
    records = corpus(random.Random(2), 300)
    assert found(spark, records, rule) == brute(records, rule)


def test_frequent_runs_are_cut_into_groups(spark, monkeypatch):
    """Records of frequent runs only, with posting lists longer than a group and than a word."""
    monkeypatch.setattr(neardup, "GROUP", 40)
    rng = random.Random(3)
    stock = [[f"s{k}_{i}" for i in range(12)] for k in range(7)]
    records = [(i, [w for k in rng.sample(range(7), 4) for w in stock[k]]) for i in range(400)]
    assert found(spark, records) == brute(records)


def test_lists_that_prove_long_are_cut_later(spark, monkeypatch):
    """The same where no count shows how frequent the runs are."""
    monkeypatch.setattr(neardup, "GROUP", 40)
    monkeypatch.setattr(neardup, "LOCAL_COUNT", 10**9)
    rng = random.Random(3)
    stock = [[f"s{k}_{i}" for i in range(12)] for k in range(7)]
    records = [(i, [w for k in rng.sample(range(7), 4) for w in stock[k]]) for i in range(400)]
    assert found(spark, records) == brute(records)


def test_runs_that_prove_frequent_are_moved_back(spark, monkeypatch):
    """Runs of all records that no batch counts: their lists are long only in the first posting."""
    monkeypatch.setattr(neardup, "GROUP", 40)
    monkeypatch.setattr(neardup, "LOCAL_COUNT", 10**9)
    seen = []
    real = neardup.posted_blocks
    monkeypatch.setattr(neardup, "posted_blocks", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rng = random.Random(9)
    own = lambda: [f"w{rng.randrange(10**6)}" for _ in range(6)]
    records = [(i, [w for k in range(6) for w in (f"x{k}", "y", "z", *own())]) for i in range(500)]
    assert found(spark, records) == brute(records)
    assert len(seen) > 1 and seen[0].where("side = 4").count() >= 1
    assert seen[-1].where("side < 3 or side = 4").count() == 0


def test_copies_positions_and_nulls(spark):
    rng = random.Random(4)
    base = [f"W{rng.randrange(500)}" for _ in range(40)]
    rows = [(i, base, list(range(40))) for i in range(5)]
    order = rng.sample(range(40), 40)
    rows.append((5, [base[i].lower() for i in order], order))
    rows.append((6, base[:20] + [None] + base[20:], [*range(20), 20, *range(21, 41)]))
    rows += [(7, None, None), (8, [], []), (9, base[:5], list(range(5))), (0, base, list(range(40)))]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>, positions array<int>")
    alike = neardup.near_duplicates([df], RULE)
    assert {(r.id_a, r.id_b) for r in neardup.all_pairs(alike).collect()} == {(a, b) for a in range(7) for b in range(a + 1, 7)}
    assert alike.pairs.count() == 0 and {(r.id, r.first) for r in alike.copies.collect()} == {(i, 0) for i in range(7)}
    assert {r.id for r in alike.owners.collect()} == set(range(7))


def test_long_and_empty(spark):
    long = [f"x{i}" for i in range(60_000)]
    assert found(spark, [(1, long), (2, long[:50_000]), (3, long[:20_000])]) == {(1, 2)}
    assert found(spark, []) == set()


def test_equal_sizes_and_thresholds(spark):
    """Exactly 0.6 counts: 30 of 50 runs in common."""
    a = [f"a{i}" for i in range(42)]
    b = a[:32] + [f"b{i}" for i in range(10)]
    assert len(runs(a) & runs(b)) / len(runs(a) | runs(b)) == 0.6
    assert found(spark, [(1, a), (2, b)]) == {(1, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_bit_slices_give_exact_distances(seed):
    rng = np.random.default_rng(seed)
    sketches = rng.integers(0, 2, (150, 512), dtype=np.uint8)
    sketches[50:100] = sketches[:50] ^ (rng.random((50, 512)) < 0.1)
    packed = np.packbits(sketches, axis=1, bitorder="little")
    words = np.arange(192).reshape(3, 64)
    query, word = np.repeat(np.arange(150), 3), np.tile(np.arange(3), 150)
    radii = np.where(words[word] < 150, rng.integers(20, 300, (450, 64)), -1)
    unit, lane = bitslice.within(bitslice.stored(packed, np.minimum(words, 149)), packed, query, word, radii)
    got = set(zip(unit.tolist(), lane.tolist()))
    want = {(u, k) for u in range(450) for k in range(64) if radii[u, k] >= 0 and (sketches[query[u]] != sketches[words[word[u], k]]).sum() <= radii[u, k]}
    assert got == want and len(want) > 100


def bits_apart(a, b):
    return int(np.unpackbits(a ^ b).sum())


def test_sketches_never_exaggerate():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 10**6, n)).astype(np.uint64) for n in (0, 5, 300, 5000)]
    sets.append(np.union1d(sets[2], sets[1]))
    s = bitslice.parity_sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), 1024)
    half = bitslice.parity_sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), 512)
    assert (bitslice.folded(s) == half).all()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert bits_apart(half[i], half[j]) <= bits_apart(s[i], s[j]) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("n", [20, 200, 600, 3000, 20_000])
def test_sketches_tell_unrelated_sets_of_any_size_apart(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 1 << 40, m)).astype(np.uint64) for m in [n] * 12 + [int(n * 0.7)] * 8]
    size = np.array([len(x) for x in sets])
    width = bitslice.width_class(RULE.radius(size, size))
    sketches = neardup.sketched(sets, width)
    kept = total = 0
    for i in range(20):
        for j in range(i):
            s = sketches[min(width[i], width[j])]
            kept += bits_apart(s[i], s[j]) <= RULE.radius(size[i], size[j])
            total += 1
    assert kept < 0.05 * total


def test_common_runs():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 5, 100, 200, 50, 150)]
    a, b = np.divmod(np.arange(36), 6)
    assert neardup.common_runs(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]


def test_an_id_with_two_sets_is_compared_with_both(spark):
    rng = random.Random(8)
    a, b = ([f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "ab")
    near_b = [*b[:-1], "x"]
    assert found(spark, [(3, a), (5, a), (5, b), (7, near_b)]) == {(3, 5), (5, 7)}
    assert found(spark, [(5, b), (5, a), (7, near_b), (9, a)]) == {(5, 7), (5, 9)}
    assert found(spark, [(5, b), (5, near_b), (5, b)]) == set()
    alike = neardup.near_duplicates([spark.createDataFrame([(3, a), (5, a), (5, b), (7, near_b)], "id bigint, tokens array<string>")], RULE)
    assert {(r.id, r.class_id, r.links) for r in neardup.members(alike).collect()} == {(3, 3, 0), (5, 3, 1), (7, 7, 1)}
    assert {(r.id, r.group_id) for r in neardup.groups(alike).collect()} == {(3, 3), (5, 3), (7, 3)}


def test_members_and_groups(spark):
    rng = random.Random(6)
    chain = [f"c{i}" for i in range(60)]
    records = [(i, [*chain[4 * i :], *[f"t{k}" for k in range(4 * i)]]) for i in range(12)]  # each like the next, the ends unlike
    records += [(100 + i, list(records[3][1])) for i in range(3)] + corpus(rng, 200)[50:]
    records = list({i: (i, t) for i, t in records}.values())
    want = brute(records)
    df = spark.createDataFrame(records, "id bigint, tokens array<string>")
    found_ = neardup.near_duplicates([df], RULE)
    root = {r.id: r.id for r in found_.owners.collect()}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert {r.id: r.group_id for r in neardup.groups(found_).collect()} == {x: top(x) for x in root}
    sets = {i: frozenset(runs(t)) for i, t in records}
    classes = {i: min(j for j in root if sets[j] == sets[i]) for i in root}
    links = {i: len({classes[b if a == i else a] for a, b in want if i in (a, b)} - {classes[i]}) for i in root}
    assert {r.id: (r.class_id, r.links) for r in neardup.members(found_).collect()} == {i: (classes[i], links[i]) for i in root}


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, tokens array<string>")
    assert neardup.groups(neardup.near_duplicates([df], RULE)).count() == 0
