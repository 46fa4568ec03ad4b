import random
from collections import Counter

from pyspark.sql import functions as F

from pagelathe.functions.tokendiff import token_diff, token_ops
from pagelathe.operators import revisions as R
from pagelathe.operators import statistics as S
from pagelathe.plans.wiki_queries import QUERIES

GOLDEN = [
    ("Trento is a city", "Trento is the city", [("DEL", 3, "a"), ("INS", 3, "the")]),
    ("a b c", "a b c", []),
    ("a b c", "a b c d e", [("INS", 3, "d e")]),
    ("a b c", "b c", [("DEL", 1, "a")]),
    ("a b c d", "x a c d y", [("INS", 1, "x"), ("DEL", 2, "b"), ("INS", 4, "y")]),
    ("b", "a b", [("INS", 1, "a")]),
    ("a", "b c", [("DEL", 1, "a"), ("INS", 1, "b c")]),
    ("a b c", "a b x c", [("INS", 3, "x")]),
    ("a b c", "a b c x", [("INS", 3, "x")]),
    ("q a b x c d", "a b q c d x", [("DEL", 1, "q"), ("DEL", 4, "x"), ("INS", 4, "q"), ("INS", 6, "x")]),
    ("", "a", [("INS", 0, "a")]),
    ("a", "", [("DEL", 1, "a")]),
]


def ops(old, new, at=None):
    a = old.split()
    return [(o["action"], o["position"], " ".join(o["tokens"])) for o in token_ops(a, at or list(range(1, len(a) + 1)), new.split())]


def test_golden_diffs():
    for old, new, want in GOLDEN:
        assert ops(old, new) == want
    assert ops("Trento is a city", "Trento is the city", [0, 10, 2, 3]) == [("DEL", 2, "a"), ("INS", 2, "the")]


def test_diffs_account_for_every_token():
    rng = random.Random(13)
    for _ in range(500):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = token_ops(a, list(range(1, len(a) + 1)), b)
        add, cut = Counter(), Counter()
        for o in got:
            (add if o["action"] == "INS" else cut).update(o["tokens"])
        assert Counter(a) - cut + add == Counter(b)
        assert sum(add.values()) - sum(cut.values()) == len(b) - len(a)


def texts(spark, rows):
    return spark.createDataFrame(rows, "page string, ver string, text string").withColumn("contributor", F.lit(None).cast("string"))


ROWS = [
    ("P", "2020-01-03T00:00:00Z", "a c [[B]]"),
    ("P", "2020-01-01T00:00:00Z", "a b [[B|x]]"),
    ("P", "2020-01-02T00:00:00Z", ""),
    ("Q", "2020-01-01T00:00:00Z", "one"),
    ("R", "2020-01-01T00:00:00Z", "x"),
    ("R", "2020-01-01T00:00:00Z", "y [[C]] [[#s]]"),
    ("R", "2020-02-01T00:00:00Z", "x y [[C]]"),
    ("S", "2020-01-01T00:00:00Z", None),
]


def test_blank_versions_vanish_from_diffs_but_count_as_revisions(spark):
    parsed = R.parsed_pages(texts(spark, ROWS))
    diffs = {(r.page, r.ver1[:7], r.ver2[:7]): [(o.action, o.position, " ".join(o.tokens)) for o in r.diff] for r in R.page_diffs(parsed).collect()}
    assert diffs[("P", "2020-01", "2020-01")] == [("DEL", 2, "b"), ("INS", 2, "c")]
    assert set(k[0] for k in diffs) == {"P", "R"}
    stats = {r.page: (r.revs, r.links, r.avg_tokens) for r in R.page_statistics(parsed).collect()}
    assert stats == {"P": (3, 1, 2), "Q": (1, 0, 1), "R": (3, 2, 3), "S": (1, 0, 0)}


def test_link_counts_and_edits(spark):
    parsed = R.parsed_pages(texts(spark, ROWS))
    counts = {(r.P1, r.P2, r.revision[:7]): r["count"] for r in R.link_counts(R.page_links(parsed)).collect()}
    assert counts[("R", "C", "2020-01")] == 1 and counts[("R", "", "2020-01")] == 1 and counts[("P", "B", "2020-01")] == 1
    edits = {r.page: (r.inss, r.dels, r.added_tokens, r.removed_tokens) for r in R.edit_statistics(R.page_diffs(parsed)).collect()}
    assert edits["P"] == (1, 1, 1, 1)


def test_the_diff_runs_once(spark):
    diffs = R.page_diffs(R.parsed_pages(texts(spark, ROWS))).where("size(diff) > 0")
    plan = diffs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 0 and plan.count("Exchange") <= 2
    assert token_diff is not None


def test_hot_pages_are_cut_without_a_trace(spark):
    rng = random.Random(14)
    rows = [("Hot" if rng.random() < 0.9 else "Cold", f"20{rng.randint(10, 20)}-0{rng.randint(1, 9)}-01T0{rng.randint(0, 9)}:00:00Z", "t") for _ in range(600)]
    df = texts(spark, rows)
    whole = {tuple(r) for r in R.version_pairs(df).collect()}
    cut = [tuple(r) for r in R.version_pairs(df, hot_rows=50).collect()]
    assert len(cut) == len(set(cut)) and set(cut) == whole


def test_hot_pages_are_cut_in_string_order(spark):
    rng = random.Random(17)
    vers = set()
    for _ in range(900):
        day, clock = f"2020-01-0{rng.randint(1, 9)}", f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}"
        vers.add(rng.choice([f"{day}T{clock}Z", f"{day}T{clock}Z", f"{day} {clock}", f"{day}T{clock}+05:00", f"{day}T{clock}-0800", f"odd {clock}"]))
    vers |= {"2020-01-05T00:00:00Z" + "x" * 100 + str(i) for i in range(9)}
    df = texts(spark, [(p, v, "t") for v in vers for p in ("Hot", "Warm")] + [("Cold", v, "t") for v in list(vers)[:20]])
    cut = [tuple(r) for r in R.version_pairs(df, hot_rows=50).collect()]
    ordered = lambda p, x: {(p, *both) for both in zip(sorted(x), sorted(x)[1:])}
    assert len(cut) == len(set(cut)) and set(cut) == ordered("Hot", vers) | ordered("Warm", vers) | ordered("Cold", list(vers)[:20])
    index = lambda p, x: {(p, v, i) for i, v in enumerate(sorted(x))}
    numbered = [tuple(r) for r in R.version_index(df, hot_rows=50).collect()]
    assert len(numbered) == len(set(numbered)) and set(numbered) == index("Hot", vers) | index("Warm", vers) | index("Cold", list(vers)[:20])


def test_diffs_of_hot_pages_are_cut_without_a_trace(spark):
    rng = random.Random(18)
    words = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12)))
    rows = [(rng.choice(["Hot"] * 6 + ["Warm", "Cold", None]), f"2020-01-01T{rng.randint(0, 400):05}{rng.choice('Z+')}", words()) for _ in range(500)]
    parsed = R.parsed_pages(texts(spark, rows))
    shown = lambda df: sorted((r.page, r.ver1, r.ver2, [(o.action, o.position, tuple(o.tokens)) for o in r.diff]) for r in df.collect())
    whole = shown(R.page_diffs(parsed))
    assert whole == shown(R.page_diffs(parsed, hot_rows=30)) and len(whole) > 200


def test_revisions_of_one_version_follow_their_place(spark):
    rows = [("P", "1", "z y", 0), ("P", "1", "a b", 1), ("P", "2", "a", 2)]
    parsed = R.parsed_pages(spark.createDataFrame(rows, "page string, ver string, text string, rev_ord int").selectExpr("*", "null as contributor"))
    assert {(r.ver, " ".join(r.tokens)) for r in R.token_sequences(parsed).collect()} == {("1", "z y a b"), ("2", "a")}


def test_documents_without_page_or_version_are_parsed(spark, tmp_path):
    rows = [("P", "1", "a b"), ("P", None, "c [[D]]"), (None, "2", "e"), ("P", "3", "a f")]
    spark.createDataFrame(rows, "page string, ver string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    assert {(r.page, r.ver, r.token) for r in run("wikitext_tokens")} == {("P", "1", "a"), ("P", "1", "b"), ("P", None, "c"), ("P", None, "[E]D"), (None, "2", "e"), ("P", "3", "a"), ("P", "3", "f")}
    assert {(r.page, r.revs, r.links, r.avg_tokens) for r in run("wikitext_stats1")} == {("P", 3, 1, 2), (None, 1, 0, 1)}
    assert [(r.page, r.ver1, r.ver2) for r in run("diff_ops")] == [("P", "1", "3")]


def test_merge_bins_and_summary(spark):
    first = spark.createDataFrame([("a", 1, 2, 3), ("c", 101, 0, 6000)], "page string, revs bigint, links bigint, avg_tokens bigint")
    second = spark.createDataFrame([("a", 1, 0, 4, 0), ("b", 2, 2, 0, 5)], "page string, inss bigint, dels bigint, added_tokens bigint, removed_tokens bigint")
    full = S.merge_statistics(first, second)
    assert {tuple(r) for r in full.collect()} == {("a", 1, 2, 3, 1, 0, 4, 0), ("b", 0, 0, 0, 2, 2, 0, 5), ("c", 101, 0, 6000, 0, 0, 0, 0)}
    assert S.merge_statistics(first, second, "left").count() == 2
    bins = {r.label: r.n for r in S.bin_counts(full, "avg_tokens").collect()}
    assert bins["[0-1000)"] == 1 and bins["[5000-more)"] == 1 and sum(bins.values()) == 2
    values = spark.createDataFrame([(0.0,), (1.0,), (1.01,)], "x double")
    assert [r.n for r in S.bin_counts(values, "x", [0, 1, 2.5]).orderBy("bin").collect()][:2] == [1, 1]
    assert S.summary(first).first().asDict() == {"pages": 2, "revisions": 102, "mean_tokens": 3001, "mean_links": 1, "mean_revs": 51}
    hist = {r.bin: r.n for r in S.ratio_histogram(spark.createDataFrame([(0, 10), (1, 20), (1, 10), (20, 20), (3, 0)], "n int, d int"), "n", "d").collect()}
    assert hist == {0: 2, 1: 1, 19: 1}


def test_shards_must_differ(spark):
    import pytest

    a = spark.createDataFrame([("a", 1)], "page string, n int")
    b = spark.createDataFrame([("b", 1)], "page string, n int")
    assert S.shard_union([a, b]).count() == 2
    with pytest.raises(ValueError):
        S.shard_union([a, b, a])
