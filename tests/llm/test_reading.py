import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import reading

TABLES = "/root/testdata/sf0.1"
EASY = "cat dog sun hat big red ran sat mum dad ball tree".split()
HARD = "epistemic ontology putative functor lemma stochastic homology tensor heuristic paradigm syntax entropy".split()
SHARED = "the a of and is".split()
LEVELS = {1: 0.0, 2: 0.25, 3: 0.5, 4: 0.8, 5: 1.0}


def text(rng, level, sentences=12):
    out = []
    for _ in range(sentences):
        n = 4 + 2 * level
        out.append(" ".join(rng.choice(SHARED) if rng.random() < 0.4 else rng.choice(HARD if rng.random() < LEVELS[level] else EASY) for _ in range(n)) + ".")
    return "{{Infobox x|name=epistemic ontology}} == Putative ==\n" + " ".join(out)


def data(spark, n=400, graded=120):
    rng = random.Random(10)
    truth = {i: rng.randint(1, 5) for i in range(n)}
    docs = [(i, text(rng, truth[i]), "en", "s") for i in truth]
    docs += [(n, "", "en", None), (n + 1, "{{only|markup}}", "en", None), (n + 2, "Der Hund.", "de", None), (n + 3, None, "en", None), (n + 4, text(rng, 5), None, None)]
    labels = [(i, f"r{k}", truth[i]) for i in range(graded) for k in range(2)] + [(0, "r0", truth[0])] * 3 + [(5, "r9", None), (None, "r1", 3), (n + 2, "r1", 5), (999_999, "r1", 1)]
    return truth, spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").withColumn("words", F.lit(1)).withColumn("grade", F.lit(9.0)), spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int")


def test_held_out_accuracy(spark):
    truth, docs, labels = data(spark)
    got = {r.doc_id: r for r in reading.reading_levels(docs, labels).collect()}
    assert set(got) == set(truth) | {400, 401, 403}
    held = [i for i in truth if i >= 120]
    assert np.mean([got[i].demanding == (truth[i] >= 4) for i in held]) >= 0.95
    assert np.corrcoef([got[i].level for i in held], [truth[i] for i in held])[0, 1] > 0.9
    assert all(1 <= got[i].level <= 5 for i in held)
    assert all(got[i].level is None and not got[i].demanding for i in (400, 401, 403))


def test_no_labels_and_empty(spark):
    _, docs, labels = data(spark, 30, 10)
    assert all(r.level is None and not r.demanding for r in reading.reading_levels(docs, labels.limit(0)).collect())
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


def test_running_text():
    t = "{{a|{{b}}|c}}'''Name''' Big <!-- x -->cat.<ref name=x>Book, p. 3</ref> See [[Tree|the tree]] and [[Sun]].\n== History ==\nNotes\n:* The dog sat. [[User:Bob]] 10:11 (UTC)"
    assert " ".join(reading.running_text(t).split()) == "Name Big cat. See the tree and Sun . :* The dog sat." or " ".join(reading.running_text(t).split()) == "Name Big cat. See the tree and Sun. :* The dog sat."


def test_features_are_distinct_per_text():
    rows, codes = reading.features(["The cat sat. The cat sat.", "", "x.", "The cat.", None])
    pairs = list(zip(rows.tolist(), codes.tolist()))
    assert len(pairs) == len(set(pairs)) and set(rows.tolist()) == {0, 2, 3}
    assert reading.features([])[0].size == 0


def test_cut_parts_the_grades():
    grade, mean = np.array([1, 2, 3, 3.5, 4, 5, 5]), np.array([1, 1.5, 2, 9, 3, 3.5, 4])
    assert 2 < reading.demanding_from(grade, mean) < 3
    assert reading.demanding_from(np.array([1.0, 2.0]), np.array([1.0, 2.0])) == float("inf")
    assert reading.demanding_from(np.array([5.0, 5.0]), np.array([1.0, 2.0])) == float("-inf")


def test_scale_rises():
    at, level = reading.scale(np.array([1, 3, 2, 4, 4, 5.0]), np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]))
    assert np.all(np.diff(at) > 0) and np.all(np.diff(level) > 0)
    assert np.allclose(level, [1, 2.5, 4, 5]) and np.allclose(at, [0.1, 0.25, 0.45, 0.6])


def test_scores_come_to_rest_on_the_whole_graph(spark):
    _, docs, labels = data(spark, 200, 60)
    graph = reading.edges(docs, reading.grades(labels))
    assert {r.doc_id for r in graph.where("length(nodes) = 0").collect()} == {200, 201, 203}
    scores, changes = reading.propagate(graph, graph.where("grade is not null"))
    assert changes[-1] <= reading.RESIDUAL < changes[0]
    rows, at, mean = scores.means(pa.array([r.nodes for r in graph.where("grade is null").limit(20).collect()]), np.full(20, np.nan))
    # all words count: every node of a document is in the graph, whoever graded it
    assert (scores.n[at] >= 1).all() and np.isfinite(mean[np.unique(rows)]).all()


def test_own_grade_is_left_out(spark):
    s = reading.Scores(np.array([3.0, 2.0]), np.array([9.0, 4.0]), np.array([29.0, 10.0]), 3.0)
    nodes = pa.array([np.array([0, 1], "<u4").tobytes()])
    for grade in (1.0, 3.0):
        _, _, mean = s.means(nodes, np.array([grade]))
        less = reading.Scores(s.n - 1, s.s - grade, s.q, 3.0)
        shared = reading.SHARED_WORDS * (s.weight() @ s.n) / s.n.sum()
        assert np.isclose(mean[0], (s.weight() @ less.mean() + shared * 3.0) / (s.weight().sum() + shared))


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no test tables")
def test_held_out_accuracy_on_the_test_tables(spark):
    """A fifth of the graded documents of the test data, whose grades are not given away."""
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/reading_labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) == 0
    truth = {r.doc_id: r.grade for r in reading.grades(labels.where(held)).where("abs(grade - 3.5) > 0.4").collect()}
    got = {r.doc_id: r.demanding for r in reading.reading_levels(docs, labels.where(~held)).collect()}
    right = [got[i] == (g > 3.5) for i, g in truth.items() if i in got]
    assert len(right) > 80 and np.mean(right) >= 0.97
    print("held out", len(right), np.mean(right), "demanding", sum(got.values()))
