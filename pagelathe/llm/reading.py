"""Reading level of each document (problem 9): graded examples clamped on a graph of documents and words.

Documents are joined to the words, pairs of words and sentence lengths of their running text, all of them: the graph's
nodes are the hashes of these, so many at most as ``NODES`` says, and words with one hash are one node. Graded documents
keep their grade; each node takes the mean of its documents, each other document the weighted mean of its nodes, and so
on until the nodes' scores rest: the difficulty spreads from the graded documents over the whole graph. An iteration is one
pass over the documents, whose sums per node are merged before anything moves; only the nodes' sums go round.

What a graded document is compared with never has its own grade in it: its mean is that of its nodes without itself. So
the scale and the cut are found as for documents that nobody graded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.session import written

#: Graded documents that are clamped at most, chosen by hash; all others still count as documents.
GRADED = 20_000
#: Nodes of the graph as a power of two; nodes whose sums move together.
NODES, CHUNK = 18, 4096
#: Levels by which the nodes' scores (weighted by documents) still change when the iteration ends; iterations after which it has failed.
RESIDUAL, MOST = 0.01, 60
#: Words of middling difficulty that every document is given, so that a text of a few words is not judged by them alone.
SHARED_WORDS = 10
#: Grades from which a text is demanding.
DEMANDING = 3.5

# What isn't running text, in the order in which it is taken out.
MARKUP = [
    (re.compile(r"<!--.*?-->", re.S), " "),
    (re.compile(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", re.S | re.I), " "),
    (re.compile(r"\{\{[^{}]*\}\}"), " "),
    (re.compile(r"\{\{[^{}]*\}\}"), " "),
    (re.compile(r"\{\|.*?\|\}", re.S), " "),
    (re.compile(r"'{2,}"), ""),
    (re.compile(r"\[\[(?:User|File|Image|Category)[^\]]*\]\](?:\s*\d\d:\d\d \(UTC\))?"), " "),
    (re.compile(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]"), r"\1"),
    (re.compile(r"<[^>]*>"), " "),
    (re.compile(r"^(?:=+.*=+[ \t]*|[^.!?\n]{0,30})$", re.M), " "),
]
MARKS = str.maketrans({**{c: f" {c} " for c in ".!?;,"}, **{c: " " for c in "\"“”„()[]{}:*#=<>|/\\–—_~`^+0123456789\t\r"}, "\n": " . "})


def running_text(text: str) -> str:
    """The sentences of a wiki text: no markup, references, templates, tables, headings, signatures or labels (lines of up to
    30 characters without an end mark)."""
    for pattern, to in MARKUP:
        text = pattern.sub(to, text)
    return text


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text (rows and 64-bit codes, by row): words, pairs of neighbours, sentence lengths."""
    split = [running_text(t or "").lower().translate(MARKS).split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    if not counts.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    d = pa.array([w for s in split for w in s], pa.string()).dictionary_encode()
    hashes = pd.util.hash_array(d.dictionary.to_numpy(zero_copy_only=False).astype(object))
    index = d.indices.to_numpy()
    words = hashes[index]
    rows = np.repeat(np.arange(len(texts)), counts)
    ends = np.isin(words, pd.util.hash_array(np.array([".", "!", "?"], object)))
    comma = np.isin(words, pd.util.hash_array(np.array([",", ";"], object)))
    pair = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] >> np.uint64(1))
    together = rows[:-1] == rows[1:]
    # a sentence is a run between ends within a text; its length in words falls into one of 24 steps
    spoken = ~ends & ~comma
    sentence = np.cumsum(ends) + rows * 2
    _, first, inverse = np.unique(sentence, return_index=True, return_inverse=True)
    length = np.bincount(inverse, spoken)
    step = np.minimum((np.log2(np.maximum(length, 1)) * 3).astype(np.int64), 24)
    said = length > 0
    r = np.concatenate([rows[spoken], rows[:-1][together], rows[first[said]]])
    f = np.concatenate([words[spoken], pair[together], step[said].astype(np.uint64)])
    order = np.lexsort((f, r))
    r, f = r[order], f[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])])
    return r[new], f[new]


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: the mean of the raters' levels, each rater once per document; missing levels don't count."""
    once = labels.where("doc_id is not null and reading_level between 1 and 5").groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("level"))
    return once.groupBy("doc_id").agg(F.avg("level").alias("grade"))


def english(documents: DataFrame) -> DataFrame:
    return documents.where("lang = 'en'").select("doc_id", "text")


def edges(documents: DataFrame, graded: DataFrame) -> DataFrame:
    """Written: ``doc_id, grade, nodes``: of each English document the nodes it is joined to, as sorted 4-byte numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.float64()), ("nodes", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, codes = features(batch.column(2).to_pylist())
            node = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - NODES)
            keys = np.unique(rows.astype(np.uint64) << np.uint64(NODES) | node)
            edge = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=np.uint64) << np.uint64(NODES)) * 4
            at = (keys & np.uint64((1 << NODES) - 1)).astype("<u4")
            data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(at.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], schema=schema)

    rows = english(documents).join(F.broadcast(graded), "doc_id", "left").select("doc_id", "grade", "text")
    return written(rows.mapInArrow(run, "doc_id bigint, grade double, nodes binary"), "edges")


@dataclass(frozen=True)
class Scores:
    """Documents, sum and sum of squares of their levels by node; the line that puts means on the scale of the grades."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    prior: float
    line: tuple[float, float] = (0.0, 3.0)

    def mean(self) -> np.ndarray:
        return (self.s + self.prior) / (self.n + 1)

    def weight(self) -> np.ndarray:
        """High where a node's documents agree; a node of one document says nothing."""
        spread = np.maximum((self.q + self.prior**2) / (self.n + 1) - self.mean() ** 2, 0)
        return np.where(self.n >= 2, 1 / (spread + 0.05), 0)

    def means(self, nodes: pa.Array, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and nodes of all edges, and each document's weighted mean (NaN without nodes); that of a graded one without its own grade."""
        raw = nodes.to_pylist()
        n = np.array([len(x) // 4 for x in raw], np.int64)
        at = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
        rows = np.repeat(np.arange(len(raw)), n)
        score, weight = self.mean()[at], self.weight()
        own = np.repeat(np.isfinite(grade), n)
        score[own] = (self.s[at[own]] + self.prior - grade[rows[own]]) / np.maximum(self.n[at[own]], 1)
        shared = SHARED_WORDS * (weight @ self.n) / max(self.n.sum(), 1)
        weight = weight[at]
        mean = (np.bincount(rows, weight * score, len(raw)) + shared * self.prior) / (np.bincount(rows, weight, len(raw)) + max(shared, 1e-9))
        return rows, at, np.where(n > 0, mean, np.nan)


PARTS = "chunk int, sums binary"


def summed(graph: DataFrame, scores: Scores | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, sums and sums of squares of their levels by node; without ``scores`` all must be graded.

    Each task adds up its documents; the sums are added by chunks of nodes, and the driver gets one row per chunk.
    """
    told = graph.sparkSession.sparkContext.broadcast(scores)
    schema = pa.schema([("chunk", pa.int32()), ("sums", pa.binary())])

    def run(batches):
        scores = told.value
        sums = np.zeros((3, 1 << NODES))
        for batch in batches:
            level = batch.column(0).to_numpy(zero_copy_only=False)
            rows, at, mean = (scores or Scores(*np.zeros((3, 1 << NODES)), 3.0)).means(batch.column(1), level)
            if scores is not None:
                level = np.where(np.isfinite(level), level, np.clip(scores.line[0] * np.nan_to_num(mean) + scores.line[1], 1, 5))
            value = level[rows]
            for i, x in enumerate((None, value, value * value)):
                sums[i] += np.bincount(at, x, 1 << NODES)
        parts = sums.astype("<f4").reshape(3, -1, CHUNK).transpose(1, 0, 2)
        used = [i for i in range(len(parts)) if parts[i, 0].any()]
        # the first bytes of all numbers, then the second: they compress
        out = [np.ascontiguousarray(parts[i]).view(np.uint8).reshape(-1, 4).T.tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<f4")[:, 0].astype(np.float64)
                total[chunk] = total[chunk] + x if chunk in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=schema)

    parts = graph.select("grade", "nodes").mapInArrow(run, PARTS).repartition("chunk").mapInArrow(add, PARTS).collect()
    told.unpersist()
    out = np.zeros((3, 1 << NODES))
    for chunk, raw in parts:
        out[:, chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(raw, "<f8").reshape(3, CHUNK)
    return out[0], out[1], out[2]


def graded_means(graded: DataFrame, scores: Scores) -> tuple[np.ndarray, np.ndarray]:
    """Grades and means of the graded documents that have nodes (``GRADED`` at most), in order of the means."""
    told = graded.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        for batch in batches:
            _, _, mean = told.value.means(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean)], names=["grade", "mean"])

    rows = graded.select("grade", "nodes").mapInArrow(run, "grade double, mean double").toPandas()
    told.unpersist()
    rows = rows[rows["mean"].notna()].sort_values(["mean", "grade"])
    return rows["grade"].to_numpy(np.float64), rows["mean"].to_numpy(np.float64)


def fitted(grade: np.ndarray, mean: np.ndarray) -> tuple[float, float]:
    """Slope and base of the least-squares line from means to grades."""
    if len(mean) < 2 or np.ptp(mean) < 1e-9:
        return 0.0, float(grade.mean()) if len(grade) else 3.0
    slope, base = np.polyfit(mean, grade, 1)
    return float(slope), float(base)


def propagate(graph: DataFrame, graded: DataFrame) -> tuple[Scores, list[float]]:
    """The scores at rest, and how much they changed in each iteration."""
    prior = graded.agg(F.avg("grade")).first()[0]
    scores = Scores(*summed(graded, None), 3.0 if prior is None else prior)
    changes: list[float] = []
    while not changes or changes[-1] > RESIDUAL:
        if len(changes) >= MOST:
            raise RuntimeError(f"the scores don't come to rest: {changes}")
        # the line belongs to these very scores: one that lags behind them makes them swing
        now = Scores(*summed(graph, replace(scores, line=fitted(*graded_means(graded, scores)))), scores.prior)
        changes.append(float(np.sqrt(now.n @ (now.mean() - scores.mean()) ** 2 / max(now.n.sum(), 1))))
        scores = now
    return scores, changes


def demanding_from(grade: np.ndarray, mean: np.ndarray, at: float = DEMANDING) -> float:
    """The mean that best parts the documents graded over ``at`` from the others; the middle of the best range.

    Grades close to ``at``, on which raters differ, don't count.
    """
    sure = np.abs(grade - at) > 0.4
    grade, mean = grade[sure], mean[sure]
    if not len(mean) or (grade > at).all() or (grade < at).all():
        return float("inf") if not len(mean) or (grade < at).all() else float("-inf")
    order = np.argsort(mean, kind="stable")
    hard, mean = grade[order] > at, mean[order]
    wrong = np.concatenate([[0], np.cumsum(hard)]) + np.concatenate([np.cumsum((~hard)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    cut = best[len(best) // 2]
    return float((mean[max(cut - 1, 0)] + mean[min(cut, len(mean) - 1)]) / 2)


def scale(grade: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and levels of the scale between them: the rising steps closest to the grades (means are sorted).

    Neighbours whose grades fall are pooled; a pool stands at the middle of its means with the middle of its grades.
    """
    pools: list[list[float]] = []  # number, sum of means, sum of grades
    for m, g in zip(mean.tolist(), grade.tolist()):
        pools.append([1, m, g])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


def reading_levels(documents: DataFrame, labels: DataFrame, graded: int = GRADED) -> DataFrame:
    """``doc_id, level, demanding`` of each English document: its level from 1 to 5, and whether it is 4 or 5.

    documents: ``doc_id, text, lang``; labels: ``doc_id, rater, reading_level``. A document without running text (empty,
    markup only) has a null level and isn't demanding; without labels all levels are null. At most ``graded`` graded
    documents are clamped; they get a level like all others, from what their words are in other documents. Texts are
    read whole but for what isn't running text; rows with the same id count each.
    """
    known = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(graded)
    known = written(known, "grades")
    graph = edges(documents, known)
    clamped = written(graph.where("grade is not null"), "clamped")
    if clamped.isEmpty():
        return graph.select("doc_id", F.lit(None).cast("double").alias("level"), F.lit(False).alias("demanding"))
    scores, _ = propagate(graph, clamped)
    graded_by, means = graded_means(clamped, scores)
    cut = demanding_from(graded_by, means)
    at, levels = scale(graded_by, means)
    told = documents.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        scores = told.value
        for batch in batches:
            _, _, mean = scores.means(batch.column(2), batch.column(1).to_numpy(zero_copy_only=False))
            level = pa.array(np.interp(np.nan_to_num(mean), at, levels) if len(at) else np.zeros(len(mean)), mask=np.isnan(mean) | (len(at) == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), level, pa.array(np.nan_to_num(mean, nan=-np.inf) >= cut if np.isfinite(cut) else ~np.isnan(mean) & (cut < 0))], names=["doc_id", "level", "demanding"])

    return graph.select("doc_id", "grade", "nodes").mapInArrow(run, "doc_id bigint, level double, demanding boolean")
