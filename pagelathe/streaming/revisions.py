"""Diffs and counts of revisions that arrive as files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.tokendiff import token_ops
from pagelathe.functions.wikitext import parse

REVISION = "page string, ver string, contributor string, text string"
DIFF = "page string, ver1 string, ver2 string, diff array<struct<action: string, position: int, tokens: array<string>>>"


def read_revisions(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Revisions from the JSON lines that appear in a folder."""
    return spark.readStream.schema(REVISION).option("maxFilesPerTrigger", files_at_once).json(path)


def tokens_of(text: str) -> tuple[list[str], list[int]]:
    tokens = parse(text)["unstructured_part"]
    return [t["text"] if t["link"] is None else f"[E]{t['link']}" for t in tokens], [t["position"] for t in tokens]


def arriving_diffs(revisions: DataFrame) -> DataFrame:
    """Diffs of each revision against the last one seen of its page; kept per page: that revision's version and tokens.

    Revisions without tokens are passed over. A revision not newer than the last one seen is late: it has no diff.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).dropna(subset=["ver"]).sort_values("ver", kind="stable")
        ver, old, places = state.get if state.exists else (None, [], [])
        out = []
        for r in rows.itertuples():
            tokens, positions = tokens_of(r.text or "")
            if not tokens or (ver is not None and r.ver <= ver):
                continue
            if ver is not None:
                out.append((key[0], ver, r.ver, token_ops(list(old), list(places), tokens)))
            ver, old, places = r.ver, tokens, positions
        if ver is not None:
            state.update((ver, old, places))
        yield pd.DataFrame(out, columns=["page", "ver1", "ver2", "diff"])

    return revisions.where("page is not null").groupBy("page").applyInPandasWithState(step, DIFF, "ver string, tokens array<string>, positions array<int>", "append", "NoTimeout")


def revisions_per_window(revisions: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Revisions per page and window of their time; those later than ``late`` are left out."""
    timed = revisions.withColumn("at", F.col("ver").try_cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "page").agg(F.count(F.lit(1)).alias("revs")).select("page", F.col("window.start").alias("start"), "revs")
