"""The whole way from dumps to statistics, one plan per task."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelathe.operators import revisions as R
from pagelathe.operators import statistics as S
from pagelathe.sources import files


class Phases:
    """Begin and end of each phase in seconds since 1970, in a log and as a list."""

    def __init__(self, path: str | None = None):
        self.path, self.lines = path, []

    def mark(self, what: str) -> None:
        self.lines.append((what, time.time()))
        if self.path:
            with open(self.path, "a") as out:
                out.write(f"{what} -- {self.lines[-1][1]}\n")

    def run(self, name: str, step: Callable):
        self.mark(f"BEGIN-{name}")
        result = step()
        self.mark(f"END-{name}")
        return result


def run(spark: SparkSession, revisions: DataFrame, work: str, log: str | None = None) -> dict[str, DataFrame]:
    """Pages, diffs, link counts and statistics of ``revisions``, written below ``work``; the tables written.

    Pages are parsed once and written; everything else reads them from there. Diffs and counts are also left as JSON
    lines, the statistics as CSV.
    """
    phases = Phases(log)

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    pages = phases.run("TASK1", lambda: saved(R.parsed_pages(revisions), "pages"))
    first = phases.run("STAT1", lambda: saved(R.page_statistics(pages), "statistics1"))
    diffs = phases.run("TASK2", lambda: saved(R.page_diffs(pages), "diffs"))
    second = phases.run("STAT2", lambda: saved(R.edit_statistics(diffs), "statistics2"))
    counts = phases.run("TASK3", lambda: saved(R.link_counts(R.page_links(pages)), "link_counts"))
    stamp = int(time.time() * 1000)
    files.write_diffs(diffs, f"{work}/diffs_json-{stamp}")
    files.write_counts(counts, f"{work}/count_json-{stamp}")
    for name, table in (("statistics1", first), ("statistics2", second)):
        files.write_statistics(table, f"{work}/{name}_csv-{stamp}")
    merged = saved(S.merge_statistics(first, second), "statistics")
    files.write_statistics(merged, f"{work}/statistics_csv-{stamp}")
    return {"pages": pages, "statistics1": first, "diffs": diffs, "statistics2": second, "link_counts": counts, "statistics": merged}
