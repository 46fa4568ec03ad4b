"""Configuration files (JSON with ``#`` comments), sessions built from them, and the command line's options."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

# The defaults that sessions and online dumps have where no file says otherwise.
SPARK = {"master": "local", "appName": "pagelathe", "config": {"spark.executor.memory": "10g", "spark.executor.instances": "4", "spark.executor.cores": "1"}}
ONLINE = {"wiki-version": "20180201", "process-in-memory": False, "max-dump": 3}


@dataclass(frozen=True)
class Online:
    version: str
    in_memory: bool
    max_dump: int | None


def without_comment(line: str) -> str:
    """A line up to the first ``#`` that isn't inside quotes, trimmed."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            return line[:i].strip()
    return line.strip()


def load(lines: Iterable[str]) -> dict:
    """The object of a commented JSON file; raises ``json.JSONDecodeError`` if it isn't one."""
    return json.loads("\n".join(map(without_comment, lines)))


def session(conf: dict | None = None) -> SparkSession:
    """A session with ``master``, ``appName`` and ``config``; raises KeyError if one is missing."""
    conf = SPARK if conf is None else conf
    builder = SparkSession.builder.master(conf["master"]).appName(conf["appName"])
    for key, value in conf["config"].items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def online(conf: dict | None = None) -> Online:
    conf = ONLINE if conf is None else conf
    return Online(conf["wiki-version"], conf["process-in-memory"], conf["max-dump"])


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagelathe", description="Wiki dumps to tokens, diffs, link counts and statistics.")
    # The names of the first three options.
    parser.add_argument("-d", "--dump-dir", help="folder of .bz2 dumps; without it dumps are fetched")
    parser.add_argument("-c", "--spark-conffile", help="JSON file of the session's master, appName and config")
    parser.add_argument("-o", "--online-conffile", help="JSON file of the version, and number of files to fetch")
    parser.add_argument("-w", "--work-dir", default="/tmp/pagelathe", help="folder for results")
    parser.add_argument("-e", "--endpoint", default="https://dumps.wikimedia.org", help="where dumps are fetched from")
    parser.add_argument("-s", "--single", help="parse one file of wikitext and print its tokens")
    parser.add_argument("--compressed", help="parse one .bz2 dump and print the number of tokens of each revision")
    parser.add_argument("--split", help="cut one .bz2 dump into XML parts below the work folder")
    parser.add_argument("--pages", type=int, default=1000, help="pages of such a part")
    return parser
