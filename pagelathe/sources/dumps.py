"""MediaWiki XML dumps, local or fetched, as DataFrames."""

from __future__ import annotations

import bz2
import hashlib
import io
import json
import os
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagelathe.functions.text import strip
from pagelathe.session import shared_dir

#: What is read of a page; attributes and other members are left out.
PAGE = "title string, revision array<struct<timestamp: string, contributor: struct<username: string>, format: string, text: string>>"
FORMAT = "text/x-wiki"


class IntegrityError(Exception):
    """A fetched file differs from the checksum that its source states."""


def page_xml(records: DataFrame) -> DataFrame:
    """``title, revision`` of the pages in ``value``: what ends with a page's closing tag, without the tag."""
    xml = records.select(F.regexp_extract("value", r"(?s)<page[\s>].*$", 0).alias("xml")).where("xml <> ''")
    options = {"rowTag": "page", "ignoreSurroundingSpaces": "false"}
    pages = xml.select(F.from_xml(F.concat("xml", F.lit("</page>")), PAGE, options).alias("p")).select("p.title", "p.revision")
    return pages.where("title is not null")


def read_dump(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """``title, revision`` of each page of the ``.bz2`` files of a folder (or of the files named).

    Files are split within (bzip2 allows it), and no text moves: what ends with a page's closing tag is a record, wherever
    a split falls, and is parsed by itself. ``whole``: each file is read by one task, by the engine's own XML reader.
    """
    reader = spark.read
    if isinstance(path, str) and not path.endswith((".bz2", ".xml")):
        reader = reader.option("pathGlobFilter", "*.bz2")
    if not whole:
        return page_xml(reader.option("lineSep", "</page>").text(path))
    return reader.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path).where("title is not null")


def kept_revisions(pages: DataFrame) -> DataFrame:
    """``page, ver, contributor, text, rev_ord``: the revisions of a page before its first one in another format.

    Anonymous, deleted and empty contributors are null. A page whose revisions are missing gives no row.
    """
    stop = F.array_position(F.transform("revision", lambda r: F.coalesce(strip(r["format"]), F.lit("")) != FORMAT), F.lit(True))
    kept = F.when(stop > 0, F.slice("revision", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("revision"))
    rows = pages.select(F.col("title").alias("page"), F.posexplode(kept).alias("rev_ord", "r"))
    return rows.select("page", F.col("r.timestamp").alias("ver"), F.nullif(strip(F.col("r.contributor.username")), F.lit("")).alias("contributor"), F.col("r.text").alias("text"), "rev_ord")


def single_page(spark: SparkSession, path: str) -> DataFrame:
    """``page, ver, contributor, text`` of a file that is one page's wikitext; only the text is known."""
    none = F.lit(None).cast("string")
    return spark.read.text(path, wholetext=True).select(none.alias("page"), none.alias("ver"), none.alias("contributor"), F.col("value").alias("text"))


@dataclass(frozen=True)
class DumpFile:
    url: str
    md5: str
    size: int


def listed_files(status: dict, job: str = "articlesdump", most: int | None = None) -> list[DumpFile]:
    """The files of a finished dump job, smallest first, ``most`` of them at most; raises if the job isn't done."""
    found = status["jobs"][job]
    if found["status"] != "done":
        raise RuntimeError(f"the job {job} is {found['status']}")
    files = sorted((DumpFile(f["url"], f["md5"], int(f["size"])) for f in found["files"].values()), key=lambda f: f.size)
    return files[:most]


def fetched(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=600) as answer:  # noqa: S310
        return answer.read()


def dump_status(endpoint: str, version: str, fetch: Callable[[str], bytes] = fetched, wiki: str = "wikidatawiki") -> dict:
    return json.loads(fetch(f"{endpoint}/{wiki}/{version}/dumpstatus.json"))


def cached_file(endpoint: str, file: DumpFile, folder: str, fetch: Callable[[str], bytes] = fetched) -> str:
    """The path of a dump file, named by its checksum; fetched and checked unless it is there. It appears only once complete.

    folder: a path or the URI of a folder that all executors share.
    """
    fs, root = FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    path = f"{root}/wikidump_{file.md5}.bz2"
    if fs.get_file_info(path).type == FileType.File:
        return f"{folder}/wikidump_{file.md5}.bz2"
    content = fetch(endpoint + file.url)
    if hashlib.md5(content).hexdigest() != file.md5:  # noqa: S324
        raise IntegrityError(file.url)
    fs.create_dir(root, recursive=True)
    part = f"{root}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)
    return f"{folder}/wikidump_{file.md5}.bz2"


def online_pages(spark: SparkSession, endpoint: str, version: str, most: int | None = None, in_memory: bool = False, folder: str | None = None, fetch: Callable[[str], bytes] = fetched) -> DataFrame:
    """``title, revision`` of the pages of a dump's smallest ``most`` files, fetched and checked by the executors, a file each.

    The files are kept in ``folder`` (shared by all executors; one in the session's shared folder unless it is given), where
    later calls find them, and are then split like any dump. ``in_memory``: nothing is kept; a file is unpacked as a
    stream where it was fetched, and its pages go on one by one.
    """
    found = listed_files(dump_status(endpoint, version, fetch), most=most)
    if not found:
        return spark.createDataFrame([], PAGE)
    files = spark.createDataFrame([(f.url, f.md5, f.size) for f in found], "url string, md5 string, size bigint").repartition(len(found), "url", "md5")
    if in_memory:

        def unpacked(batches):
            for batch in batches:
                for f in map(lambda r: DumpFile(**r), batch.to_pylist()):
                    content = fetch(endpoint + f.url)
                    if hashlib.md5(content).hexdigest() != f.md5:  # noqa: S324
                        raise IntegrityError(f.url)
                    for part in records_in(bz2.open(io.BytesIO(content), "rt", encoding="utf-8", newline=""), "</page>"):
                        yield pa.RecordBatch.from_arrays([pa.array(part)], names=["value"])

        return page_xml(files.mapInArrow(unpacked, "value string"))
    folder = folder or f"{shared_dir(spark)}/dumps"

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([cached_file(endpoint, DumpFile(**r), folder, fetch) for r in batch.to_pylist()])], names=["path"])

    return read_dump(spark, [r.path for r in files.mapInArrow(kept, "path string").collect()])


def records_in(text, end: str, size: int = 1 << 20):
    """Lists of the records of a stream, what ends with ``end``, and what is left at its end."""
    left = ""
    while piece := text.read(size):
        *done, left = (left + piece).split(end)
        if done:
            yield done
    if left.strip():
        yield [left]


def checked_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, md5, size`` of the ``.bz2`` files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bz2").load(path)
    return files.select("path", F.md5("content").alias("md5"), F.col("length").alias("size"))


class OnlineDump(DataSource):
    """``spark.read.format("online_dump")``: the raw files of a dump, one partition each.

    Options: ``endpoint``, ``version``, ``wiki``, ``job``, ``max`` (files at most). ``fetch`` may be replaced in tests.
    """

    fetch: Callable[[str], bytes] = staticmethod(fetched)

    @classmethod
    def name(cls) -> str:
        return "online_dump"

    def schema(self) -> str:
        return "url string, md5 string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return OnlineReader(dict(self.options), type(self).fetch)


class OnlineReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str], bytes]):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        o = self.options
        status = dump_status(o["endpoint"], o["version"], self.fetch, o.get("wiki", "wikidatawiki"))
        return [InputPartition(f) for f in listed_files(status, o.get("job", "articlesdump"), int(o["max"]) if "max" in o else None)]

    def read(self, partition: InputPartition):
        file = partition.value
        content = self.fetch(self.options["endpoint"] + file.url)
        if hashlib.md5(content).hexdigest() != file.md5:  # noqa: S324
            raise IntegrityError(file.url)
        yield file.url, file.md5, file.size, content
