"""``python -m pagelathe``: the pipeline on a folder of dumps or on dumps fetched."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from pagelathe import config
from pagelathe.functions.wikitext import parse
from pagelathe.operators.revisions import parsed_pages
from pagelathe.plans import pipeline
from pagelathe.session import clean
from pagelathe.sources import dumps, files, selection


def conf_file(path: str | None) -> dict | None:
    if path is None:
        return None
    with open(path) as lines:
        return config.load(lines)


def print_dump(options) -> None:
    """The revisions of a dump file and their numbers of tokens, or its pages cut into XML parts in the work folder."""
    spark = config.session(conf_file(options.spark_conffile))
    pages = dumps.read_dump(spark, options.compressed or options.split)
    if options.compressed:
        for r in parsed_pages(dumps.kept_revisions(pages)).select("page", "ver", F.size("unstructured_part").alias("n")).toLocalIterator():
            print(r.page, r.ver, r.n)
        return
    xml = F.to_xml(F.struct("title", "revision"), {"rowTag": "page"})
    parts = selection.chunks(pages.withColumn("xml", xml), ["title"], options.pages)
    files.write_xml_parts(parts, "xml", "chunk", f"{options.work_dir}/parts", ("title",))


def main(args: list[str] | None = None) -> int:
    options = config.arguments().parse_args(args)
    if options.single:
        with open(options.single) as f:
            print(json.dumps(parse(f.read()), ensure_ascii=False))
        return 0
    if options.compressed or options.split:
        print_dump(options)
        return 0
    spark = config.session(conf_file(options.spark_conffile))
    os.makedirs(options.work_dir, exist_ok=True)
    if options.dump_dir is None:
        online = config.online(conf_file(options.online_conffile))
        pages = dumps.online_pages(spark, options.endpoint, online.version, online.max_dump, online.in_memory, f"{options.work_dir}/dumps")
    else:
        pages = dumps.read_dump(spark, options.dump_dir)
    revisions = dumps.kept_revisions(pages)
    for name, table in pipeline.run(spark, revisions, options.work_dir, f"{options.work_dir}/exec.log").items():
        print(name, table.count())
    clean(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
