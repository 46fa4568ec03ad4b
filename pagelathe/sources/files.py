"""JSON lines, CSV shards and XML parts on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.text import slug

#: A page line as it is written: parts are arrays of arrays.
LINE = "title string, timestamp string, contributor string, structured_part array<array<string>>, unstructured_part array<array<string>>"
DIFF = "page string, ver1 string, ver2 string, diff array<struct<action: string, position: int, tokens: array<string>>>"
COUNT = "P1 string, P2 string, revision string, count int"
FIRST = "page string, revs bigint, links bigint, avg_tokens bigint"
SECOND = "page string, inss bigint, dels bigint, added_tokens bigint, removed_tokens bigint"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page, ver, contributor, structured_part, unstructured_part`` of JSON lines; all files of a folder at once."""
    rows = spark.read.schema(LINE).json(path)
    return rows.select(
        F.col("title").alias("page"), F.col("timestamp").alias("ver"), "contributor",
        F.expr("transform(structured_part, x -> struct(x[0] as name, x[1] as text, x[2] as link))").alias("structured_part"),
        F.expr("transform(unstructured_part, x -> struct(x[0] as text, x[1] as link, cast(x[2] as int) as position))").alias("unstructured_part"),
    )


def page_lines(parsed: DataFrame) -> DataFrame:
    """``page, ver, value``: each version as a JSON line with parts as arrays."""
    quote = lambda c: f"coalesce(substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2), 'null')"
    part = lambda of, fields: f"concat('[', array_join(transform(coalesce({of}, array()), x -> concat('[', {', '.join(fields)}, ']')), ', '), ']')"
    body = f"""concat('{{"title": ', {quote("page")}, ', "timestamp": ', {quote("ver")}, ', "contributor": ', {quote("contributor")},
        ', "structured_part": ', {part("structured_part", [quote("x.name"), "', '", quote("x.text"), "', '", quote("x.link")])},
        ', "unstructured_part": ', {part("unstructured_part", [quote("x.text"), "', '", quote("x.link"), "', '", "cast(x.position as string)"])}, '}}')"""
    return parsed.select("page", "ver", F.expr(body).alias("value"))


def write_pages(parsed: DataFrame, path: str, per_page: bool = False) -> None:
    """JSON lines in order of page and version, in files of good size, however many pages there are or versions one has.

    ``per_page``: a folder per page title's slug with one file instead; pages with one slug share it. That is a file per
    page, for small exports.
    """
    rows = page_lines(parsed)
    if not per_page:
        rows.repartitionByRange("page", "ver").sortWithinPartitions("page", "ver").select("value").write.text(path)
        return
    rows = rows.withColumn("slug", F.coalesce(F.nullif(slug(F.col("page")), F.lit("")), F.lit("_")))
    rows.repartition("slug").sortWithinPartitions("slug", "page", "ver").select("slug", "value").write.partitionBy("slug").text(path)


def write_diffs(diffs: DataFrame, path: str) -> None:
    """JSON lines of ``page, ver1, ver2, diff``."""
    diffs.select("page", "ver1", "ver2", "diff").write.option("ignoreNullFields", "false").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """JSON lines of ``P1, P2, revision, count``."""
    counts.select("P1", "P2", "revision", "count").write.option("ignoreNullFields", "false").json(path)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIFF).json(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNT).json(path)


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    """``page`` and all seven statistics of the CSV files of a folder, as ``write_statistics`` writes them merged."""
    return spark.read.option("header", "true").option("mode", "FAILFAST").option("escape", '"').option("pathGlobFilter", "*.csv").schema(f"{FIRST}, {SECOND.removeprefix('page string, ')}").csv(folder)


def read_statistics(spark: SparkSession, folder: str, kind: int, last_wins: bool = False, pattern: str | None = None) -> DataFrame:
    """Shards ``statistics<kind>*.csv`` (or files of another pattern) of a folder; values that aren't whole numbers raise.

    ``last_wins``: of rows of one page within a shard, the last counts; across shards pages must differ (``shard_union``).
    """
    rows = spark.read.option("header", "true").option("mode", "FAILFAST").option("escape", '"').option("pathGlobFilter", pattern or f"statistics{kind}*.csv").schema(FIRST if kind == 1 else SECOND).csv(folder)
    if not last_wins:
        return rows
    values = [c for c in rows.columns if c != "page"]
    order = F.struct(F.monotonically_increasing_id().alias("n"), *values)
    return rows.withColumn("shard", F.input_file_name()).withColumn("x", order).groupBy("shard", "page").agg(F.max("x").alias("x")).select("page", *[F.col(f"x.{c}").alias(c) for c in values])


def write_statistics(rows: DataFrame, path: str) -> None:
    """CSV with a header; text quoted, numbers bare."""
    text = [c for c, kind in rows.dtypes if kind == "string"]
    head = ",".join(f'"{c}"' for c in rows.columns)
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) if c in text else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    rows.select(F.concat_ws(",", *cells).alias(head)).write.option("header", "true").option("quote", "").option("escape", "").option("sep", "\x01").csv(path)


def write_xml_parts(pages: DataFrame, xml: str, bucket: str, path: str, order: tuple[str, ...] = ()) -> None:
    """One well-formed XML file per value of ``bucket``, in a folder of its own, its pages in the order given.

    Each file is written as a stream: its rows are sorted, never gathered.
    """
    frame = pages.select(bucket).distinct()
    keys = [F.col(c) for c in order]
    none = [F.lit(None).cast(dict(pages.dtypes)[c]).alias(f"_o{i}") for i, c in enumerate(order)]
    own = [c.alias(f"_o{i}") for i, c in enumerate(keys)]
    rows = pages.select(bucket, F.lit(1).alias("_kind"), *own, F.col(xml).alias("value"))
    for kind, line in ((0, "<mediawiki>"), (2, "</mediawiki>")):
        rows = rows.unionByName(frame.select(bucket, F.lit(kind).alias("_kind"), *none, F.lit(line).alias("value")))
    rows.repartition(bucket).sortWithinPartitions(bucket, "_kind", *[f"_o{i}" for i in range(len(order))]).select(bucket, "value").write.partitionBy(bucket).text(path)
