"""Queries that write with each sink and read back with each source, and their SQL.

Dumps are made of page_history: a page of three revisions for each row, the second of which is in another format where
``rev_id`` is a multiple of 3, so that it and the third don't count.
"""

from __future__ import annotations

import json
from urllib.parse import urlparse

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.operators import revisions as R
from pagelathe.plans import wiki_queries as W
from pagelathe.session import scratch, table
from pagelathe.sources import dumps, files, selection


def escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def dumped(s: SparkSession, d: str) -> str:
    """The folder of a dump of page_history."""
    title, who = escaped("title"), escaped("coalesce(contributor, '')")
    revision = lambda ver, form, text: f"'<revision><timestamp>', {ver}, '</timestamp><contributor><username>', {who}, '</username></contributor><format>', {form}, '</format><text>', {text}, '</text></revision>'"
    xml = f"""concat('<page><title>', {title}, '</title>', {revision("coalesce(timestamp, '')", "' text/x-wiki'", title)},
        {revision("'second'", "if(rev_id % 3 = 0, 'application/json', 'text/x-wiki')", "rev_id")}, {revision("'third'", "'text/x-wiki'", "'x'")}, '</page>')"""
    path = scratch(s, "dump")
    table(s, d, "page_history").where("title is not null and rev_id is not null").selectExpr(f"{xml} as value").write.option("compression", "bzip2").text(path)
    return path


def versions(pages: DataFrame) -> DataFrame:
    return dumps.kept_revisions(pages).select("page", F.coalesce("ver", F.lit("")).alias("ver"), "contributor", "text", "rev_ord")


def online(s: SparkSession, d: str, in_memory: bool) -> DataFrame:
    """The same dump, served with its status file from the shared folder."""
    path = dumped(s, d)
    found = {str(i): {"url": "/" + r.path.rsplit("/", 1)[1], "md5": r.md5, "size": r["size"]} for i, r in enumerate(dumps.checked_files(s, path).collect())}
    status = {"jobs": {"articlesdump": {"status": "done", "files": found}}}
    fs, root = FileSystem.from_uri(path)
    fs.create_dir(f"{root}/wikidatawiki/1")
    with fs.open_output_stream(f"{root}/wikidatawiki/1/dumpstatus.json") as out:
        out.write(json.dumps(status).encode())
    endpoint = path if urlparse(path).scheme else f"file://{path}"
    return versions(dumps.online_pages(s, endpoint, "1", None, in_memory, scratch(s, "fetched")))


def smallest(s: SparkSession, d: str) -> DataFrame:
    """The listing of page_files as a dump's status, smallest first."""
    rows = table(s, d, "page_files").where("n_bytes is not null").groupBy(F.pmod("file_id", F.lit(97)).alias("k")).agg(F.sum("n_bytes").alias("n")).where("k is not null").orderBy("k").collect()
    status = {"jobs": {"articlesdump": {"status": "done", "files": {str(r.k): {"url": f"/{r.k}", "md5": "", "size": r.n} for r in rows}}}}
    found = dumps.listed_files(status, most=10)
    return s.createDataFrame([(f.url, f.size) for f in found], "url string, size bigint")


def written_and_read(write, read, rows: DataFrame, label: str, *args) -> DataFrame:
    path = scratch(rows.sparkSession, label)
    write(rows, path)
    return read(rows.sparkSession, path, *args)


def json_pages(s, d):
    back = written_and_read(files.write_pages, files.read_pages, W.token_pages(s, d).where("unstructured_part is not null"), "json")
    tokens = F.array_join(F.expr("transform(unstructured_part, t -> concat(t.text, '|', coalesce(t.link, '-'), '|', t.position))"), " ")
    return back.select("page", "ver", "contributor", F.md5(tokens).alias("tokens"))


def json_diffs(s, d):
    back = written_and_read(files.write_diffs, files.read_diffs, table(s, d, "page_diffs"), "diffs")
    shown = F.array_join(F.expr("transform(diff, x -> concat(x.action, x.position, '|', array_join(x.tokens, '|')))"), " ")
    return back.select("page", "ver1", "ver2", F.md5(shown).alias("diff"))


def single(s, d):
    """All parameter names as one page of wikitext in one file."""
    names = table(s, d, "infobox_params").where("name is not null").agg(F.array_join(F.sort_array(F.collect_list("name")), "\n").alias("value"))
    path = scratch(s, "single")
    names.coalesce(1).write.text(path)
    parsed = R.parsed_pages(dumps.single_page(s, path))
    return parsed.select(F.explode("unstructured_part").alias("t")).select("t.text", "t.position")


def statistics1(s, d):
    return written_and_read(files.write_statistics, files.read_statistics, W.firsts(s, d), "csv", 1, False, "*.csv")


def statistics2(s, d):
    return written_and_read(files.write_statistics, files.read_statistics, R.edit_statistics(table(s, d, "page_diffs").where("page is not null")), "csv", 2, False, "*.csv")


def merged(s, d):
    return written_and_read(files.write_statistics, files.read_merged, W.merged(s, d).where("page is not null"), "csv")


def xml_parts(s, d):
    titles = table(s, d, "page_tokens").where("title is not null").select("title").distinct()
    parts = selection.chunks(titles.withColumn("xml", F.expr(f"concat('<page><title>', {escaped('title')}, '</title></page>')")), ["title"], 50)
    path = scratch(s, "xml")
    files.write_xml_parts(parts, "xml", "chunk", path, ("title",))
    whole = s.read.text(path, wholetext=True)
    return whole.select(F.col("chunk").cast("bigint").alias("chunk"), F.md5("value").alias("md5"))


def titles_in_xml(s, d):
    xml = F.expr(f"concat('<mediawiki><page>\n  <ns>0</ns>\n  <title>', {escaped('title')}, '</title><revision><text>&lt;title&gt;no&lt;/title&gt;</text></revision></page>')")
    rows = table(s, d, "page_history").select("rev_id", F.when(F.col("rev_id") % 5 != 0, xml).otherwise(F.lit("<page><ns>0</ns></page>")).alias("xml"))
    return rows.select("rev_id", selection.title_of(F.col("xml")).alias("found"))


def tokens_in_order(s, d):
    """Page lines in the order in which they are exported."""
    path = scratch(s, "ordered")
    files.write_pages(W.token_pages(s, d).where("page is not null and unstructured_part is not null"), path)
    lines = s.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.get_json_object("value", "$.title").alias("page"))
    ends = lines.groupBy("file").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.count(F.lit(1)).alias("n"))
    return ends.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


QUERIES = {
    "dump_revisions": lambda s, d: versions(dumps.read_dump(s, dumped(s, d))),
    "contributor_null": lambda s, d: versions(dumps.read_dump(s, dumped(s, d))).where("contributor is null").select("page", "ver"),
    "online_pages": lambda s, d: online(s, d, False),
    "online_in_memory": lambda s, d: online(s, d, True),
    "smallest_files": smallest,
    "single_wikitext": single,
    "json_pages": json_pages,
    "json_diffs": json_diffs,
    "json_counts": lambda s, d: written_and_read(files.write_counts, files.read_counts, R.link_counts(R.page_links(W.all_pages(s, d))), "counts"),
    "csv_statistics1": statistics1,
    "csv_statistics2": statistics2,
    "csv_merged": merged,
    "xml_parts": xml_parts,
    "xml_titles": titles_in_xml,
    "export_order": tokens_in_order,
}

HISTORY = "rows as (select * from page_history where title is not null and rev_id is not null)"
WHO = "nullif(trim(contributor, ' ' || chr(9) || chr(10) || chr(13)), '')"
REVISIONS = f"""{HISTORY}, revisions as (select title as page, coalesce(timestamp, '') as ver, {WHO} as contributor, title as text, 0 as rev_ord from rows
  union all select title, 'second', {WHO}, cast(rev_id as varchar), 1 from rows where rev_id % 3 <> 0
  union all select title, 'third', {WHO}, 'x', 2 from rows where rev_id % 3 <> 0)"""
ESCAPED = escaped("title")

ORACLE = {
    **{name: f"with {REVISIONS} select * from revisions" for name in ("dump_revisions", "online_pages", "online_in_memory")},
    "contributor_null": f"with {REVISIONS} select page, ver from revisions where contributor is null",
    "smallest_files": "select '/' || (file_id % 97) as url, cast(sum(n_bytes) as bigint) as size from page_files where n_bytes is not null and file_id is not null group by file_id % 97 order by size, file_id % 97 limit 10",
    "single_wikitext": "select w[i] as text, cast(i as integer) as position from (select w, unnest(range(1, len(w) + 1)) as i from (select regexp_extract_all(string_agg(name, chr(10) order by name), '[\\p{L}\\p{N}_]+') as w from infobox_params))",
    "json_pages": "select title as page, timestamp as ver, contributor, md5(array_to_string(list_transform(unstructured_part, lambda x: x.text || '|' || coalesce(x.link, '-') || '|' || x.position), ' ')) as tokens from page_tokens where unstructured_part is not null",
    "json_diffs": "select page, ver1, ver2, md5(array_to_string(list_transform(diff, lambda x: x.action || x.position || '|' || array_to_string(x.tokens, '|')), ' ')) as diff from page_diffs",
    "json_counts": W.ORACLE["link_counts"],
    "csv_statistics1": W.ORACLE["shard_union"],
    "csv_statistics2": f"select * from ({W.ORACLE['stats2']}) where page is not null",
    "csv_merged": f"select * from ({W.ORACLE['merge_stats_full']}) where page is not null",
    "xml_parts": f"""select chunk, md5('<mediawiki>' || chr(10) || string_agg('<page><title>' || {ESCAPED} || '</title></page>' || chr(10), '' order by title) || '</mediawiki>' || chr(10)) as md5
from (select title, (row_number() over (order by title) - 1) // 50 as chunk from (select distinct title from page_tokens where title is not null)) group by chunk""",
    "xml_titles": f"select rev_id, case when rev_id % 5 <> 0 then nullif({ESCAPED}, '') end as found from page_history",
    "export_order": "select count(*) as n, min(title) as low, max(title) as high from page_tokens where title is not null and unstructured_part is not null",
}
