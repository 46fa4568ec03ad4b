"""Queries of the revision analytics, and the SQL of those that SQL can express.

Pages with their tokens come from page_tokens, versions with their parameters from page_history, edits from page_diffs,
page statistics from statistics1, and wikitexts with versions from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.text import slug
from pagelathe.functions.wikitext import MEDIA
from pagelathe.operators import nested
from pagelathe.operators import revisions as R
from pagelathe.operators import statistics as S
from pagelathe.session import table, written
from pagelathe.sources import dumps, files, selection


def token_pages(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<struct<name: string, text: string, link: string>>")
    return table(s, d, "page_tokens").select(F.col("title").alias("page"), F.col("timestamp").alias("ver"), "contributor", none.alias("structured_part"), "unstructured_part")


def box_pages(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<struct<text: string, link: string, position: int>>")
    return table(s, d, "page_history").select(F.col("title").alias("page"), F.col("timestamp").alias("ver"), "contributor", "structured_part", none.alias("unstructured_part"))


def all_pages(s: SparkSession, d: str) -> DataFrame:
    return token_pages(s, d).unionByName(box_pages(s, d))


def texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("page", "ver", F.lit(None).cast("string").alias("contributor"), "text")


def versioned(s: SparkSession, d: str) -> DataFrame:
    """The texts that can be compared with another version: those with page and version."""
    return texts(s, d).where("page is not null and ver is not null")


def word_pages(s: SparkSession, d: str) -> DataFrame:
    """The versioned texts as plain words: no markup is read, so everything stays in the JVM."""
    words = F.expr(r"transform(regexp_extract_all(text, '([\\p{L}\\p{N}_]+)', 1), (w, i) -> struct(w as text, cast(null as string) as link, i + 1 as position))")
    return versioned(s, d).select("page", "ver", words.alias("unstructured_part"))


def firsts(s: SparkSession, d: str) -> DataFrame:
    """One row of statistics per page spelling: the largest values of its rows."""
    return table(s, d, "statistics1").where("page is not null").groupBy("page").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in S.FIRST])


def merged(s: SparkSession, d: str, how: str = "full") -> DataFrame:
    return S.merge_statistics(firsts(s, d), R.edit_statistics(table(s, d, "page_diffs")), how)


def ratios(s, d):
    data = written(merged(s, d), "merged").withColumn("rev_inss", F.col("revs") + F.col("inss")).withColumn("rev_dels", F.col("revs") + F.col("dels"))
    kinds = (("insertion", "revs", "rev_inss", "inss <> 0"), ("deletion", "revs", "rev_dels", "dels <> 0"), ("removed", "removed_tokens", "added_tokens", "true"))
    parts = [S.ratio_histogram(data.where(w), n, m).select(F.lit(k).alias("kind"), "bin", "n") for k, n, m, w in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bins(s, d):
    data = written(firsts(s, d), "firsts")
    parts = [S.bin_counts(data, c).select(F.lit(c).alias("value"), "bin", "label", "lo", "hi", "n") for c in S.EDGES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def net_tokens(s, d):
    counts = R.edit_counts(R.page_diffs(word_pages(s, d)))
    return counts.select("page", "ver1", "ver2", (F.col("added_tokens") - F.col("removed_tokens")).alias("net")).where("net <> 0")


def links_in_text(s, d):
    inner = F.explode(F.expr(r"regexp_extract_all(text, '\\[\\[([^\\[\\]\\n]*)\\]\\]', 1)"))
    rows = table(s, d, "documents").select("doc_id", inner.alias("inner"))
    shown = F.trim(F.substring_index("inner", "|", -1))
    title = F.substring_index(F.substring_index("inner", "|", 1), "#", 1)
    return rows.select("doc_id", title.alias("link"), F.when(F.col("inner").contains("|") & (shown != ""), shown).otherwise(title).alias("shown"))


def boxes(s, d):
    docs = table(s, d, "documents").where("doc_id is not null")
    parsed = R.parsed_pages(docs.select(F.col("doc_id").cast("string").alias("page"), F.lit("").alias("ver"), F.lit(None).cast("string").alias("contributor"), "text"))
    return parsed.select(F.col("page").cast("bigint").alias("doc_id"), F.explode("structured_part").alias("x")).select("doc_id", "x.name", "x.text")


def roundtrip(s, d):
    lines = files.page_lines(token_pages(s, d).where("unstructured_part is not null"))
    back = lines.select(F.from_json("value", files.LINE).alias("x"))
    tokens = F.array_join(F.expr("transform(x.unstructured_part, t -> concat(t[0], '|', coalesce(t[1], '-'), '|', t[2]))"), " ")
    return back.select(F.col("x.title").alias("page"), F.col("x.timestamp").alias("ver"), F.md5(tokens).alias("tokens"))


def stopped(s, d):
    """Revisions of every page of raw_pages, in any wrapping and shape, up to the page's first in another format; repeats included."""
    return dumps.kept_revisions(nested.page_records(table(s, d, "raw_pages"))).select("page", "ver", "contributor", "rev_ord")


QUERIES = {
    "revs_per_page": lambda s, d: token_pages(s, d).groupBy("page").agg(F.count(F.lit(1)).alias("revs")),
    "tokens_per_page": lambda s, d: token_pages(s, d).groupBy("page").agg(F.sum(F.coalesce(F.size("unstructured_part"), F.lit(0)).cast("bigint")).alias("tokens")),
    "avg_tokens": lambda s, d: R.page_statistics(token_pages(s, d)).select("page", "avg_tokens"),
    "stats1": lambda s, d: R.page_statistics(all_pages(s, d)),
    "token_explode": lambda s, d: token_pages(s, d).select("page", F.explode("unstructured_part").alias("t")).select("page", F.col("t.text").alias("text"), F.col("t.position").alias("position")),
    "entity_mark": lambda s, d: R.page_tokens(token_pages(s, d)),
    "revision_links": lambda s, d: R.page_links(all_pages(s, d)),
    "links_distinct": lambda s, d: R.page_links(all_pages(s, d)).select("page", "link").distinct().groupBy("page").agg(F.count(F.lit(1)).alias("links")),
    "link_counts": lambda s, d: R.link_counts(R.page_links(all_pages(s, d))),
    "version_index": lambda s, d: R.version_index(box_pages(s, d).where("page is not null and ver is not null")),
    "version_pairs": lambda s, d: R.version_pairs(box_pages(s, d)),
    "version_pairs_selfjoin": lambda s, d: paired(R.version_index(box_pages(s, d).where("page is not null and ver is not null"))),
    "ts_set": lambda s, d: box_pages(s, d).select("page", "ver").distinct(),
    "token_seq": lambda s, d: R.token_sequences(token_pages(s, d)).select("page", "ver", F.md5(F.array_join("tokens", " ")).alias("tokens")),
    "diff_ops": lambda s, d: R.page_diffs(R.parsed_pages(versioned(s, d))).where("size(diff) > 0"),
    "diff_net_tokens": net_tokens,
    "nonempty_diff": lambda s, d: table(s, d, "page_diffs").where("size(diff) > 0").select("diff_id", "page", "ver1", "ver2", F.size("diff").cast("bigint").alias("ops")),
    "edit_counts": lambda s, d: R.edit_counts(table(s, d, "page_diffs")),
    "stats2": lambda s, d: R.edit_statistics(table(s, d, "page_diffs")),
    "merge_stats_full": merged,
    "merge_stats_left": lambda s, d: merged(s, d, "left"),
    "shard_union": lambda s, d: S.shard_union([firsts(s, d).where("page < 'M'"), firsts(s, d).where("page >= 'M'")]),
    "bin_counts": bins,
    "edit_ratios": lambda s, d: S.edit_ratios(merged(s, d)),
    "ratio_hist": ratios,
    "summary": lambda s, d: S.summary(merged(s, d)),
    "title_slug": lambda s, d: box_pages(s, d).where("page is not null").select("page").distinct().select("page", slug(F.col("page")).alias("slug")),
    "page_select": lambda s, d: selection.selected(table(s, d, "documents"), "text", "page", 1000, ("Museum", "\\(ship\\)")).select("doc_id"),
    "resume_after": lambda s, d: selection.resumed_after(table(s, d, "page_files").select("file_id", "title"), ["file_id"], "title", "Boge Setalo district"),
    "top_k_small": lambda s, d: table(s, d, "page_files").where("n_bytes is not null").orderBy("n_bytes", "file_id").limit(100).select("file_id", "n_bytes"),
    "page_chunks": lambda s, d: selection.chunks(token_pages(s, d).where("page is not null").select("page").distinct(), ["page"], 5),
    "page_chunks_whole": lambda s, d: selection.chunks(token_pages(s, d).where("page is not null").select("page").distinct(), ["page"], 7, 20, True),
    "rolling_parts": lambda s, d: selection.rolling_parts(table(s, d, "page_files").select("file_id", "n_bytes"), ["file_id"], F.coalesce("n_bytes", F.lit(0)), 100_000).select("file_id", "part"),
    "json_roundtrip": roundtrip,
    "namespace_filter": lambda s, d: R.page_links(all_pages(s, d)).where(~F.col("link").rlike("^(?:" + "|".join(MEDIA) + ")")).groupBy("link").agg(F.count(F.lit(1)).alias("n")),
    "wikilink_parts": links_in_text,
    "infobox_first": boxes,
    "format_truncate": stopped,
    "wikitext_tokens": lambda s, d: R.page_tokens(R.parsed_pages(texts(s, d))),
    "wikitext_stats1": lambda s, d: R.page_statistics(R.parsed_pages(texts(s, d))),
}


def paired(index: DataFrame) -> DataFrame:
    """Version pairs as a join of each version with the next."""
    a, b = index.select("page", F.col("ver").alias("ver1"), "idx"), index.select("page", F.col("ver").alias("ver2"), (F.col("idx") - 1).alias("idx"))
    return a.join(b, ["page", "idx"]).select("page", "ver1", "ver2")


LINKS = """links as (
  select title as page, timestamp as ver, u.link as link, 'U' as part from (select title, timestamp, unnest(unstructured_part) as u from page_tokens) where u.link is not null
  union all select title, timestamp, p.link, 'S' from (select title, timestamp, unnest(structured_part) as p from page_history) where p.link is not null)"""
VERSIONS = "versions as (select distinct title as page, timestamp as ver from page_history where title is not null and timestamp is not null)"
FIRSTS = "firsts as (select page, coalesce(max(revs), 0) as revs, coalesce(max(links), 0) as links, coalesce(max(avg_tokens), 0) as avg_tokens from statistics1 where page is not null group by page)"
COUNTS = """counts as (select page, ver1, ver2, len(list_filter(diff, lambda x: x.action = 'INS')) as inss, len(list_filter(diff, lambda x: x.action = 'DEL')) as dels,
  coalesce(list_sum(list_transform(list_filter(diff, lambda x: x.action = 'INS'), lambda x: len(x.tokens))), 0) as added_tokens,
  coalesce(list_sum(list_transform(list_filter(diff, lambda x: x.action = 'DEL'), lambda x: len(x.tokens))), 0) as removed_tokens from page_diffs where len(diff) > 0)"""
SECONDS = f"{COUNTS}, seconds as (select page, " + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in S.SECOND) + " from counts group by page)"
ALL = ", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in S.FIRST + S.SECOND)
MERGED = f"{FIRSTS}, {SECONDS}, merged as (select page, {ALL} from firsts full join seconds using (page))"
HIST = "select '{0}' as kind, cast(greatest((20 * {1} + {2} - 1) // {2} - 1, 0) as bigint) as bin, count(*) as n from merged where {3} and {2} <> 0 group by 1, 2"


def bin_sql(column: str) -> str:
    edges = S.EDGES[column]
    rows = ", ".join(str(e) for e in edges)
    return f"""select '{column}' as value, cast(i - 1 as integer) as bin, '[' || e[i] || '-' || case when i = len(e) - 1 then 'more' else cast(e[i + 1] as varchar) end || ')' as label, cast(e[i] as bigint) as lo, cast(e[i + 1] as bigint) as hi,
  (select count(*) from firsts where {column} > e[i] and {column} <= e[i + 1]) as n
from (select e, unnest(range(1, len(e))) as i from (select case when top > {edges[-1]} then [{rows}, top] else [{rows}] end as e from (select cast(round_even((max({column}) + 50) / 100.0, 0) * 100 as bigint) as top from firsts)))"""


ORACLE = {
    "revs_per_page": "select title as page, count(*) as revs from page_tokens group by 1",
    "tokens_per_page": "select title as page, cast(sum(coalesce(len(unstructured_part), 0)) as bigint) as tokens from page_tokens group by 1",
    "avg_tokens": "select title as page, cast(ceil(sum(coalesce(len(unstructured_part), 0)) / count(*)) as bigint) as avg_tokens from page_tokens group by 1",
    "stats1": f"""with {LINKS}, rows as (select title as page, coalesce(len(unstructured_part), 0) as n from page_tokens union all select title, 0 from page_history),
per_page as (select page, count(*) as revs, sum(n) as n from rows group by page), linked as (select page, count(distinct link) as links from links group by page)
select p.page, revs, coalesce(links, 0) as links, cast(ceil(n / revs) as bigint) as avg_tokens from per_page p left join linked l on p.page is not distinct from l.page""",
    "token_explode": "select title as page, u.text as text, u.position as position from (select title, unnest(unstructured_part) as u from page_tokens)",
    "entity_mark": "select title as page, timestamp as ver, case when u.link is not null then '[E]' || u.link else u.text end as token, u.position as position, u.link as link from (select title, timestamp, unnest(unstructured_part) as u from page_tokens)",
    "revision_links": f"with {LINKS} select * from links",
    "links_distinct": f"with {LINKS} select page, count(distinct link) as links from links group by page",
    "link_counts": f"with {LINKS} select page as P1, link as P2, ver as revision, cast(count(*) as integer) as count from links group by 1, 2, 3",
    "version_index": f"with {VERSIONS} select page, ver, cast(row_number() over (partition by page order by ver) - 1 as integer) as idx from versions",
    "version_pairs": f"with {VERSIONS} select * from (select page, ver as ver1, lead(ver) over (partition by page order by ver) as ver2 from versions) where ver2 is not null",
    "version_pairs_selfjoin": f"with {VERSIONS} select * from (select page, ver as ver1, lead(ver) over (partition by page order by ver) as ver2 from versions) where ver2 is not null",
    "ts_set": "select distinct title as page, timestamp as ver from page_history",
    "token_seq": """with rows as (select title as page, timestamp as ver, list_transform(list_sort(list_transform(unstructured_part, lambda x: {'p': x.position, 't': case when x.link is not null then '[E]' || x.link else x.text end})), lambda y: {'t': y.t, 'p': y.p}) as t
  from page_tokens where len(unstructured_part) > 0)
select page, ver, md5(array_to_string(list_transform(flatten(list_sort(list(t))), lambda x: x.t), ' ')) as tokens from rows group by page, ver""",
    "diff_net_tokens": """with rows as (select page, ver, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as n from documents where page is not null and ver is not null),
versions as (select page, ver, sum(n) as n from rows where n > 0 group by page, ver)
select * from (select page, ver as ver1, lead(ver) over w as ver2, cast(lead(n) over w - n as bigint) as net from versions window w as (partition by page order by ver)) where ver2 is not null and net <> 0""",
    "nonempty_diff": "select diff_id, page, ver1, ver2, len(diff) as ops from page_diffs where len(diff) > 0",
    "edit_counts": f"with {COUNTS} select page, ver1, ver2, " + ", ".join(f"cast({c} as bigint) as {c}" for c in S.SECOND) + " from counts",
    "stats2": f"with {SECONDS} select * from seconds",
    "merge_stats_full": f"with {MERGED} select * from merged",
    "merge_stats_left": f"with {FIRSTS}, {SECONDS} select page, {ALL} from firsts left join seconds using (page)",
    "shard_union": f"with {FIRSTS} select * from firsts",
    "bin_counts": f"with {FIRSTS} " + " union all ".join(map(bin_sql, S.EDGES)),
    "edit_ratios": f"""with {MERGED} select page, case when inss <> 0 then revs / (revs + inss) end as insertion_ratio, case when dels <> 0 then revs / (revs + dels) end as deletion_ratio,
case when added_tokens <> 0 then removed_tokens / added_tokens end as removed_ratio from merged""",
    "ratio_hist": f"with {MERGED} " + " union all ".join([HIST.format("insertion", "revs", "(revs + inss)", "inss <> 0"), HIST.format("deletion", "revs", "(revs + dels)", "dels <> 0"), HIST.format("removed", "removed_tokens", "added_tokens", "true")]),
    "summary": f"with {MERGED} select count(*) as pages, cast(sum(revs) as bigint) as revisions, cast(floor(avg(avg_tokens)) as bigint) as mean_tokens, cast(floor(avg(links)) as bigint) as mean_links, cast(floor(avg(revs)) as bigint) as mean_revs from merged",
    "title_slug": "select title as page, array_to_string(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}_]'), lambda w: w <> ''), '_') as slug from (select distinct title from page_history where title is not null)",
    "page_select": "select doc_id from documents where length(text) >= 1000 and not coalesce(regexp_matches(page, 'Museum|\\(ship\\)'), false)",
    "resume_after": "select file_id, title from page_files where file_id > (select min(file_id) from page_files where title = 'Boge Setalo district')",
    "top_k_small": "select file_id, n_bytes from page_files where n_bytes is not null order by n_bytes, file_id limit 100",
    "page_chunks": "select page, (row_number() over (order by page) - 1) // 5 as chunk from (select distinct title as page from page_tokens where title is not null)",
    "page_chunks_whole": "select page, chunk from (select *, count(*) over (partition by chunk) as n from (select page, (row_number() over (order by page) - 1) // 7 as chunk from (select distinct title as page from page_tokens where title is not null))) where n = 7 and chunk < 20",
    "rolling_parts": "select file_id, cast(coalesce(sum(coalesce(n_bytes, 0)) over (order by file_id rows between unbounded preceding and 1 preceding), 0) // 100000 as bigint) as part from page_files",
    "json_roundtrip": "select title as page, timestamp as ver, md5(array_to_string(list_transform(unstructured_part, lambda x: x.text || '|' || coalesce(x.link, '-') || '|' || x.position), ' ')) as tokens from page_tokens where unstructured_part is not null",
    "namespace_filter": f"with {LINKS} select link, count(*) as n from links where not regexp_matches(link, '^(?:{'|'.join(MEDIA)})') group by link",
    "wikilink_parts": """select doc_id, split_part(split_part(i, '|', 1), '#', 1) as link,
  case when contains(i, '|') and trim(split_part(i, '|', -1)) <> '' then trim(split_part(i, '|', -1)) else split_part(split_part(i, '|', 1), '#', 1) end as shown
from (select doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]\\n]*)\\]\\]', 1)) as i from documents)""",
    "infobox_first": """with boxes as (select doc_id, regexp_extract(text, '\\{\\{(Infobox[^{}]*)\\}\\}', 1) as b from documents where doc_id is not null),
pairs as (select doc_id, unnest(string_split(b, '|')[2:]) as x from boxes where b <> '')
select doc_id, trim(split_part(x, '=', 1)) as name, array_to_string(regexp_extract_all(substr(x, instr(x, '=') + 1), '[\\p{L}\\p{N}_]+'), ' ') as text from pairs""",
}
