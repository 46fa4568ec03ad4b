"""Queries of the general problems 1 to 5, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagelathe.functions.text import utc_text
from pagelathe.functions.values import MONTHS, SCALES, UNKNOWN
from pagelathe.operators import compaction, history, nested, skew, wide
from pagelathe.session import table

def wide_columns(s, d):
    """The wide table with decimals as doubles and dates as text, in which any engine writes them alike."""
    wide_rows = wide.wide_table(table(s, d, "page_history"), table(s, d, "infobox_params"))
    shown = {"decimal": "double", "date": "string"}
    return wide_rows.select(*[F.col(c).cast(shown.get(kind.partition("(")[0], kind)).alias(c) for c, kind in wide_rows.dtypes])


QUERIES = {
    "p1_found": lambda s, d: history.found_periods(table(s, d, "page_history")),
    "p1_periods": lambda s, d: history.attribute_periods(table(s, d, "page_history")).select(
        "title", "name", "text", utc_text(F.col("valid_from")).alias("valid_from"), F.coalesce(utc_text(F.col("valid_to")), F.lit("")).alias("valid_to")
    ),
    "p2_found": lambda s, d: nested.flatten_pages(table(s, d, "raw_pages")).found(),
    "p2_pages": lambda s, d: nested.flatten_pages(table(s, d, "raw_pages")).pages(),
    "p2_revisions": lambda s, d: nested.flatten_pages(table(s, d, "raw_pages")).revisions(),
    "p2_contributors": lambda s, d: nested.flatten_pages(table(s, d, "raw_pages")).contributors(),
    "p2_texts": lambda s, d: nested.flatten_pages(table(s, d, "raw_pages")).texts(),
    "p3_found": lambda s, d: compaction.compacted(table(s, d, "page_files")).select("title", "ver"),
    "p4_found": lambda s, d: skew.heavy_pages(table(s, d, "statistics1")),
    "p4_results": lambda s, d: skew.page_results(table(s, d, "statistics1")),
    "p4_row_shares": lambda s, d: row_shares(table(s, d, "statistics1")),
    "p5_found": lambda s, d: wide.found_cells(table(s, d, "page_history"), table(s, d, "infobox_params")),
    "p5_wide": wide_columns,
}


def row_shares(stats):
    """Each row with revs and a page (its total is that of all such rows), beside its page's rows and total: a skewed side joined with one row per page."""
    rows = skew.statistics_rows(stats, ("page", "revs")).where("revs is not null and page is not null")
    plan = skew.page_loads(stats)
    return skew.fragment_replicate_join(rows, skew.page_results(stats, plan), "page", skew.SPREAD, plan=plan).drop("own")


#: A title by the title rule, and statistics1 with each named row once (the one written last).
TITLE = "upper(substr(trim(regexp_replace({0}, '[_\\s]+', ' ', 'g')), 1, 1)) || substr(trim(regexp_replace({0}, '[_\\s]+', ' ', 'g')), 2)"
STATS = f"""stats as (select shard, row_no, nullif({TITLE.format("page")}, '') as page, revs from (
  select *, row_number() over (partition by shard, row_no order by written_at desc) as rn from statistics1) where rn = 1)"""
INSTANT = "cast(try_cast(case when regexp_matches(timestamp, '([zZ]|[+-]\\d\\d:?\\d\\d)$') then timestamp else timestamp || 'Z' end as timestamptz) as timestamptz)"
NAME = "regexp_replace(lower(trim(p.name, ' ' || chr(9) || chr(10) || chr(13))), '[\\s_-]+', '_', 'g')"
TEXT = "trim(regexp_replace(coalesce(p.text, ''), '[\\s\\x{a0}]+', ' ', 'g'))"
UTC = "strftime(timezone('UTC', {0}), '%Y-%m-%dT%H:%M:%SZ')"
VERSIONS = f"""versions as (select title, vt, structured_part from (
  select nullif({TITLE.format("title")}, '') as title, {INSTANT} as vt, structured_part,
    row_number() over (partition by {TITLE.format("title")}, {INSTANT} order by loaded_at desc, rev_id desc) as rn
  from page_history where structured_part is not null and {INSTANT} is not null) where rn = 1 and title is not null)"""
PERIODS = f"""with {VERSIONS},
numbered as (select *, row_number() over (partition by title order by vt) as v, lead(vt) over (partition by title order by vt) as following from versions),
entries as (select title, vt, v, following, unnest(structured_part) as p, generate_subscripts(structured_part, 1) as i from numbered),
named as (select title, vt, v, following, {NAME} as name, {TEXT} as text, i from entries where p.name is not null),
lasts as (select * from (select *, row_number() over (partition by title, v, name order by i desc) as rn from named) where rn = 1 and text <> '' and name <> ''),
runs as (select *, case when lag(v) over w = v - 1 and lag(text) over w = text then 0 else 1 end as starts from lasts window w as (partition by title, name order by v)),
grouped as (select *, sum(starts) over (partition by title, name order by v) as g from runs)
select title, name, min(text) as text, {UTC.format("min(vt)")} as valid_from,
  coalesce({UTC.format("arg_max_null(following, v)")}, '') as valid_to
from grouped group by title, name, g"""



def listed(j: str) -> str:
    """The objects of a JSON list, or the one object in its place."""
    return f"list_filter(case json_type({j}) when 'ARRAY' then json_extract({j}, '$[*]') when 'OBJECT' then [{j}] else [] end, lambda o: json_type(o) = 'OBJECT')"


def shown(j: str, part: str = "x") -> str:
    """The text of a JSON member in any of its shapes."""
    one = lambda v: f"case json_type({v}) when 'OBJECT' then {v} ->> '#text' when 'ARRAY' then null when 'NULL' then null else {v} ->> '$' end"
    return f"(case json_type({j}) when 'ARRAY' then nullif(array_to_string(list_transform(json_extract({j}, '$[*]'), lambda {part}: {one(part)}), ''), '') else {one(j)} end)"


def counted(j: str) -> str:
    return f"try_cast(trim({shown(j)}) as bigint)"


def fullest(*columns: str) -> str:
    """Of rows with one key the one with the most that sorts last."""
    filled = " + ".join(f"cast({c} is not null as integer)" for c in columns)
    return f"qualify row_number() over (partition by pk order by {filled} desc, {', '.join(f'{c} desc nulls last' for c in columns)}) = 1"


BLANK = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
RECORDS = f"""bodies as (select cast(b as json) as j from (select trim(body, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(65279) || chr(8203) || chr(8204) || chr(8205) || chr(8288)) as b from raw_pages) where json_valid(b)),
page_rows as (select unnest(case when (j -> 'mediawiki') is not null then {listed("(j -> 'mediawiki' -> 'page')")} when (j -> 'page') is not null then {listed("(j -> 'page')")} else {listed("j")} end) as p from bodies),
pages as (select {counted("(p -> 'id')")} as page_id, {shown("(p -> 'title')")} as title, {counted("(p -> 'ns')")} as ns, p from page_rows),
revs as (select page_id, {counted("(r -> 'id')")} as rev_id, r from (select page_id, unnest({listed("(p -> 'revision')")}) as r from pages)),
people as (select distinct page_id, rev_id, {BLANK.format(shown("(r -> 'contributor' -> 'username')"))} as username, {BLANK.format(shown("(r -> 'contributor' -> 'ip')"))} as ip, {counted("(r -> 'contributor' -> 'id')")} as user_id from revs),
named as (select *, coalesce(nullif(username, ''), nullif(ip, ''), '') as contributor from people),
slots as (select page_id, rev_id, 'main' as role, {shown("(r -> 'text')")} as text from revs
  union all select page_id, rev_id, {BLANK.format(shown("(s -> 'role')"))}, {shown("(s -> 'text')")} from (select page_id, rev_id, unnest(list_concat({listed("(r -> 'slots')")}, {listed("(r -> 'slots' -> 'slot')")})) as s from revs)),
texts as (select distinct page_id, rev_id, role, text from slots where {BLANK.format("text")} <> '')"""
KEYS = "'p' || page_id || '/r' || rev_id || '{0}' as pk, 'p' || page_id || '{1}' as parent, page_id, rev_id"
GROUPED = "'^[+−-]?\\s?\\d{1,3}(?:[ ,''’]\\d{3})+(?:\\D.*)?$'"
SCALE = "|".join(SCALES)
RANGE = "'^\\s*(?:\\[[^\\]]*\\]\\s*)?(?:[-–—−/~]|\\.\\.+|to|or|and|until|till|through|bis)\\s*[+−-]?\\d'"
MONTH = "list_position([" + ", ".join(f"'{m}'" for m in MONTHS) + "], lower(substr({0}, 1, 3)))"
DAY = "'^\\s*(?:[-–—−/~]|to\\b|or\\b|until\\b|and\\b)\\s*(?:\\d|[a-z]{3,9}\\.?\\s\\d)'"
DATES = {  # pattern, and year, month and day from its groups
    "'^(\\d{4})-(\\d{1,2})-(\\d{1,2})((?:\\D.*)?)$'": ("g[1]", "g[2]", "g[3]"),
    "'^(\\d{4})/(\\d{1,2})/(\\d{1,2})((?:\\D.*)?)$'": ("g[1]", "g[2]", "g[3]"),
    "'^(\\d{4})\\.(\\d{1,2})\\.(\\d{1,2})((?:\\D.*)?)$'": ("g[1]", "g[2]", "g[3]"),
    "'^(\\d{1,2})\\.\\s?(\\d{1,2})\\.\\s?(\\d{4})((?:\\D.*)?)$'": ("g[3]", "g[2]", "g[1]"),
    "'^(\\d{1,2})(?:st|nd|rd|th)?\\.?\\s(?:day\\s)?(?:of\\s)?([A-Za-z]{3,9})\\.?,?\\s(\\d{3,4})((?:\\D.*)?)$'": ("g[3]", MONTH.format("g[2]"), "g[1]"),
    "'^([A-Za-z]{3,9})\\.?\\s(\\d{1,2})(?:st|nd|rd|th)?,?\\s(\\d{3,4})((?:\\D.*)?)$'": ("g[3]", MONTH.format("g[1]"), "g[2]"),
}


def date_sql(pattern: str, y: str, m: str, d: str) -> str:
    group = lambda x: re.sub(r"g\[(\d)\]", rf"regexp_extract(t, {pattern.replace(chr(92), chr(92) * 2)}, \1)", x)
    day = f"lpad({group(y)}, 4, '0') || '-' || lpad(cast({group(m)} as varchar), 2, '0') || '-' || lpad({group(d)}, 2, '0')"
    return f"when regexp_matches(t, {pattern}) then case when not regexp_matches(lower({group('g[4]')}), {DAY}) then cast(try_cast({day} as date) as varchar) end"


CELLS = f"""{VERSIONS}, lasts as (select title, structured_part from (select *, row_number() over (partition by title order by vt desc) as rn from versions) where rn = 1),
entries as (select title, unnest(structured_part) as p, generate_subscripts(structured_part, 1) as i from lasts),
fed as (select e.title, i, c.column_name, c.column_type, {TEXT} as t from entries e join infobox_params c on {NAME} = c.name where c.column_name is not null),
told as (select * from fed where t <> '' and (column_type = 'bool' or lower(trim(regexp_replace(t, '\\[[^\\[\\]]*\\]', '', 'g'))) not in ({", ".join(f"'{u}'" for u in UNKNOWN)}))),
cut as (select *, case when regexp_matches(t, {GROUPED}) then regexp_extract(t, '^([+−-]?)\\s?(\\d{{1,3}}(?:[ ,''’]\\d{{3}})+)(?:[.,](\\d+))?(.*)$', ['sign', 'whole', 'fraction', 'rest'])
  else regexp_extract(t, '^([+−-]?)\\s?(\\d+)(?:[.,](\\d+))?(.*)$', ['sign', 'whole', 'fraction', 'rest']) end as x from told),
scaled as (select *, regexp_replace(x.rest, '^\\s*(?:{SCALE})\\b', '', 'i') as after,
  coalesce(map {{{", ".join(f"'{k}': {v}" for k, v in SCALES.items())}}}[lower(regexp_extract(x.rest, '^\\s*([A-Za-z]+)(?:[^A-Za-z²³\\d]|$)', 1))], 0) as power from cut),
numbered as (select *, case when x.whole <> '' and not regexp_matches(x.rest, {RANGE}) and not regexp_matches(after, {RANGE}) and not regexp_matches(x.rest, '^[\\d.,:/%°^]*\\d') and not regexp_matches(x.rest, '^\\s\\d')
  then cast(regexp_replace(x.whole, '\\D', '', 'g') || '.' || case when x.fraction = '' then '0' else x.fraction end as decimal(38, 12)) * cast(pow(10, power) as bigint) * case when x.sign in ('-', '−') then -1 else 1 end end as number from scaled),
shown as (select title, column_name, column_type, i, case column_type when 'string' then t
  when 'bool' then map {{'yes': 'true', 'y': 'true', 'true': 'true', 't': 'true', '1': 'true', 'no': 'false', 'n': 'false', 'false': 'false', 'f': 'false', '0': 'false'}}[lower(regexp_extract(t, '^([A-Za-z0-9]+)[.!]?\\s*(?:[\\[(;,].*)?$', 1))]
  when 'int' then case when number = floor(number) then cast(cast(number as bigint) as varchar) end
  when 'decimal' then case when number = floor(number) then cast(cast(number as bigint) as varchar) else rtrim(cast(number as varchar), '0') end
  when 'date' then case {" ".join(date_sql(k, *v) for k, v in DATES.items())} end end as cell from numbered),
cells as (select title, column_name, any_value(column_type) as column_type, arg_max(cell, i) as cell from shown where cell is not null group by title, column_name)"""
#: The columns of the wide table, which are fixed, by type.
WIDE = {"bigint": ["bridges", "collection", "crew", "elevation_m", "population", "tracks", "visitors"], "double": ["area_km2", "displacement_t", "length_km"], "boolean": ["is_live", "is_protected"], "varchar": ["country", "fate", "founded", "genre", "launched", "mouth", "opened", "released"]}

ORACLE = {
    "p2_found": f"with {RECORDS} select distinct t.page_id, t.rev_id, n.contributor, t.role from texts t join named n on t.page_id = n.page_id and t.rev_id = n.rev_id",
    "p2_pages": f"with {RECORDS} select distinct 'p' || page_id as pk, page_id, title, ns from pages",
    "p2_revisions": f"""with {RECORDS}, rows as (select distinct {KEYS.format("", "")}, {counted("(r -> 'parentid')")} as parentid, {shown("(r -> 'timestamp')")} as timestamp, {shown("(r -> 'format')")} as format, {shown("(r -> 'comment')")} as comment from revs)
select * from rows {fullest("parentid", "timestamp", "format", "comment")}""",
    "p2_contributors": f"""with {RECORDS}, rows as (select {KEYS.format("/c", "/r' || rev_id || '")}, username, ip, user_id, contributor from named) select * from rows {fullest("username", "ip", "user_id")}""",
    "p2_texts": f"with {RECORDS} select distinct 'p' || page_id || '/r' || rev_id || '/t:' || role as pk, 'p' || page_id || '/r' || rev_id as parent, page_id, rev_id, role, text from texts",
    "p5_found": f"with {CELLS} select title, column_name, cell from cells",
    "p5_wide": f"with {CELLS} select l.title, " + ", ".join(f"cast(max(case when column_name = '{c}' then cell end) as {kind}) as {c}" for kind, names in WIDE.items() for c in names) + " from lasts l left join cells c on l.title = c.title group by l.title",
    "p1_found": f"select title, name, valid_from, valid_to from ({PERIODS})",
    "p1_periods": PERIODS,
    "p3_found": """with lines as (select unnest(string_split_regex(body, '\\r\\n|\\n|\\r')) as line from page_files),
bare as (select trim(line, ' ' || chr(9) || chr(0) || chr(65279) || chr(8203) || chr(8204) || chr(8205) || chr(8288)) as line from lines)
select distinct line ->> 'title' as title, line ->> 'timestamp' as ver from (select case when line like '{%' and json_valid(line) then cast(line as json) end as line from bare)
where json_type(line, '$.title') = 'VARCHAR' and json_type(line, '$.timestamp') = 'VARCHAR' and trim(line ->> 'title') <> '' and trim(line ->> 'timestamp') <> ''""",
    "p4_found": f"with {STATS} select page from stats where revs is not null group by page having page is not null and count(*) >= 0.01 * (select count(*) from stats where revs is not null)",
    "p4_results": f"with {STATS} select page, count(*) as n_rows, cast(sum(revs) as bigint) as total_revs, max(revs) as largest_revs from stats where revs is not null and page is not null group by page",
    "p4_row_shares": f"""with {STATS} select shard, row_no, page, revs, count(*) over w as n_rows, cast(sum(revs) over w as bigint) as total_revs, max(revs) over w as largest_revs
from stats where revs is not null and page is not null window w as (partition by page)""",
}
