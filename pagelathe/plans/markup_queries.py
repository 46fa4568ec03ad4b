"""Queries of the wikitext parser on markup made of titles and names, and the SQL of what it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.operators import revisions as R
from pagelathe.session import table

#: By query: the wikitext, as SQL over title ``t`` and contributor ``c``, and its tokens, as a list of parts of SQL: ``W(x)`` the
#: words of x, ``C(x)`` the characters of x, ``T(x)`` the text x itself, ``L(shown, target)`` a link.
MARKUP = {
    "parse_words": ("t || ', ' || c", ["W(t)", "W(c)"]),
    "parse_links": ("'See [[' || t || '|' || c || ']], [[' || t || '#History]] and [[#x]].'", ["W('See')", "L(case when trim(c) <> '' then trim(c) else t end, t)", "L(t, t)", "W('and')", "L('', '')"]),
    "parse_media": ("'[[File:' || t || '.png|thumb|' || c || ' [[Rome]]]] [[:Media:' || t || ']] [[Image:' || t || '.png]] a'", ["L('Image:' || t || '.png', 'Image:' || t || '.png')", "W('a')"]),
    "parse_tags": ("'<ref name=\"x\">' || t || '</ref><br/><b>' || c || '</b><nowiki>[[' || t || ']]</nowiki></i>z'", ["W(t)", "W(c)", "W(t)", "W('i')", "W('z')"]),
    "parse_headings": ("'== ' || t || ' ==' || chr(10) || '=== [[' || t || ']] ===' || chr(10) || '* ' || c", ["W(t)", "L(t, t)", "W(c)"]),
    "parse_entities": ("'&amp;' || t || '&nbsp;&#65;&#x42;&nope;'", ["T('&')", "W(t)", "T(chr(160))", "T('A')", "T('B')", "W('nope')"]),
    "parse_external": ("'[http://a.b/c ' || t || '] [https://d.e] //x.y ' || c", ["W(t)", "T('http://a.b/c')", "W('https://d.e')", "W('x.y')", "W(c)"]),
    "parse_tables": ("'{| class=\"x\"' || chr(10) || '! ' || t || ' !! b' || chr(10) || '|-' || chr(10) || '| style=\"y\" | ' || c || ' || [[' || t || ']]' || chr(10) || '|}'", ["W(t)", "W('b')", "W(c)", "L(t, t)"]),
    "parse_ignored": ("'<!-- ' || t || ' -->{{cite|' || t || '|{{x|' || c || '}}}}{{{arg|' || t || '}}} ' || c || ' {{' || chr(10) || '}}'", ["W(c)"]),
    "magic_word": ("'{{lc:' || t || '}} {{#dateformat: ' || c || ' }} {{other:' || t || '}}'", ["C(trim(split_part(t, ':', 1)))", "C(trim(split_part(c, ':', 1)))"]),
    "parse_unbalanced": ("'[[' || t || ' {{ ' || c || ' ]] }} <b>' || t || ' {{{{'", ["W(t)", "W('b')", "W(t)"]),
}
SOURCE = "select rev_id, coalesce(title, 'x') as t, coalesce(contributor, '') as c from page_history"
NONE = "cast(null as varchar)"


def sides(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_history").selectExpr("rev_id", "coalesce(title, 'x') as t", "coalesce(contributor, '') as c")


def parsed(rows: DataFrame) -> DataFrame:
    """``rev_id`` and the parts of ``text``."""
    page = rows.select(F.col("rev_id").cast("string").alias("page"), F.lit("").alias("ver"), F.lit(None).alias("contributor"), "text")
    return R.parsed_pages(page).withColumn("rev_id", F.col("page").cast("bigint"))


def tokens(markup: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        out = parsed(sides(s, d).selectExpr("rev_id", f"{markup} as text"))
        return out.select("rev_id", F.explode("unstructured_part").alias("x")).select("rev_id", "x.text", "x.link", "x.position")

    return query


def boxes(s: SparkSession, d: str) -> DataFrame:
    """The parameters of page_history written as infoboxes, a second infobox after them, and parsed."""
    value = "if(p.link is null, coalesce(p.text, ''), concat('see [[', p.link, '|', coalesce(p.text, ''), ']]'))"
    lines = f"array_join(transform(filter(structured_part, p -> p.name is not null), p -> concat('\n| ', p.name, ' = ', {value})), '')"
    text = f"concat('{{{{Infobox thing', {lines}, '\n}}}} {{{{Infobox other|x=y}}}}')"
    out = parsed(table(s, d, "page_history").where("structured_part is not null").selectExpr("rev_id", f"{text} as text"))
    return out.select("rev_id", F.explode("structured_part").alias("x")).select("rev_id", "x.name", "x.text", "x.link")


QUERIES = {**{name: tokens(markup) for name, (markup, _) in MARKUP.items()}, "parse_infobox": boxes}


def part_sql(part: str) -> str:
    kind, inner = part[0], part[2:-1]
    if kind == "L":
        shown, target = inner.rsplit(", ", 1)
        return f"[{{'text': {shown}, 'link': {target}}}]"
    if kind == "T":
        return f"[{{'text': {inner}, 'link': {NONE}}}]"
    listed = f"regexp_extract_all({inner}, '[\\p{{L}}\\p{{N}}_]+')" if kind == "W" else f"case when {inner} = '' then [] else string_split({inner}, '') end"
    return f"list_transform({listed}, lambda w: {{'text': w, 'link': {NONE}}})"


def tokens_sql(parts: list[str]) -> str:
    joined = part_sql(parts[0])
    for part in parts[1:]:
        joined = f"list_concat({joined}, {part_sql(part)})"
    return f"""select rev_id, x.text as text, x.link as link, cast(i as integer) as position from (select rev_id, unnest(k) as x, generate_subscripts(k, 1) as i
from (select rev_id, {joined} as k from ({SOURCE})))"""


STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
WORDS = "array_to_string(regexp_extract_all(coalesce(p.text, ''), '[\\p{L}\\p{N}_]+'), ' ')"
ORACLE = {
    **{name: tokens_sql(parts) for name, (_, parts) in MARKUP.items()},
    "parse_infobox": f"""with rows as (select row_number() over () as n, rev_id, structured_part from page_history where structured_part is not null),
entries as (select n, rev_id, unnest(structured_part) as p, generate_subscripts(structured_part, 1) as i from rows)
select rev_id, {STRIP.format("p.name")} as name, case when p.link is null then {WORDS} when {STRIP.format("coalesce(p.text, '')")} <> '' then 'see ' || {STRIP.format("p.text")} else 'see ' || split_part(p.link, '#', 1) end as text, split_part(p.link, '#', 1) as link
from entries where p.name is not null qualify row_number() over (partition by n, {STRIP.format("p.name")} order by i desc) = 1""",
}
