"""Queries of the problems 6 to 9, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm import mixing, neardup, packing, reading, tokens
from pagelathe.session import table

#: p6: runs of three tokens, 0.6 of the union in common, sets of 20 runs at least.
EDITS = neardup.Rule(width=3, similarity=0.6, least=20)
KINDS = "case when kind = 0 then 'page' else 'diff' end as kind"


def token_tables(spark, d: str) -> list[DataFrame]:
    """Pages as tokens with positions, diffs as lists of tokens."""
    pages = table(spark, d, "page_tokens").where("page_id is not null and unstructured_part is not null")
    diffs = table(spark, d, "page_diffs").where("diff_id is not null and diff is not null")
    return [
        pages.select(F.col("page_id").alias("id"), F.col("unstructured_part.text").alias("tokens"), F.col("unstructured_part.position").alias("positions")),
        diffs.select(F.col("diff_id").alias("id"), F.col("diff.tokens").alias("tokens")),
    ]


def p6_found(spark, d: str) -> DataFrame:
    return neardup.all_pairs(neardup.near_duplicates(token_tables(spark, d), EDITS)).selectExpr(KINDS, "id_a", "id_b")


def p7_assignment(spark, d: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, d, "documents"))
    return packing.packed_all(sizes, table(spark, d, "pack_sizes"))


def p7_use(spark, d: str) -> DataFrame:
    return packing.use(p7_assignment(spark, d), table(spark, d, "pack_sizes"))


def mixed(spark, d: str):
    sizes = tokens.token_counts(table(spark, d, "documents"), ("source",))
    return mixing.mixture(sizes, table(spark, d, "mix_targets"))


def p9_levels(spark, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {
    "p6_found": p6_found,
    "p6_members": lambda s, d: neardup.members(neardup.near_duplicates(token_tables(s, d), EDITS)).selectExpr(KINDS, "id", "class_id", "links"),
    "p6_groups": lambda s, d: neardup.groups(neardup.near_duplicates(token_tables(s, d), EDITS)).selectExpr(KINDS, "id", "group_id"),
    "p7_assignment": p7_assignment,
    "p7_use": p7_use,
    "p8_mixture": lambda s, d: mixed(s, d)[0],
    "p8_shares": lambda s, d: mixing.shares(*mixed(s, d)),
    "p9_found": lambda s, d: p9_levels(s, d).where("demanding").select("doc_id"),
    "p9_levels": lambda s, d: p9_levels(s, d).select("doc_id", F.round("level", 3).alias("level"), "demanding"),
}

RUNS = """tokens as (
  select 'page' as kind, page_id as id, list_transform(list_sort(list_transform(unstructured_part, lambda x: {'p': x.position, 't': lower(x.text)})), lambda y: y.t) as t from page_tokens where unstructured_part is not null
  union all select 'diff', diff_id, list_transform(flatten(list_transform(diff, lambda x: x.tokens)), lambda y: lower(y)) from page_diffs where diff is not null),
runs as (select distinct kind, id, t[i] || chr(31) || t[i + 1] || chr(31) || t[i + 2] as run from (select kind, id, t, unnest(range(1, len(t) - 1)) as i from tokens)),
sized as (select *, count(*) over (partition by kind, id) as n from runs),
kept as (select * from sized where n >= 20)"""

ALIKE = """alike as (select kind, id_a, id_b from (select a.kind, a.id as id_a, b.id as id_b, count(*) as common, min(a.n) as na, min(b.n) as nb
from kept a join kept b on a.kind = b.kind and a.run = b.run and a.id < b.id group by 1, 2, 3) where common >= 0.6 * (na + nb - common))"""
CLASSES = "classes as (select kind, id, min(id) over (partition by kind, s) as class_id from (select kind, id, md5(string_agg(run, chr(30) order by run)) as s from kept group by kind, id))"

ORACLE = {
    "p6_found": f"with {RUNS}, {ALIKE} select kind, id_a, id_b from alike",
    "p6_members": f"""with {RUNS}, {ALIKE}, {CLASSES}, ways as (select kind, id_a as a, id_b as b from alike union all select kind, id_b, id_a from alike)
select c.kind, c.id, c.class_id, count(distinct o.class_id) as links from classes c left join ways e on c.kind = e.kind and c.id = e.a
left join classes o on o.kind = e.kind and o.id = e.b and o.class_id <> c.class_id group by 1, 2, 3""",
    "p6_groups": f"""with recursive {RUNS}, {ALIKE}, ways as (select kind, id_a as a, id_b as b from alike union all select kind, id_b, id_a from alike),
reached as (select distinct kind, id as a, id as b from kept union select r.kind, r.a, e.b from reached r join ways e on r.kind = e.kind and r.b = e.a)
select kind, a as id, min(b) as group_id from reached group by kind, a""",
}
