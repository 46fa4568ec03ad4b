"""From revisions to tokens, links, versions, diffs and statistics: one plan for all pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions.tokendiff import token_diff, token_ops
from pagelathe.functions.wikitext import PARSED, parse
from pagelathe.operators.ordered import HOT_ROWS, with_slots
from pagelathe.session import written

PARTS = pa.struct([("name", pa.string()), ("text", pa.string()), ("link", pa.string())])
TOKENS = pa.struct([("text", pa.string()), ("link", pa.string()), ("position", pa.int32())])


def parsed_pages(revisions: DataFrame, magic_word_chars: bool = True) -> DataFrame:
    """``page, ver, contributor, structured_part, unstructured_part`` of revisions ``page, ver, contributor, text [, rev_ord]``,
    with ``rev_ord`` (null where it isn't given).

    One pass without a shuffle. A null text has no tokens; texts are parsed whole.
    """
    schema = pa.schema([("page", pa.string()), ("ver", pa.string()), ("contributor", pa.string()), ("structured_part", pa.list_(PARTS)), ("unstructured_part", pa.list_(TOKENS)), ("rev_ord", pa.int32())])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                done = [parse(t, magic_word_chars) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([d["structured_part"] for d in done], schema.types[3]), pa.array([d["unstructured_part"] for d in done], schema.types[4]), part.column(4)], schema=schema)

    kinds = PARSED.removeprefix("struct<").removesuffix(">")
    place = F.col("rev_ord") if "rev_ord" in revisions.columns else F.lit(None)
    columns = revisions.select("page", "ver", F.col("contributor").cast("string").alias("contributor"), "text", place.cast("int").alias("rev_ord"))
    return columns.mapInArrow(run, f"page string, ver string, contributor string, {kinds}, rev_ord int")


def marked(text: str = "t.text", link: str = "t.link"):
    """A token as it is compared: a link as ``[E]`` and its target, else the word."""
    return F.when(F.col(link).isNotNull(), F.concat(F.lit("[E]"), F.col(link))).otherwise(F.col(text))


def page_tokens(parsed: DataFrame) -> DataFrame:
    """``page, ver, token, position, link``: one row per element of the unstructured part."""
    rows = parsed.select("page", "ver", F.explode("unstructured_part").alias("t"))
    return rows.select("page", "ver", marked().alias("token"), F.col("t.position").alias("position"), F.col("t.link").alias("link"))


def page_links(parsed: DataFrame) -> DataFrame:
    """``page, ver, link, part``: every link, from parameters ('S') and text ('U'); an empty target counts, a null doesn't."""
    both = F.expr("""concat(transform(coalesce(structured_part, array()), x -> struct(x.link as link, 'S' as part)),
                            transform(coalesce(unstructured_part, array()), x -> struct(x.link as link, 'U' as part)))""")
    return parsed.select("page", "ver", F.explode(F.filter(both, lambda x: x["link"].isNotNull())).alias("x")).select("page", "ver", "x.link", "x.part")


def link_counts(links: DataFrame) -> DataFrame:
    """``P1, P2, revision, count``: how often a revision of P1 links to P2."""
    return links.groupBy(F.col("page").alias("P1"), F.col("link").alias("P2"), F.col("ver").alias("revision")).agg(F.count(F.lit(1)).cast("int").alias("count"))


def version_rows(parsed: DataFrame) -> DataFrame:
    """``page, ver, o, t``: the marked tokens of each revision that has any, with their positions, and its place."""
    place = F.col("rev_ord") if "rev_ord" in parsed.columns else F.lit(None).cast("int")
    return parsed.where("size(unstructured_part) > 0").select(
        "page", "ver", place.alias("o"),
        F.expr("""transform(array_sort(unstructured_part, (a, b) -> a.position - b.position),
                  x -> struct(if(x.link is not null, concat('[E]', x.link), x.text) as token, x.position as position))""").alias("t"),
    )


def joined_versions(rows: DataFrame, *by: str) -> DataFrame:
    """``by``, ``tokens, positions``: the revisions of one version as one."""
    together = rows.groupBy(*by).agg(F.flatten(F.sort_array(F.collect_list(F.struct("o", "t")))["t"]).alias("t"))
    return together.select(*by, F.col("t.token").alias("tokens"), F.col("t.position").alias("positions"))


def token_sequences(parsed: DataFrame) -> DataFrame:
    """``page, ver, tokens, positions``: the marked tokens of each version in order.

    Versions without tokens are left out. Revisions of one page with the same ``ver`` are one version: their tokens
    follow one another, in the order of ``rev_ord`` where that is known, else of the sequences themselves.
    """
    return joined_versions(version_rows(parsed), "page", "ver")


def version_index(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``page, ver, idx``: distinct versions of each page, numbered from 0 in string order; hot pages are cut into slots of
    that order, whose sizes give each slot its first number."""
    cut = with_slots(rows.select("page", "ver").distinct(), "page", "ver", hot_rows)
    number = F.row_number().over(Window.partitionBy("page", "slot").orderBy("ver")) - 1
    if cut.hot is None:
        return cut.rows.withColumn("idx", number).select("page", "ver", "idx")
    sizes = cut.rows.join(F.broadcast(cut.hot), "page", "left_semi").groupBy("page", "slot").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.select("page", "slot", (F.sum("n").over(Window.partitionBy("page").orderBy("slot")) - F.col("n")).cast("int").alias("first"))
    return cut.rows.withColumn("idx", number).join(firsts, ["page", "slot"], "left").select("page", "ver", (F.col("idx") + F.coalesce("first", F.lit(0))).alias("idx"))


def version_pairs(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``page, ver1, ver2``: consecutive versions of each page, in string order.

    Hot pages are cut into slots of the same order, joined over their edges. Rows without page or version are left out.
    """
    cut = with_slots(rows.where("page is not null and ver is not null").select("page", "ver").distinct(), "page", "ver", hot_rows)
    pairs = cut.rows.withColumn("ver2", F.lead("ver").over(Window.partitionBy("page", "slot").orderBy("ver")))
    if cut.hot is not None:
        edges = cut.rows.join(F.broadcast(cut.hot), "page", "left_semi").groupBy("page", "slot").agg(F.min("ver").alias("first"))
        edges = edges.select("page", "slot", F.lead("first").over(Window.partitionBy("page").orderBy("slot")).alias("next"))
        pairs = pairs.join(edges, ["page", "slot"], "left").withColumn("ver2", F.coalesce("ver2", "next"))
    return pairs.where("ver2 is not null").select("page", F.col("ver").alias("ver1"), "ver2")


#: Versions from which a page is compared in slots: comparing costs far more than sorting.
DIFF_ROWS = 2_000


def page_diffs(parsed: DataFrame, hot_rows: int = DIFF_ROWS) -> DataFrame:
    """``page, ver1, ver2, diff`` of all consecutive versions that have tokens, in string order of the versions.

    The tokens are written once, as they are counted before they move; they move once, to the task of their page, or of
    the slot of a hot page, where each version is compared with the one before it as they stream by in order. The first
    and last versions of a hot page's slots are put aside and compared over the edges. Rows without page or version are
    left out.
    """
    rows = written(version_rows(parsed.where("page is not null and ver is not null")), "sequences")
    cut = with_slots(rows, "page", "ver", hot_rows)
    by = ["page"] if cut.hot is None else ["page", "slot"]  # a constant slot would cost another shuffle
    sequences = joined_versions(cut.rows.repartition(*by), *by, "ver").sortWithinPartitions(*by, "ver")
    ordered = sequences.select("page", F.col("slot") if cut.hot is not None else F.lit(0).alias("slot"), "ver", "tokens", "positions")
    ops = pa.list_(pa.struct([("action", pa.string()), ("position", pa.int32()), ("tokens", pa.list_(pa.string()))]))
    schema = pa.schema([("page", pa.string()), ("ver1", pa.string()), ("ver2", pa.string()), ("diff", ops), ("slot", pa.int32()), ("tokens", pa.list_(pa.string())), ("positions", pa.list_(pa.int32()))])

    def run(batches):
        last = None
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(low, 500).columns)):
                    page, slot, ver, tokens, positions = row
                    if last is not None and last[:2] == row[:2]:
                        out.append((page, last[2], ver, token_ops(last[3], last[4], tokens), slot, None, None))
                    else:
                        out += edges(last, row)
                    last = row
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if out := edges(last, None):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def edges(last, first) -> list[tuple]:
        """The last version of a slot and the first of the next one, where they belong to hot pages."""
        found = [(last[0], last[2], None, None, last[1], last[3], last[4])] if last is not None and last[1] else []
        return found + ([(first[0], None, first[2], None, first[1], first[3], first[4])] if first is not None and first[1] else [])

    found = ordered.mapInArrow(run, "page string, ver1 string, ver2 string, diff array<struct<action: string, position: int, tokens: array<string>>>, slot int, tokens array<string>, positions array<int>")
    if cut.hot is None:
        return found.select("page", "ver1", "ver2", "diff")
    found = written(found, "diffs")
    firsts = found.where("ver1 is null").select("page", "slot", "ver2", F.col("tokens").alias("new"))
    lasts = found.where("ver2 is null").select("page", "slot", "ver1", F.col("tokens").alias("old"), "positions")
    following = lasts.select("page", F.col("slot").alias("of"), F.lead("slot").over(Window.partitionBy("page").orderBy("slot")).alias("slot"))
    pairs = lasts.withColumnRenamed("slot", "of").join(following, ["page", "of"]).join(firsts, ["page", "slot"])
    over = pairs.select("page", "ver1", "ver2", token_diff(F.col("old"), F.col("positions"), F.col("new")).alias("diff"))
    return found.where("ver1 is not null and ver2 is not null").select("page", "ver1", "ver2", "diff").unionByName(over)


def edit_counts(diffs: DataFrame) -> DataFrame:
    """``page, ver1, ver2, inss, dels, added_tokens, removed_tokens`` of each diff that isn't empty."""
    count = lambda a: f"size(filter(diff, x -> x.action = '{a}'))"
    total = lambda a: f"aggregate(filter(diff, x -> x.action = '{a}'), 0L, (s, x) -> s + size(coalesce(x.tokens, array())))"
    return diffs.where("size(diff) > 0").select(
        "page", "ver1", "ver2",
        *[F.expr(e).cast("bigint").alias(n) for e, n in ((count("INS"), "inss"), (count("DEL"), "dels"), (total("INS"), "added_tokens"), (total("DEL"), "removed_tokens"))],
    )


def edit_statistics(diffs: DataFrame) -> DataFrame:
    """``page, inss, dels, added_tokens, removed_tokens`` per page; pages without edits are absent."""
    return edit_counts(diffs).groupBy("page").agg(*[F.sum(c).alias(c) for c in ("inss", "dels", "added_tokens", "removed_tokens")])


def page_statistics(parsed: DataFrame) -> DataFrame:
    """``page, revs, links, avg_tokens`` per page: rows, distinct links of both parts, tokens per row rounded up."""
    rows = parsed.groupBy("page").agg(F.count(F.lit(1)).alias("revs"), F.sum(F.coalesce(F.size("unstructured_part"), F.lit(0)).cast("bigint")).alias("tokens"))
    links = page_links(parsed).select("page", "link").distinct().groupBy("page").agg(F.count(F.lit(1)).alias("links"))
    joined = rows.join(links, rows.page.eqNullSafe(links.page), "left").select(rows.page, "revs", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), "tokens")
    return joined.select("page", "revs", "links", F.ceil(F.col("tokens") / F.col("revs")).cast("bigint").alias("avg_tokens"))
