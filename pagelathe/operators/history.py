"""History of changing attributes: each value an attribute had, with the period in which it was valid (problem 1).

Every version of an entity is a snapshot of all its attributes. A snapshot is kept as a hash tree: attributes fall into
leaf buckets by the hash of their name, each branch has the hash of its leaves, the root that of the branches. Two
consecutive snapshots are compared from the root down; only branches and leaves that differ are opened, and only the
attributes of changed leaves are compared one by one. The changes found make up the periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.functions.text import instant, page_title, param_name, squeeze, utc_text
from pagelathe.operators.ordered import HOT_ROWS, with_slots
from pagelathe.session import written

#: The tree: BRANCHES branches of as many leaf buckets.
BRANCHES = 4


def dated_versions(history: DataFrame) -> DataFrame:
    """Versions that count: title by the title rule, ``at`` (microseconds), non-null part, ``loaded_at``, ``rev_id``."""
    return (
        history.select(page_title(F.col("title")).alias("title"), instant(F.col("timestamp")).alias("at"), "structured_part", "loaded_at", "rev_id")
        .where("title is not null and at is not null and structured_part is not null")
    )


def attribute_set(parts: str) -> str:
    """SQL of the attributes that are set in an array of (name, text): sorted, the last of repeated names counts."""
    return f"""array_sort(filter({parts}, (e, i) -> e.text <> ''
        and not exists(slice({parts}, i + 2, size({parts})), later -> later.name = e.name)))"""


def snapshot_tree(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Adds ``tree``: root hash, branch hashes, leaf hashes and leaves of an array of (name, text)."""
    last = BRANCHES * BRANCHES - 1
    placed = f"transform({attributes}, e -> named_struct('name', e.name, 'text', e.text, 'leaf', pmod(xxhash64(e.name), {last + 1})))"
    return (
        df.withColumn("placed", F.expr(placed))
        # the size, used with the root, also keeps the plan from placing the attributes anew for each leaf
        .withColumns({"leaves": F.expr(f"transform(sequence(0L, {last}L), b -> filter(placed, e -> e.leaf = b))"), "n": F.size("placed")})
        .withColumn("leaf_hash", F.expr("transform(leaves, l -> xxhash64(l))"))
        .withColumn("branch_hash", F.expr(f"transform(sequence(0, {BRANCHES - 1}), n -> xxhash64(slice(leaf_hash, n * {BRANCHES} + 1, {BRANCHES})))"))
        .withColumn("tree", F.expr("struct(xxhash64(branch_hash, n) as root, branch_hash, leaf_hash, leaves)"))
        .drop("placed", "n", "leaves", "leaf_hash", "branch_hash")
    )


#: Changes between two trees: (name, text), text null where the attribute is no longer set.
CHANGES = f"""
case when before is null then flatten(tree.leaves)
     when before.root = tree.root then array()
     else flatten(transform(sequence(0, {BRANCHES - 1}), n ->
        if(before.branch_hash[n] = tree.branch_hash[n], array(),
           flatten(transform(sequence(n * {BRANCHES}, n * {BRANCHES} + {BRANCHES - 1}), l ->
              if(before.leaf_hash[l] = tree.leaf_hash[l], array(),
                 concat(
                    filter(tree.leaves[l], e -> not array_contains(before.leaves[l], e)),
                    transform(filter(before.leaves[l], o -> not exists(tree.leaves[l], e -> e.name = o.name)),
                              o -> named_struct('name', o.name, 'text', cast(null as string), 'leaf', o.leaf))))))))) end"""


def reduced(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by`` and instant: the one loaded last (then the largest ``rev_id``, then the part that sorts last)."""
    latest = F.max(F.struct("loaded_at", "rev_id", "structured_part")).alias("x")
    return rows.groupBy(*by, "at").agg(latest).select(*by, "at", "x.*")


def version_trees(versions: DataFrame) -> DataFrame:
    """``versions`` (with ``structured_part``) with the hash tree of each snapshot in its place."""
    entry = F.transform("structured_part", lambda e: F.struct(param_name(e["name"]).alias("name"), F.coalesce(squeeze(e["text"]), F.lit("")).alias("text")))
    entries = versions.withColumn("entries", F.filter(entry, lambda e: e["name"] != "")).drop("structured_part", "loaded_at", "rev_id")
    return snapshot_tree(entries.withColumn("attributes", F.expr(attribute_set("entries"))).drop("entries")).drop("attributes")


def tree_events(trees: DataFrame, by: list[str]) -> DataFrame:
    """``at, name, text`` of each change between a tree and the one ``before`` it; text null where an attribute is no longer set."""
    return trees.select(*by, "at", F.explode(F.expr(CHANGES)).alias("e")).select(*by, "at", "e.name", "e.text")


def with_end(events: DataFrame, by: list[str]) -> DataFrame:
    return events.withColumn("until", F.lead("at").over(Window.partitionBy(*by, "name").orderBy("at")))


def periods_of(events: DataFrame) -> DataFrame:
    return events.where("text is not null").select("title", "name", "text", F.col("at").alias("valid_from"), F.col("until").alias("valid_to"))


def attribute_periods(history: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per title, name and period: ``title, name, text, valid_from, valid_to`` (microseconds, null if it hasn't ended).

    history: ``title, timestamp, structured_part, loaded_at, rev_id``; other columns are ignored. Rows without title,
    timestamp or part don't count; of rows with one title and instant the one loaded last does (then the largest
    ``rev_id``, then the part that sorts last). Entries without a name don't count. An empty table gives no rows.
    Titles with ``hot_rows`` rows or more are cut into slots, so that no task gets all rows of one title, and their rows
    are reduced to one per instant before they move, as one instant may have them all.
    """
    cut = with_slots(dated_versions(history), "title", "at", hot_rows)
    if cut.hot is None:
        # one shuffle by title serves the choice of versions, the comparison and the periods
        by = ["title"]
        versions = reduced(cut.rows.repartition("title"), by)
    else:
        by = ["title", "slot"]
        versions = reduced(cut.rows, by)
    trees = version_trees(versions).withColumn("before", F.lag("tree").over(Window.partitionBy(*by).orderBy("at")))
    if cut.hot is not None:
        ends = trees.join(F.broadcast(cut.hot), "title", "left_semi").groupBy("title", "slot").agg(F.max_by("tree", "at").alias("tree"))
        carried = ends.select("title", "slot", F.lag("tree").over(Window.partitionBy("title").orderBy("slot")).alias("carried"))
        trees = trees.join(carried, ["title", "slot"], "left").withColumn("before", F.coalesce("before", "carried")).drop("carried")
    events = with_end(tree_events(trees, by), by)
    if cut.hot is not None:
        firsts = events.join(F.broadcast(cut.hot), "title", "left_semi").groupBy("title", "slot", "name").agg(F.min("at").alias("first"))
        nexts = firsts.select("title", "slot", "name", F.lead("first").over(Window.partitionBy("title", "name").orderBy("slot")).alias("next"))
        events = events.join(nexts, ["title", "slot", "name"], "left").withColumn("until", F.coalesce("until", "next")).drop("next")
    return periods_of(events)


class History:
    """A history kept in a folder, to which new rows are appended.

    Each append writes one generation: the versions it brought, the changes found, and of each title it touched the head,
    that is the last version with its hash tree. New versions are compared with the stored head's tree from the root down,
    so a title that isn't touched is not read, and of a touched one only changed leaves are opened. Where a row is older
    than its title's head, or corrects it, the title's changes are made anew from its stored versions, and its older
    changes are void from then on. Appends in any order give what ``attribute_periods`` gives of all rows together.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    VERSION = "title string, at bigint, loaded_at timestamp, rev_id bigint, structured_part array<struct<name: string, text: string, link: string>>"
    LEAF = "array<struct<name: string, text: string, leaf: bigint>>"
    TREE = f"struct<root: bigint, branch_hash: array<bigint>, leaf_hash: array<bigint>, leaves: array<{LEAF}>>"
    TABLES = {"versions": f"{VERSION}, gen int", "heads": f"title string, at bigint, tree {TREE}, since int, gen int", "events": "title string, at bigint, name string, text string, gen int"}

    def _table(self, name: str) -> DataFrame:
        """Rows of all generations that are complete; the mark of a generation is written last."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        n = self._generations(fs, root)
        if not n:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(*[f"{self.path}/{g}/{name}" for g in range(n)])

    def _generations(self, fs, root) -> int:
        n = 0
        while fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/COMPLETE")):
            n += 1
        return n

    def heads(self) -> DataFrame:
        """``title, at, tree, since``: the last version of each title, and the generation from which its changes count."""
        latest = F.max_by(F.struct("at", "tree", "since"), "gen").alias("x")
        return self._table("heads").groupBy("title").agg(latest).select("title", "x.*")

    def append(self, history: DataFrame) -> None:
        """Take in new rows, shaped as for ``attribute_periods``."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gen = self._generations(fs, root)
        out = f"{self.path}/{gen}"
        fs.delete(hadoop.Path(out), True)  # what a failed append left
        number = F.lit(gen).alias("gen")
        known = self._table("versions")
        reduced(dated_versions(history), ["title"]).select("title", "at", "loaded_at", "rev_id", "structured_part", number).write.parquet(f"{out}/versions")
        new = self.spark.read.schema(self.TABLES["versions"]).parquet(f"{out}/versions")
        heads = self.heads()
        head_at = heads.select("title", F.col("at").alias("head_at"))
        late = written(new.join(head_at, "title").where("at <= head_at").select("title").distinct(), "late")
        old = known.join(late, "title", "left_semi").unionByName(new.join(late, "title", "left_semi"))
        versions = reduced(old, ["title"]).withColumn("anew", F.lit(True)).unionByName(new.join(late, "title", "left_anti").drop("gen").withColumn("anew", F.lit(False)))
        trees = version_trees(versions.select("title", "at", "loaded_at", "rev_id", "structured_part", "anew"))
        trees = trees.withColumn("before", F.lag("tree").over(Window.partitionBy("title").orderBy("at")))
        stored = heads.select("title", F.col("tree").alias("stored"), "since")
        trees = written(trees.join(stored, "title", "left").withColumn("before", F.coalesce("before", F.when(~F.col("anew"), F.col("stored")))), "trees")
        tree_events(trees, ["title"]).select("title", "at", "name", "text", number).write.parquet(f"{out}/events")
        since = F.when(F.first("anew"), F.lit(gen)).otherwise(F.coalesce(F.first("since"), F.lit(gen)))
        last = trees.groupBy("title").agg(F.max("at").alias("at"), F.max_by("tree", "at").alias("tree"), since.alias("since"))
        last.select("title", "at", "tree", "since", number).write.parquet(f"{out}/heads")
        fs.create(hadoop.Path(f"{out}/COMPLETE")).close()

    def periods(self) -> DataFrame:
        """As ``attribute_periods`` of all rows taken in."""
        counting = self.heads().select("title", "since")
        events = self._table("events").join(counting, "title").where("gen >= since").select("title", "at", "name", "text")
        return periods_of(with_end(events, ["title"]))


def found_periods(history: DataFrame) -> DataFrame:
    """The periods with UTC texts, ``valid_to`` empty where the period hasn't ended."""
    return attribute_periods(history).select(
        "title", "name", utc_text(F.col("valid_from")).alias("valid_from"), F.coalesce(utc_text(F.col("valid_to")), F.lit("")).alias("valid_to")
    )
