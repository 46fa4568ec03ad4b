"""Many tiny files of JSON lines as few files of good size, each record exactly once (problem 3).

A pass over the bodies finds the records and chooses one delivery of each. What is to be kept of each file is frozen in
a written manifest. Files are packed into bins by first-fit decreasing; the bins are rewritten to a staging folder,
whose row counts and checksums are compared with the manifest's, and then committed by one rename.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.jsontext import loads
from pagelathe.operators.nested import bare, sound
from pagelathe.session import scratch, written

#: Bytes of records a rewritten file should have, and how many such files one task writes.
TARGET_BYTES = 32 << 20
BINS_A_TASK = 2
#: Bytes of records, repeats included, that pass through one task at most.
DELIVERED_A_TASK = 512 << 20
#: The file that is written last to a committed folder.
MARK = "_COMMITTED"
LINE = re.compile(r"\r\n|\n|\r")


def records(body: str | None) -> Iterator[tuple[int, str, str, str]]:
    """Line number, title, timestamp and text of each record: a complete JSON object, alone in its line, with both."""
    for n, line in enumerate(LINE.split(body or "")):
        text = bare(line)
        if not (text.startswith("{") and text.endswith("}")):
            continue
        try:
            o = loads(text)
        except ValueError:
            continue
        title, ver = o.get("title"), o.get("timestamp")
        if isinstance(title, str) and isinstance(ver, str) and title.strip() and ver.strip():
            yield n, sound(title), sound(ver), text


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def identified(files: DataFrame) -> DataFrame:
    """``file_id, written_at, body``: files without an id get a negative one from their body, equal bodies once (the one written last)."""
    own = F.xxhash64("body").bitwiseOR(F.lit(-(1 << 63)))
    unnamed = files.where("file_id is null and body is not null").groupBy("body").agg(F.max("written_at").alias("written_at"))
    return files.where("file_id is not null").select("file_id", "written_at", "body").unionByName(unnamed.select(own.alias("file_id"), "written_at", "body"))


def found_records(files: DataFrame) -> DataFrame:
    """One row per delivery of a record: ``file_id, written_at, line, k1, k2, n_bytes, h``; k1 and k2 name the record, h is its text's hash."""
    schema = pa.schema([("file_id", pa.int64()), ("written_at", pa.timestamp("us", "UTC")), ("line", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int32()), ("h", pa.int64())])

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            at, line, k1, k2, size, h = [], [], [], [], [], []
            for i, body in enumerate(batch.column(2).to_pylist()):
                for n, title, ver, text in records(body):
                    key = f"{len(title)}:{title}{ver}".encode()
                    raw = text.encode("utf-8", "replace")
                    at.append(i)
                    line.append(n)
                    k1.append(signed(digest(key, 1)))
                    k2.append(signed(digest(key, 2)))
                    size.append(len(raw) + 1)
                    h.append(signed(digest(raw, 42)))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take).cast(schema.types[1]), *map(pa.array, (line, k1, k2, size, h), schema.types[2:])], schema=schema)

    return files.select("file_id", "written_at", "body").where("body is not null").mapInArrow(run, "file_id bigint, written_at timestamp, line int, k1 bigint, k2 bigint, n_bytes int, h bigint")


def manifest(files: DataFrame) -> DataFrame:
    """The frozen manifest, written to the shared folder: ``file_id, n_records, n_bytes, delivered, high, low, lines``.

    A row says which lines of a file are kept, and has their bytes, the bytes of all their deliveries, and their checksum
    (sums of the halves of their hashes).
    Of a record delivered more than once the delivery written last counts, then that of the smallest file and line.
    """
    latest = F.max(F.struct("written_at", (-F.col("file_id")).alias("f"), (-F.col("line")).alias("l"), "n_bytes", "h")).alias("x")
    chosen = found_records(files).groupBy("k1", "k2").agg(latest, F.sum("n_bytes").alias("delivered"))
    kept = chosen.select((-F.col("x.f")).alias("file_id"), (-F.col("x.l")).alias("line"), "x.n_bytes", "x.h", "delivered")
    return written(
        kept.groupBy("file_id").agg(
            F.count(F.lit(1)).alias("n_records"),
            F.sum("n_bytes").alias("n_bytes"),
            F.sum("delivered").alias("delivered"),
            F.sum(F.shiftright("h", 32)).alias("high"),
            F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"),
            F.collect_list("line").alias("lines"),
        ),
        "manifest",
    )


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size: largest first, each into the first bin that has room; what exceeds the capacity is alone.

    A tree of the most room in each range of bins finds the first bin in logarithmic time.
    """
    n = 1
    while n < max(len(sizes), 1):
        n *= 2
    room = [capacity] * (2 * n)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, node = min(sizes[i], capacity), 1
        while node < n:
            node = 2 * node if room[2 * node] >= size else 2 * node + 1
        out[i] = node - n
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return out


def packed(plan: DataFrame, target_bytes: int) -> tuple[DataFrame, int]:
    """The manifest with ``shard`` and ``bin``. Each shard is packed by itself, in one task, and has a few bins.

    Shards are even as they follow the hash of the file's id; all but one bin of each are full, but where repeats are
    so many that shards must be smaller, as all deliveries of a shard pass through its task.
    """
    total = plan.agg(F.sum("n_bytes"), F.sum("delivered")).first()
    shards = max(1, math.ceil((total[0] or 0) / (BINS_A_TASK * target_bytes)), math.ceil((total[1] or 0) / DELIVERED_A_TASK))
    sharded = plan.withColumn("shard", F.pmod(F.xxhash64("file_id"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("file_id")
        pdf["bin"] = [int(pdf["shard"].iloc[0]) + shards * b for b in first_fit_decreasing(pdf["n_bytes"].tolist(), target_bytes)]
        return pdf[["file_id", "bin"]]

    bins = sharded.select("shard", "file_id", "n_bytes").groupBy("shard").applyInPandas(run, "file_id bigint, bin int")
    return written(sharded.join(bins, "file_id"), "plan"), shards


def compact(files: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rewrite the records of ``files`` to the folder ``out``, one file per bin; the committed table ``bin, title, ver, record``.

    files: ``file_id`` (unique or null), ``written_at``, ``body``; other columns are ignored. Null and empty bodies, damaged
    lines and lines that aren't an object with a title and a timestamp hold no record; an empty table commits no rows.
    Texts of any length are kept whole; a file larger than the target is a bin of its own. Raises if row counts or
    checksums of the rewritten bins differ from the manifest's, or if ``out`` exists; then nothing is committed.
    """
    spark = files.sparkSession
    files = identified(files)
    kept = manifest(files)
    plan, shards = packed(kept, target_bytes)
    if totals(plan) != totals(kept):
        raise RuntimeError(f"the plan differs from the manifest: {totals(plan)}, {totals(kept)}")
    staging = scratch(spark, "staging")
    rewritten(files, plan, shards).write.partitionBy("bin").option("compression", "zstd").parquet(staging)
    rows = spark.read.schema("title string, ver string, record string, bin int").parquet(staging)
    verify(plan, rows)
    commit(spark, staging, out)
    return read_compacted(spark, out)


def rewritten(files: DataFrame, plan: DataFrame, shards: int) -> DataFrame:
    """``title, ver, record, bin`` of the lines kept. Bodies move once, to the task of their shard, where the plan comes first."""
    orders = plan.select("shard", F.lit(0).alias("kind"), "file_id", "bin", "lines", F.lit(None).cast("string").alias("body"))
    bodies = files.where("body is not null").select(
        F.pmod(F.xxhash64("file_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "file_id", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("array<int>").alias("lines"), "body"
    )
    both = orders.unionByName(bodies).repartitionById(shards, "shard").sortWithinPartitions("kind").select("kind", "file_id", "bin", "lines", "body")
    schema = pa.schema([("title", pa.string()), ("ver", pa.string()), ("record", pa.string()), ("bin", pa.int32())])

    def run(batches):
        plans: dict[int, tuple[int, set[int]]] = {}
        for batch in batches:
            rows = []
            for kind, file_id, b, lines, body in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    plans[file_id] = b, set(lines)
                elif file_id in plans:
                    b, keep = plans[file_id]
                    rows += [(title, ver, sound(text), b) for n, title, ver, text in records(body) if n in keep]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return both.mapInArrow(run, "title string, ver string, record string, bin int")


def totals(plan: DataFrame) -> tuple:
    """Records and checksum of a manifest or plan."""
    return tuple(plan.agg(F.sum("n_records"), F.sum("high"), F.sum("low")).first())


def verify(plan: DataFrame, rows: DataFrame) -> None:
    """Raise unless each bin has the rows and the checksum that the plan says."""
    h = F.xxhash64("record")
    want = plan.groupBy("bin").agg(F.sum("n_records").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    have = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n2"), F.sum(F.shiftright(h, 32)).alias("high2"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low2"))
    wrong = want.join(have, "bin", "full").where("not (n <=> n2 and high <=> high2 and low <=> low2)").limit(5).collect()
    if wrong:
        raise RuntimeError(f"rewritten bins differ from the manifest: {wrong}")


def commit(spark: SparkSession, staging: str, out: str) -> None:
    """Rename the staging folder and then mark it: on file systems whose rename isn't atomic, only a marked folder is whole."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(out)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"not committed: {out} exists or can't be made")
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{out}/{MARK}")).close()


def read_compacted(spark: SparkSession, out: str) -> DataFrame:
    """``title, ver, record, bin`` of a committed folder; raises if it isn't marked."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{MARK}")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        raise RuntimeError(f"{out} isn't committed")
    return spark.read.schema("title string, ver string, record string, bin int").parquet(out)


def compacted(files: DataFrame) -> DataFrame:
    """``compact`` into a fresh folder beside the shared one's other tables."""
    return compact(files, scratch(files.sparkSession, "compact"))
