"""Texts of varying length in containers of fixed capacity (problem 7).

Sizes are whole numbers up to the capacity, so an instance is its histogram: how many items there are of each size. The
reduction of Martello and Toth fixes sets of one, two or three items that dominate whatever else could be packed with one of
them, and is repeated on the instance that is left until it fixes nothing; what remains is packed by best fit, largest first. Both work on whole classes of equal items and yield patterns
(so many containers with these sizes), whose number follows the capacity, not the number of texts. Items then find
their containers by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Items of one size that are numbered in one task, about; a size with more is numbered by parts.
PART_ROWS = 1_000_000

#: ``(containers, {size: items in each})``
Pattern = tuple[int, dict[int, int]]


class Histogram:
    """Items left by size, with the sizes that have any in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def smallest(self, n: int, but: int) -> int:
        """Sum of the n smallest items besides one of size ``but``; very large if there are fewer."""
        total = 0
        for s in self.sizes:
            k = min(n, self.counts[s] - (s == but))
            total += k * s
            n -= k
            if not n:
                return total
        return 1 << 60

    def least_above(self, size: int, n: int, but: int) -> int:
        """Sum of the n smallest items larger than ``size`` besides one of size ``but``; very large if there are fewer."""
        total = 0
        for s in self.sizes[bisect_right(self.sizes, size) :]:
            k = min(n, self.counts[s] - (s == but))
            total += k * s
            n -= k
            if not n:
                return total
        return 1 << 60

    def fitting(self, room: int, used: tuple[int, ...]) -> int | None:
        """The largest size that fits of which more items are left than are ``used``."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0 and self.counts[self.sizes[i]] <= used.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else None


def best_pair(h: Histogram, room: int, but: int) -> tuple[int, int] | None:
    """The two items with the largest sum within ``room``, besides one of size ``but``; of equal sums the one with the largest item."""
    left = lambda s: h.counts[s] - (s == but)
    i, j, best, found = 0, len(h.sizes) - 1, -1, None
    while i <= j:
        a, b = h.sizes[i], h.sizes[j]
        if a + b > room or left(b) <= 0:
            j -= 1
            continue
        if left(a) > (1 if i == j else 0) and a + b > best:
            best, found = a + b, (b, a)
        i += 1
    return found


def dominating(h: Histogram, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set with an item of size j that dominates all others with it, if the tests of the procedure show one.

    Nothing fits beside j: j alone. Otherwise b is the largest item that fits. If it fills the container, or only one item
    can be added: {j, b}. If two can be added but not three: {j, b} if no pair has a larger sum than b; else {j, b, c}, c
    the largest item that fits beside both, if no two items larger than c fit beside j: then any pair that fits has its
    larger item at most b and its smaller one at most c.
    """
    room = capacity - j
    b = h.fitting(room, (j,))
    if b is None:
        return (j,)
    if b == room or h.smallest(2, j) > room:
        return j, b
    if h.smallest(3, j) <= room:
        return None
    pair = best_pair(h, room, j)
    if pair is None or sum(pair) <= b:
        return j, b
    c = h.fitting(room - b, (j, b))
    if c is not None and h.least_above(c, 2, j) > room:
        return j, b, c
    return None


def reduce(h: Histogram, capacity: int) -> list[Pattern]:
    """Fix dominating sets, from the largest size down, again and again until none is found; ``h`` keeps the items of no set."""
    fixed: list[Pattern] = []
    found = True
    while found:
        found = False
        for j in reversed(list(h.sizes)):
            while h.counts.get(j, 0) and (chosen := dominating(h, j, capacity)):
                inside = {s: chosen.count(s) for s in chosen}
                n = min(h.counts[s] // k for s, k in inside.items())
                fixed.append((n, inside))
                for s, k in inside.items():
                    h.take(s, n * k)
                found = True
    return fixed


def bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs at least: items over half the capacity need one each, and for each size k what is
    over capacity - k leaves no room for items from k up to half the capacity."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = 0
    for k in [0, *sizes[sizes <= capacity // 2].tolist()]:
        large, middle, small = sizes > capacity - k, (sizes > capacity // 2) & (sizes <= capacity - k), (sizes >= k) & (sizes <= capacity // 2)
        left = (n[small] * sizes[small]).sum() - (n[middle] * (capacity - sizes[middle])).sum()
        best = max(best, int(n[large].sum() + n[middle].sum() + max(0, -(-left // capacity))))
    return best


def worth(counts: dict[int, int], capacity: int) -> dict[str, int]:
    """What the reduction is good for: items and containers it fixes, containers in all, with best fit alone, and at least."""
    h = Histogram(counts)
    fixed = reduce(h, capacity)
    total = lambda patterns: sum(n for n, _ in patterns)
    inside = sum(n * sum(x.values()) for n, x in fixed)
    return {"items": sum(counts.values()), "fixed_items": inside, "fixed_containers": total(fixed), "containers": total(fixed) + total(best_fit(h, capacity)), "best_fit_alone": total(best_fit(Histogram(counts), capacity)), "at_least": bound(counts, capacity)}


def best_fit(h: Histogram, capacity: int) -> list[Pattern]:
    """Best fit, largest first: each item into the open container with the least room that takes it."""
    rooms: list[int] = []
    open_: dict[int, list[Pattern]] = {}

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(pattern)

    for s in reversed(list(h.sizes)):
        left = h.counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * s, (full, {s: each}))
                if rest:
                    put(capacity - rest * s, (1, {s: rest}))
                break
            room = rooms[i]
            n, inside = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            # an item goes on into the same container while that has the least room that takes it
            k = 1
            while room - (k + 1) * s >= 0 and (not (j := bisect_left(rooms, s)) < len(rooms) or rooms[j] >= room - k * s):
                k += 1
            used = min(n, left // k)
            if not used:
                k, used = left, 1
            if n > used:
                put(room, (n - used, inside))
            put(room - k * s, (used, {**inside, s: inside.get(s, 0) + k}))
            left -= k * used
    return [p for r in rooms for p in open_[r]]


def pack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for all items of sizes from 1 to the capacity."""
    h = Histogram(counts)
    fixed = reduce(h, capacity)
    return fixed + best_fit(h, capacity)


def places(patterns: list[Pattern]) -> tuple[np.ndarray, int]:
    """Where the items of each size go: rows of size, first rank, first container, items in each container; and the number of containers."""
    rows, used, base = [], {}, 0
    for n, inside in patterns:
        for s, k in inside.items():
            rows.append((s, used.get(s, 0), base, k))
            used[s] = used.get(s, 0) + n * k
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4), base


def items(sizes: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, part, tokens``: texts, those over the capacity cut into full containers and a rest."""
    full = F.floor(F.col("tokens") / F.lit(capacity)).cast("int")
    rest = F.col("tokens") - full * F.lit(capacity)
    last = F.when((rest > 0) | (F.col("tokens") == 0), full).otherwise(full - 1)
    return sizes.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("part"), full.alias("full"), rest.alias("rest")).select(
        "doc_id", "part", F.when(F.col("part") < F.col("full"), F.lit(capacity).cast("bigint")).otherwise(F.col("rest")).alias("tokens")
    )


def packed(sizes: DataFrame, capacity: int) -> DataFrame:
    """``container_no, doc_id, part, tokens`` for each text of ``sizes`` (``doc_id, tokens``), in containers of ``capacity`` tokens.

    A text of up to ``capacity`` tokens is one item, part 0; a longer one fills containers and leaves a rest. Texts
    without tokens go to container 0. Ids may repeat: each row is an item of its own. An empty table gives no rows.
    The driver gets the number of items of each size, and of sizes with over ``PART_ROWS`` items that of each part: a row
    per size and one per ``PART_ROWS`` items.
    """
    spark = sizes.sparkSession
    rows = items(sizes, capacity)
    counts = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("tokens")
    size, n = counts["tokens"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    table, _ = places(pack({int(s): int(k) for s, k in zip(size, n) if s > 0}, capacity))
    parts = -(-n // PART_ROWS)
    large = [(int(s), int(k)) for s, k in zip(size, parts) if k > 1]
    slices, before = np.empty(0, np.int64), np.zeros(1, np.int64)
    if large:
        cut = F.broadcast(spark.createDataFrame(large, "tokens bigint, parts int"))
        rows = rows.join(cut, "tokens", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("doc_id", "part"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        sliced = rows.where(F.col("tokens").isin([s for s, _ in large])).groupBy("tokens", "slice").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["tokens", "slice"])
        slices = (sliced["tokens"].to_numpy(np.int64) << 24) | sliced["slice"].to_numpy(np.int64)
        before = (sliced.groupby("tokens")["n"].cumsum() - sliced["n"]).to_numpy(np.int64)
    else:
        rows = rows.withColumn("slice", F.lit(0))
    told = spark.sparkContext.broadcast((slices, before, table))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("tokens", "slice").orderBy("doc_id", "part")) - 1)

    def run(batches):
        slices, before, table = told.value
        keys = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            size, part, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            if len(slices):
                key = size << 24 | part
                k = np.minimum(np.searchsorted(slices, key), len(slices) - 1)
                rank = rank + np.where(slices[k] == key, before[k], 0)
            row = np.searchsorted(keys, size << 40 | rank, side="right") - 1
            if len(table):
                chosen = table[np.maximum(row, 0)]
                at = np.where(size > 0, chosen[:, 2] + (rank - chosen[:, 1]) // chosen[:, 3], 0)
            else:
                at = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns[:3]], names=["container_no", "doc_id", "part", "tokens"])

    return numbered.select("doc_id", "part", "tokens", "slice", "r").mapInArrow(run, "container_no bigint, doc_id bigint, part int, tokens bigint")


def packed_all(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, container_no, doc_id, part, tokens`` for each kind of container (``container, capacity_tokens``: a small fixed table)."""
    kinds = containers.where("container is not null and capacity_tokens > 0").distinct().orderBy("container").collect()
    out = None
    for k in kinds:
        one = packed(sizes, k.capacity_tokens).select(F.lit(k.container).alias("container"), "container_no", "doc_id", "part", "tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return sizes.select(F.lit("").alias("container"), F.lit(0).cast("bigint").alias("container_no"), "doc_id", F.lit(0).alias("part"), "tokens").limit(0)
    return out


def use(assigned: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: their number, the texts, their tokens and the free part of the space."""
    used = assigned.groupBy("container").agg((F.max("container_no") + 1).alias("containers"), F.count_distinct("doc_id").alias("texts"), F.sum("tokens").alias("tokens"))
    space = F.col("containers") * F.col("capacity_tokens")
    return used.join(F.broadcast(containers.distinct()), "container").select("container", "containers", "texts", "tokens", F.round(1 - F.col("tokens") / space, 6).alias("free_share"))
