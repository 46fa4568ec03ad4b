"""Order-dependent steps per key that survive a key with a third of all rows.

A window over a hot key would put all its rows into one task. Here hot keys are cut into slots of consecutive rows, as
many as they have rows for; each slot is a window partition of its own, and what a slot needs from its neighbour is
carried over its edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.session import written

#: Rows from which a key is cut; about so many rows has a slot at least.
HOT_ROWS = 20_000
#: Slots of all keys together, about: with more rows, slots and hot keys are larger in proportion, so that the table of
#: cuts, which is broadcast, has at most twice as many cuts whatever the data.
MOST_SLOTS = 1 << 16
#: Order values looked at per slot; characters of a cut.
SAMPLE, CUT_CHARS = 32, 64


@dataclass(frozen=True)
class Slots:
    """``rows`` with a column ``slot`` (0 but for hot keys, whose slots start at 1), and the hot keys, or None if there are none."""

    rows: DataFrame
    hot: DataFrame | None


def before(cuts: str, order: str) -> Column:
    """How many of the sorted cuts lie before the value: a binary search of 18 steps."""
    step = f"if(lo + shiftleft(1, b) <= size({cuts}) and element_at({cuts}, lo + shiftleft(1, b)) < {order}, lo + shiftleft(1, b), lo)"
    return F.expr(f"aggregate(sequence(17, 0), 0, (lo, b) -> {step})")


def with_slots(df: DataFrame, key: str, order: str, hot_rows: int = HOT_ROWS, most_slots: int = MOST_SLOTS) -> Slots:
    """Cut the keys of at least ``hot_rows`` rows (more, where there are over ``most_slots * hot_rows`` rows) into slots.

    Slots follow the order of ``order`` (a number or a string, compared as the engine compares it); rows of one key and
    order value share a slot. The cuts are quantiles of a sample by hash: any cuts give right slots, so a long string may
    be cut off, and a hot key without a sample is one slot. Rows are counted first; without a hot key nothing else is done.
    """
    counts = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(hot_rows, (total[0] or 0) // most_slots)
    if (total[1] or 0) < least:
        return Slots(df.withColumn("slot", F.lit(0)), None)
    # at most most_slots keys
    hot = F.broadcast(counts.where((F.col("n") >= least) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") * 2 / least).cast("int").alias("slots"), "n"))
    kind = dict(df.dtypes)[order]
    value = F.substring(order, 1, CUT_CHARS) if kind == "string" else F.col(order)
    looked_at = F.pmod(F.xxhash64(order), F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("slots") * SAMPLE))).cast("bigint")) == 0
    seen = df.select(key, order).distinct().join(hot, key).where(looked_at).groupBy(key, "slots").agg(F.sort_array(F.collect_list(value)).alias("seen"))
    cuts = F.expr("transform(sequence(1, slots - 1), i -> element_at(seen, cast(bigint(i) * size(seen) div slots as int) + 1))")
    keys = written(seen.select(key, F.when(F.col("slots") > 1, cuts).otherwise(F.array().cast(f"array<{kind}>")).alias("cuts")), "cuts")
    slotted = df.join(F.broadcast(keys), key, "left").withColumn("slot", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(before("cuts", order) + 1))
    return Slots(slotted.drop("cuts"), keys.select(key))
