"""Near-duplicate records with small edits (problem 6): all pairs of records whose token runs overlap enough.

1. Each record becomes the set of its distinct runs of tokens, as sorted codes of CODE_BITS bits. Records with equal sets
   are one class, named by a hash of the set; one set of each class goes on under this name. An id that comes with
   several different sets is in several classes, and is alike another if any of its sets is.
2. Runs are put in one order for all records, rare ones first. Two sets that overlap enough share a run among the first
   few of each, so each record is posted under these runs only, and records posted under the same run form a block.
   The blocks lose no pair. The posting list of a frequent run is cut into groups, and each pair of groups is a block.
   Runs whose lists prove long unexpectedly are moved back in the order by their true counts, and the records posted anew.
3. In a block, the parity sketches of all members are compared by bit slices (``bitslice``), stored as planes of 64
   candidates a word; words are abandoned once all lanes exceed the radius. Sketches are as wide as the sets are large. A
   sketch never exaggerates the difference of two sets, so no pair is lost. What remains is checked on the sets themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm import bitslice
from pagelathe.session import parallelism, written

CODE_BITS = 40
CODE_BYTES = CODE_BITS // 8
#: Records a batch of postings makes at most per bucket task, members a block has at most in each of its two groups.
BUCKET_POSTINGS, GROUP = 3_000_000, 4096
#: A run is frequent from so many records of one batch on; so many of the most frequent runs are ordered by their counts,
#: and besides those found in over two groups of records, at most one for every 2 * GROUP postings.
LOCAL_COUNT, FREQUENT = 2, 1 << 17
#: Ids up to this number are told to all tasks, to leave out sets where they lie; with more, a join does it.
TOLD = 1 << 20
#: How often records are posted at most, while runs prove frequent; what is frequent after that is cut where it lies.
TURNS = 4
#: Runs that two sets must share among their first ones; each set is posted under as many more runs.
SHARED = 3

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray, m: np.uint64 = M2) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * m
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Rule:
    """Runs of ``width`` tokens; sets of at least ``least`` runs are alike from ``similarity`` (Jaccard) on."""

    width: int = 5
    similarity: float = 0.8
    least: int = 1

    def overlap(self, a, b):
        """Common runs that sets of these sizes need."""
        t = self.similarity
        return np.ceil((a + b) * t / (1 + t) - 1e-9).astype(np.int64)

    def probe(self, n):
        """First runs of a set, of which ``SHARED`` are among the first of any shorter set that is alike."""
        return np.minimum(n, n - np.ceil(n * self.similarity - 1e-9).astype(np.int64) + SHARED)

    def index(self, n):
        """The same for sets at least as long."""
        return np.minimum(n, n - self.overlap(n, n) + SHARED)

    def radius(self, a, b):
        """Elements in which sets of these sizes may differ."""
        return a + b - 2 * self.overlap(a, b)


# --- sets -------------------------------------------------------------------------------------------------------------

SETS = "kind int, id bigint, n int, class bigint, codes binary"


def token_codes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each token, lower-cased; of a null that of no token."""
    d = values.dictionary_encode()
    words = pc.utf8_lower(d.dictionary).to_numpy(zero_copy_only=False)
    hashes = np.append(pd.util.hash_array(words.astype(object)) if len(words) else np.empty(0, np.uint64), np.uint64(0)).astype(np.uint64)
    return hashes[pc.fill_null(d.indices, len(words)).to_numpy(zero_copy_only=False)]


def run_sets(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of the runs of each record, and their offsets."""
    lengths = ends - starts
    counts = np.maximum(lengths - width + 1, 0)
    rows = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    x = np.zeros(len(at), np.uint64)
    for k in range(width):
        x = (x ^ (x >> np.uint64(31))) * M1 + tokens[at + k]
    keys = np.unique((rows.astype(np.uint64) << np.uint64(CODE_BITS)) | (mix(x) >> np.uint64(64 - CODE_BITS)))
    offsets = np.searchsorted(keys, np.arange(len(starts) + 1, dtype=np.uint64) << np.uint64(CODE_BITS))
    return keys & np.uint64((1 << CODE_BITS) - 1), offsets


def packed(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // CODE_BYTES, 8), np.uint8)
    out[:, :CODE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, CODE_BYTES)
    return out.view("<u8")[:, 0]


def ordered_tokens(tokens: pa.Array, positions: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens in order of position, and the range of each record."""
    offsets = tokens.offsets.to_numpy()
    starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    values = tokens.values
    if pa.types.is_list(values.type):  # lists of lists: a record's tokens lie one after another
        inner = values.offsets.to_numpy().astype(np.int64)
        starts, ends, values = inner[starts], inner[ends], values.values
    hashes = token_codes(values)
    if positions is not None:
        place = pc.fill_null(positions.values.cast(pa.int64()), 1 << 62).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(starts)), ends - starts)
        if np.any((np.diff(place) < 0) & (np.diff(row) == 0)):
            order = np.lexsort((place, row))
            first = starts[0] if len(starts) else 0
            hashes = np.concatenate([hashes[:first], hashes[first:][order]])
    if pc.any(pc.is_null(values)).as_py():  # a null is no token
        kept = pc.is_valid(values).to_numpy(zero_copy_only=False)
        kept = kept if positions is None else hashes != 0
        before = np.concatenate([[0], np.cumsum(kept)])
        hashes, starts, ends = hashes[kept], before[starts], before[ends]
    return hashes, starts, ends


def run_table(records: DataFrame, kind: int, rule: Rule) -> DataFrame:
    """The set of each record, and under ``kind`` -1 - kind the frequent runs of each batch (``id``: code, ``n``: records)."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("class", pa.int64()), ("codes", pa.binary())])
    placed = "positions" in records.columns
    records = records.select("id", "tokens", *["positions"] * placed)

    def run(batches):
        for batch in batches:
            hashes, starts, ends = ordered_tokens(batch.column(1), batch.column(2) if placed else None)
            codes, offsets = run_sets(hashes, starts, ends, rule.width)
            n = np.diff(offsets)
            good = np.flatnonzero(n >= rule.least)
            if len(good):
                low, high = offsets[good], offsets[good + 1]
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(codes, m))]) for m in (M2, M1)]
                one, two = (s[high] - s[low] for s in sums)
                named = mix(one ^ mix(two)).view(np.int64)
                raw = [packed(codes[a:b]) for a, b in zip(low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), kind, np.int32)), batch.column(0).take(pa.array(good)), pa.array(n[good].astype(np.int32)), pa.array(named), pa.array(raw, pa.binary())], schema=schema)
                known, counts = np.unique(codes, return_counts=True)
                often = counts >= LOCAL_COUNT
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1 - kind, np.int32)), pa.array(known[often].astype(np.int64)), pa.array(counts[often].astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=schema)

    return records.mapInArrow(run, SETS)


# --- blocks -----------------------------------------------------------------------------------------------------------


def frequent_runs(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the most frequent runs, sorted by code: at most ``FREQUENT``, whatever the data."""
    rows = table.where("kind < 0").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT).toPandas()
    rows = rows.sort_values("id")
    return rows["id"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64)


@dataclass(frozen=True)
class Found:
    """Written tables. pairs: ``kind, class_a, class_b, common, of_all``, classes alike. owners: ``kind, class, id``, the ids of
    each class. copies: ``kind, class, id, first``, the same of classes with several ids, with the smallest."""

    pairs: DataFrame
    owners: DataFrame
    copies: DataFrame

    def classes(self) -> DataFrame:
        """``kind, class, first``"""
        return self.owners.groupBy("kind", "class").agg(F.min("id").alias("first"))


def one_of_each(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One set of each class (``kind, id, n, codes``; id: the class), the owners and the copies.

    Sets that are left out are told to all tasks, so that no other set moves; a set delivered again stays, with the same name.
    """
    owners = written(sets.select("kind", "class", "id").distinct(), "owners")
    several = owners.groupBy("kind", "class").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    copies = written(owners.join(several, ["kind", "class"]).select("kind", "class", "id", "first"), "copies")
    left_out = copies.where("id <> first").select("kind", "class", "id")
    if left_out.count() <= TOLD:
        left_out = F.broadcast(left_out)
    kept = sets.join(left_out, ["kind", "class", "id"], "left_anti")
    return kept.select("kind", F.col("class").alias("id"), "n", "codes"), owners, copies


POSTINGS = "bucket int, kind int, m int, keys binary, ids binary, sizes binary, places binary, groups binary"


def planes(x: np.ndarray, size: int) -> bytes:
    """Bytes of little-endian numbers, the first of all, then the second: zeros lie together and compress."""
    return np.ascontiguousarray(x.astype(f"<u{size}")).view(np.uint8).reshape(-1, size).T.tobytes()


def unplaned(raw: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<u{size}")[:, 0]


def postings(sets: DataFrame, rule: Rule, buckets: int, frequent) -> DataFrame:
    """Each record under the first runs of its set, packed by bucket of runs."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("m", pa.int32()), *[(c, pa.binary()) for c in ("keys", "ids", "sizes", "places", "groups")]])

    def run(batches):
        known, counts = frequent.value
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for kind in np.unique(kinds):
                chosen = np.flatnonzero(kinds == kind)
                ids = batch.column(1).to_numpy()[chosen]
                n = batch.column(2).to_numpy()[chosen].astype(np.int64)
                codes = unpacked(b"".join(batch.column(3).take(pa.array(chosen)).to_pylist()))
                rows = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                weight = np.where(known[at] == codes, counts[at], 0) if len(known) else np.zeros(len(codes), np.int64)
                order = np.lexsort((codes, weight, rows))
                start = np.cumsum(n) - n
                place = np.arange(len(codes)) - np.repeat(start, n)
                first = place < np.repeat(rule.probe(n), n)
                take = order[first]
                keys, who, place, load = codes[take], rows[first], place[first], weight[take]
                # a frequent run: the record joins the blocks of its group with each group
                groups = np.maximum(1, -(-load // GROUP))
                mine = (mix(ids.astype(np.uint64))[who] % groups.astype(np.uint64)).astype(np.int64)
                rep = np.repeat(np.arange(len(keys)), groups)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(groups) - groups, groups)
                own = mine[rep]
                low, high = np.minimum(own, other), np.maximum(own, other)
                cell = low * groups[rep] + high
                cut = groups[rep] > 1
                keys = np.where(cut, mix(keys[rep] * M1 + cell.astype(np.uint64)), keys[rep] << np.uint64(64 - CODE_BITS))
                side = np.where(cut & (low != high), np.where(own == low, 1, 2), 0)
                who, place = who[rep], place[rep]
                bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
                out = []
                for b in np.flatnonzero(np.diff(edges)):
                    x = by[edges[b] : edges[b + 1]]
                    out.append((int(b), int(kind), len(x), planes(keys[x] >> np.uint64(64 - CODE_BITS), CODE_BYTES + 3)[: len(x) * CODE_BYTES], planes(ids[who[x]].view(np.uint64), 8), planes(n[who[x]], 4), planes(place[x], 4), planes(side[x], 1)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return sets.select("kind", "id", "n", "codes").mapInArrow(run, POSTINGS)


BLOCKS = "kind int, block bigint, id bigint, side int, common int, need int, ok int"
STAR, HOT = 3, 4


def stars(ids, n, place, side, start, size, rule: Rule):
    """Records that may be alike, from posting lists with at most 64 records in order of size: for each two, the runs of
    this bucket that they share, the runs they need to share, and whether a run leaves room for their overlap.

    Two sets that are alike meet first under the run that both have first. There the places of the run leave room for
    the overlap they need; under other runs they may fail this test.
    """
    found = [np.empty((0, 4), np.int64)]
    for low in range(0, len(start), 1 << 15):
        begin, m = start[low : low + (1 << 15)], size[low : low + (1 << 15)]
        at = np.repeat(begin - (np.cumsum(m) - m), m) + np.arange(m.sum())
        later = np.repeat(begin + m, m) - at - 1
        a = np.repeat(at, later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        keep = (place[a] < rule.index(n[a])) & (n[a] >= rule.similarity * n[b] - 1e-9) & (ids[a] != ids[b]) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[keep], b[keep]
        need = rule.overlap(n[a], n[b])
        room = np.minimum(n[a] - place[a], n[b] - place[b])
        found.append(np.stack([ids[a], ids[b], np.minimum(need, SHARED), room >= need], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])) if len(rows) else np.empty(0, np.int64)
    if len(first):
        yield rows[first, 0], rows[first, 1], np.full(len(first), STAR), np.diff(np.append(first, len(rows))), rows[first, 2], np.maximum.reduceat(rows[:, 3], first)


def whole(ids, side, start, size):
    """Longer lists as blocks of all their records; those with the same records have the same name.

    Lists that are longer than two groups, as their run is more frequent than any batch showed, are cut here.
    """
    cut = size > 2 * GROUP
    for s, m in zip(start[cut], size[cut]):
        if side[s : s + m].any():  # a pair of groups already: their hashes are even
            cut[np.flatnonzero(start == s)] = False
            continue
        own = ids[s : s + m]
        name = mix(own.astype(np.uint64) * M1).sum()
        n = -(-m // GROUP)
        mine = (mix(own.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        for other in range(n):
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            block = mix(name + (low * n + high).astype(np.uint64) * M1).view(np.int64)
            yield block, own, np.where(low == high, 0, np.where(mine == low, 1, 2)), *[np.ones(m, np.int64)] * 3
    start, size = start[~cut], size[~cut]
    if len(start):
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        tags = mix(ids[at].astype(np.uint64) * M1 + side[at].astype(np.uint64))
        block = np.add.reduceat(tags, np.cumsum(size) - size)
        yield np.repeat(block, size).view(np.int64), ids[at], side[at], *[np.ones(len(at), np.int64)] * 3


def blocks(posted: DataFrame, rule: Rule, buckets: int, last: bool) -> DataFrame:
    """Members of each block (``whole``; ``side`` 1 is compared with 2, 0 with any) and records that may be alike (``stars``).

    Lists longer than two groups are only counted (``side`` HOT, ``block``: the run, ``common``: records), unless ``last``.
    """
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("id", pa.int64()), *[(c, pa.int32()) for c in ("side", "common", "need", "ok")]])

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for _, kind, m, keys, ids, sizes, places, groups in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.zeros((CODE_BYTES + 3, m), np.uint8)
                wide[:CODE_BYTES] = np.frombuffer(keys, np.uint8).reshape(CODE_BYTES, m)
                parts.setdefault(kind, []).append((unplaned(wide.tobytes(), 8), unplaned(ids, 8).view(np.int64), unplaned(sizes, 4).astype(np.int64), unplaned(places, 4).astype(np.int64), unplaned(groups, 1)))
        for kind, found in parts.items():
            keys, ids, n, place, side = (np.concatenate(x) for x in zip(*found))
            found.clear()
            order = np.lexsort((ids, n, keys))
            keys, ids, n, place, side = keys[order], ids[order], n[order], place[order], side[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(start, len(keys)))
            small = (size > 1) & (size <= 64)
            if not last and (long := size > 2 * GROUP).any():
                runs = keys[start[long]].astype(np.int64)
                m = len(runs)
                zero = pa.array(np.zeros(m, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(runs), pa.array(np.zeros(m, np.int64)), pa.array(np.full(m, HOT, np.int32)), pa.array(size[long].astype(np.int32)), zero, zero], schema=schema)
                start, size, small = start[~long], size[~long], small[~long]
            out = chain(stars(ids, n, place, side, start[small], size[small], rule), whole(ids, side, start[size > 64], size[size > 64]))
            for block, member, *more in out:
                for low in range(0, len(block), 1 << 16):
                    x = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block[x]), kind, np.int32)), pa.array(block[x]), pa.array(member[x]), *[pa.array(c[x].astype(np.int32)) for c in more]], schema=schema)

    return posted.repartitionById(buckets, "bucket").mapInArrow(run, BLOCKS)


def posted_blocks(sets: DataFrame, rule: Rule, buckets: int, frequent: tuple[np.ndarray, np.ndarray], last: bool) -> DataFrame:
    told = sets.sparkSession.sparkContext.broadcast(frequent)
    return written(blocks(postings(sets, rule, buckets, told), rule, buckets, last), "blocks")


def block_members(found: DataFrame) -> DataFrame:
    """``kind, block, id, side``: blocks of whole lists, and one block of each record with those it may be alike.

    A pair that shares too few runs in short lists but is alike shares one of a long list, whose block has it.
    """
    pairs = found.where(F.col("side") == STAR).groupBy("kind", "block", "id").agg(F.sum("common").alias("common"), F.max("need").alias("need"), F.max("ok").alias("ok"))
    pairs = written(pairs.where("common >= need and ok > 0").select("kind", F.col("block").alias("first"), "id"), "candidates")
    name = F.xxhash64("first", F.lit(STAR)).alias("block")
    long = found.where(F.col("side") < STAR).select("kind", "block", "id", "side").distinct()
    heads = pairs.select("kind", "first").distinct().select("kind", name, F.col("first").alias("id"), F.lit(1).alias("side"))
    return long.unionByName(heads).unionByName(pairs.select("kind", name, "id", F.lit(2).alias("side")))


# --- comparison -------------------------------------------------------------------------------------------------------

PAIRS = "kind int, class_a bigint, class_b bigint, common int, of_all int"
#: Bytes of planes made at a time; codes checked at a time.
PLANE_BYTES, CHECKED = 1 << 26, 1 << 21
#: Bytes of sets from which blocks are compared without waiting for more.
HELD_BYTES = 1 << 26


def sketched(sets: list[np.ndarray], width: np.ndarray) -> list[np.ndarray]:
    """By width class: (records, bytes) sketches of the records of at least this class, the wider ones folded; zeros for others."""
    out: list[np.ndarray] = []
    wider = None
    for k in range(int(width.max(initial=0)), -1, -1):
        bits = bitslice.LEAST << k
        now = np.zeros((len(sets), bits // 8), np.uint8)
        if wider is not None:
            now[:] = bitslice.folded(wider)
        own = np.flatnonzero(width == k)
        if len(own):
            codes = np.concatenate([sets[i] for i in own])
            now[own] = bitslice.parity_sketches(codes, np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])]), bits)
        out.append(now)
        wider = now
    return out[::-1]


def common_runs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes the sets of each pair share: the smaller one's are looked up in all sets, keyed by record."""
    n = np.array([len(s) for s in sets], np.int64)
    keyed = np.concatenate(sets) | (np.repeat(np.arange(len(sets), dtype=np.uint64), n) << np.uint64(CODE_BITS))
    start = np.concatenate([[0], np.cumsum(n)])
    swap = n[a] > n[b]
    less, more = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), np.int64)
    edges = np.concatenate([[0], np.cumsum(n[less])])
    low = 0
    while low < len(less):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + CHECKED, side="right")) - 1)
        m = n[less[low:high]]
        pair = np.repeat(np.arange(low, high), m)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + start[less[pair]]
        wanted = (keyed[at] & np.uint64((1 << CODE_BITS) - 1)) | (more[pair].astype(np.uint64) << np.uint64(CODE_BITS))
        place = np.minimum(np.searchsorted(keyed, wanted), len(keyed) - 1)
        out[low:high] = np.bincount(pair - low, keyed[place] == wanted, high - low)
        low = high
    return out


def compare(kind: int, ids: np.ndarray, block: np.ndarray, side: np.ndarray, raw: list[bytes], rule: Rule) -> list[tuple]:
    """Pairs alike within the blocks given (rows sorted by block, then by size and id)."""
    uid, first, rec = np.unique(ids, return_index=True, return_inverse=True)
    sets = [unpacked(raw[i]) for i in first]
    n = np.array([len(s) for s in sets], np.int64)
    width = bitslice.width_class(rule.radius(n, n))
    sketches = sketched(sets, width)
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    size = np.diff(np.append(start, len(block)))
    # words of 64 candidates, units of a query with each word that holds a later member of its block
    words_of = -(-size // 64)
    word_block = np.repeat(np.arange(len(start)), words_of)
    word_no = np.arange(len(word_block)) - np.repeat(np.cumsum(words_of) - words_of, words_of)
    lane = start[word_block][:, None] + word_no[:, None] * 64 + np.arange(64)
    inside = word_no[:, None] * 64 + np.arange(64) < size[word_block][:, None]
    lane = np.where(inside, lane, 0)
    words = rec[lane]
    pairs: list[np.ndarray] = [np.empty(0, np.int64)]
    step = max(1, min(512, PLANE_BYTES // (8 * (bitslice.LEAST << len(sketches) - 1))))
    for low in range(0, len(words), step):
        w = np.arange(low, min(low + step, len(words)))
        planes: dict[int, np.ndarray] = {}
        queries = np.minimum((word_no[w] + 1) * 64, size[word_block[w]])
        unit_word = np.repeat(w, queries)
        q_at = np.arange(len(unit_word)) - np.repeat(np.cumsum(queries) - queries, queries) + start[word_block[unit_word]]
        for a in range(0, len(unit_word), 1 << 15):
            uw, qa = unit_word[a : a + (1 << 15)], q_at[a : a + (1 << 15)]
            q, c = rec[qa], words[uw]
            valid = inside[uw] & (lane[uw] > qa[:, None]) & (c != q[:, None]) & (n[c] * rule.similarity <= n[q][:, None] + 1e-9) & (n[q][:, None] * rule.similarity <= n[c] + 1e-9)
            valid &= (side[lane[uw]] == 0) | (side[lane[uw]] != side[qa][:, None])
            radii = np.where(valid, rule.radius(n[c], n[q][:, None]), -1)
            # the narrowest sketch of those compared
            narrow = np.minimum(width[q], np.where(valid, width[c], 99).min(axis=1))
            for k in np.unique(narrow[valid.any(axis=1)]):
                unit = np.flatnonzero((narrow == k) & valid.any(axis=1))
                if k not in planes:
                    planes[k] = bitslice.stored(sketches[k], words[w])
                u, at = bitslice.within(planes[k], sketches[k], q[unit], uw[unit] - low, radii[unit])
                x, y = q[unit[u]], c[unit[u], at]
                pairs.append(np.minimum(x, y) * len(sets) + np.maximum(x, y))
    a, b = np.divmod(np.unique(np.concatenate(pairs)), len(sets))
    common = common_runs(sets, a, b)
    union = n[a] + n[b] - common
    good = common >= rule.similarity * union - 1e-9
    return [(kind, *row) for row in zip(uid[a[good]].tolist(), uid[b[good]].tolist(), common[good].tolist(), union[good].tolist())]


def alike(members: DataFrame, sets: DataFrame, rule: Rule, tasks: int) -> DataFrame:
    """Pairs of classes that are alike: ``kind, class_a, class_b`` and the sizes of their common part and union."""
    schema = pa.schema([("kind", pa.int32()), ("class_a", pa.int64()), ("class_b", pa.int64()), ("common", pa.int32()), ("of_all", pa.int32())])
    rows = members.join(sets.select("kind", "id", "n", "codes"), ["kind", "id"]).select("kind", "block", "side", "n", "id", "codes")
    rows = rows.repartition(tasks, "kind", "block").sortWithinPartitions("kind", "block", "side", "n", "id")

    def done(held: list) -> list:
        out = []
        for kind in sorted({int(k) for t in held for k in np.unique(t.column("kind"))}):
            t = pa.concat_tables(x.filter(pc.equal(x["kind"], kind)) for x in held)
            out += compare(kind, t["id"].to_numpy(), t["block"].to_numpy(), t["side"].to_numpy(), t["codes"].to_pylist(), rule)
        return out

    def run(batches):
        held, rows, codes, last = [], 0, 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            # whole blocks are compared together: what follows the last edge waits
            names = t["block"].to_numpy()
            if rows + len(names) > 30_000 or codes > HELD_BYTES:
                edge = np.flatnonzero(np.concatenate([[last is not None and names[0] != last], names[1:] != names[:-1]]))
                if len(edge):
                    held.append(t.slice(0, edge[-1]))
                    out = done(held)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)
                    held, rows, codes, t = [], 0, 0, t.slice(edge[-1])
            held.append(t)
            rows += len(t)
            codes += pc.sum(t["n"]).as_py() * CODE_BYTES
            last = names[-1]
        out = done(held) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)

    return rows.mapInArrow(run, PAIRS)


def near_duplicates(tables: list[DataFrame], rule: Rule) -> Found:
    """All pairs alike within each table (``kind``: the table's number).

    tables: ``id bigint, tokens array<string> [, positions array<int>]`` or ``id, tokens array<array<string>>``.

    Null and empty lists, null tokens and records under the rule's least size have no set. An id delivered again with the
    same set counts once; with another set it is in both sets' classes, and each is compared. Records of any length are
    compared whole. No pair is lost but by a clash of 40-bit codes, which can only add a common run (for two sets of 100,
    one in 10^8), or by two different sets with one 64-bit name (of a billion sets, one pair with a chance of 3 %).
    """
    spark = tables[0].sparkSession
    table = run_table(tables[0], 0, rule)
    for kind, t in enumerate(tables[1:], 1):
        table = table.unionByName(run_table(t, kind, rule))
    table = written(table, "sets")
    sets = table.where("kind >= 0")
    frequent = frequent_runs(table)
    one, owners, copies = one_of_each(sets)
    total = sets.agg(F.sum(F.col("n"))).first()[0] or 0
    tasks = max(parallelism(spark), 1)
    buckets = max(tasks, math.ceil(total * (1 - rule.similarity) / BUCKET_POSTINGS))
    for turn in range(TURNS):
        found = posted_blocks(one, rule, buckets, frequent, last=turn == TURNS - 1)
        hot = found.where(F.col("side") == HOT).groupBy("block").agg(F.max("common").alias("n")).toPandas()
        if not len(hot):
            break
        # runs that no batch showed to be frequent: they are put in order by their counts, and all records posted anew
        known = dict(zip(frequent[0].tolist(), frequent[1].tolist()))
        for code, n in zip(hot["block"].tolist(), hot["n"].tolist()):
            known[code] = max(known.get(code, 0), n)
        frequent = np.array(sorted(known), np.uint64), np.array([known[c] for c in sorted(known)], np.int64)
    members = block_members(found)
    ids = members.select("kind", "id").distinct()
    if ids.count() <= TOLD:
        one = one.join(F.broadcast(ids), ["kind", "id"], "left_semi")
    pairs = alike(members, one, rule, max(tasks, buckets)).groupBy("kind", "class_a", "class_b").agg(F.max("common").alias("common"), F.min("of_all").alias("of_all"))
    return Found(written(pairs, "pairs"), owners, copies)


def all_pairs(found: Found) -> DataFrame:
    """``kind, id_a, id_b`` of every two ids alike: the ids of classes alike, and those of one class among themselves."""
    a = found.owners.select("kind", F.col("class").alias("class_a"), F.col("id").alias("a"))
    b = found.owners.select("kind", F.col("class").alias("class_b"), F.col("id").alias("b"))
    across = found.pairs.select("kind", "class_a", "class_b").join(a, ["kind", "class_a"]).join(b, ["kind", "class_b"]).select("kind", "a", "b")
    copies = found.copies.select("kind", "class", F.col("id").alias("a"))
    same = copies.join(found.copies.select("kind", "class", F.col("id").alias("b")), ["kind", "class"]).where("a < b").select("kind", "a", "b")
    ends = across.unionByName(same).where("a <> b")
    return ends.select("kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def members(found: Found) -> DataFrame:
    """``kind, id, class_id, links``: the smallest id with an equal set, and how many other classes this one is alike.

    Of an id with several sets: the smallest of these ids, and the links of all its classes.
    """
    ends = found.pairs.select("kind", F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("kind", "class").agg(F.count(F.lit(1)).alias("links"))
    classed = found.owners.join(found.classes(), ["kind", "class"]).join(ends, ["kind", "class"], "left")
    return classed.groupBy("kind", "id").agg(F.min("first").alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


def groups(found: Found) -> DataFrame:
    """``kind, id, group_id``: the smallest id that can be reached over pairs and copies.

    Edges are turned to the smallest neighbour in turns from larger and from smaller ends, until none changes; no node's
    neighbours are ever collected, and the number of turns follows the logarithm of the longest path.
    """
    first = found.classes()
    a, b = first.select("kind", F.col("class").alias("class_a"), F.col("first").alias("a")), first.select("kind", F.col("class").alias("class_b"), F.col("first").alias("b"))
    pairs = found.pairs.join(a, ["kind", "class_a"]).join(b, ["kind", "class_b"]).where("a <> b")
    edges = pairs.select("kind", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(edges.unionByName(found.copies.where("id <> first").select("kind", F.col("id").alias("u"), F.col("first").alias("v"))).distinct(), "edges")
    ids = found.owners.select("kind", "id").distinct()
    mark = F.sum(F.xxhash64("kind", "u", "v").cast("decimal(38,0)"))
    before = None
    while before != (now := tuple(edges.agg(F.count(F.lit(1)), mark).first())):
        before = now
        both = edges.unionByName(edges.select("kind", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("kind", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, ["kind", "u"]).where("v > u").select("kind", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("kind", "u").agg(F.min("v").alias("m"))
        turned = edges.join(least, ["kind", "u"])
        edges = turned.select("kind", "u", F.col("m").alias("v")).unionByName(turned.select("kind", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        edges = written(edges, "edges")
    roots = edges.select("kind", F.col("u").alias("id"), F.col("v").alias("group_id"))
    return ids.join(roots, ["kind", "id"], "left").select("kind", "id", F.coalesce("group_id", "id").alias("group_id"))
