import json
import random

import pytest

from pagelathe.operators import compaction
from pagelathe.session import scratch

SCHEMA = "file_id bigint, path string, title string, n_bytes bigint, written_at timestamp, body string"


def files(spark, bodies):
    return spark.createDataFrame([(i, f"p/{i}", "hint", 1, None, b) for i, b in enumerate(bodies)], SCHEMA).selectExpr("*", "1 as bin", "2 as shard", "3 as kind", "'v' as ver")


def line(title, ver, **more):
    return json.dumps({"title": title, "timestamp": ver, **more})


def test_first_fit_decreasing_is_the_naive_one():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        sizes = [rng.randint(1, capacity + 5) for _ in range(rng.randint(0, 30))]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            size = min(sizes[i], capacity)
            b = next((b for b, r in enumerate(room) if r >= size), len(room))
            if b == len(room):
                room.append(capacity)
            room[b] -= size
            want[i] = b
        assert compaction.first_fit_decreasing(sizes, capacity) == want


def test_each_record_once(spark):
    bodies = [
        line("A", "1") + "\n" + line("A", "2") + "\r\n",
        line("A", "1", contributor="again"),
        "﻿" + line("B", "1") + "​\n\n   " + line("a", "1") + "  \n",
        line("C", "1")[:-4], "crc\x00\x01123", "locked", "null", "[]", "{}", "", None,
        line("D", "1") + line("D", "2"), line(None, "1"), line("E", None), line(" ", "1"), '{"title": "F", "timestamp": "1", "x": NaN}', json.dumps([json.loads(line("G", "1"))]),
        line("Long", "1", text="x " * 200_000),
    ]
    out = compaction.compacted(files(spark, bodies))
    assert sorted((r.title, r.ver) for r in out.collect()) == [("A", "1"), ("A", "2"), ("B", "1"), ("Long", "1"), ("a", "1")]
    kept = {(r.title, r.ver): json.loads(r.record) for r in out.collect()}
    assert len(kept["Long", "1"]["text"]) == 400_000


def test_many_files_few_bins(spark):
    rng = random.Random(4)
    bodies = ["\n".join(line(f"T{i}", str(k), text="y" * rng.randint(0, 300)) for k in range(rng.randint(1, 4))) for i in range(400)]
    path = scratch(spark, "out")
    out = compaction.compact(files(spark, bodies + bodies[:100]), path, target_bytes=8_000)
    assert sorted((r.title, r.ver) for r in out.collect()) == sorted((r["title"], r["timestamp"]) for b in bodies for r in map(json.loads, b.split("\n")))
    sizes = {r.bin: r.n for r in out.selectExpr("bin", "length(record) + 1 as n").groupBy("bin").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert max(sizes.values()) <= 8_000 and len(sizes) <= 1.3 * sum(sizes.values()) / 8_000 + 3
    with pytest.raises(RuntimeError):
        compaction.compact(files(spark, bodies), path)


def test_wrong_checksums_are_found(spark):
    plan, shards = compaction.packed(compaction.manifest(files(spark, [line("A", "1"), line("B", "1")])), 1000)
    rows = compaction.rewritten(files(spark, [line("A", "1"), line("B", "1", more=1)]), plan, shards)
    with pytest.raises(RuntimeError):
        compaction.verify(plan, rows)


def test_empty(spark):
    assert compaction.compacted(files(spark, [])).count() == 0


def test_files_without_an_id_keep_their_records(spark):
    bodies = [line("A", "1") + "\n" + line("B", "1"), line("C", "1"), line("C", "1"), "\n" + line("A", "1", more=1), line("D", "1"), None]
    rows = files(spark, bodies).selectExpr("if(file_id < 4 or file_id = 5, null, file_id) as file_id", "timestamp_seconds(file_id) as written_at", "body")
    got = compaction.compacted(rows).select("title", "ver", "record").collect()
    assert sorted((r.title, r.ver) for r in got) == [("A", "1"), ("B", "1"), ("C", "1"), ("D", "1")]
    assert next(r.record for r in got if r.title == "A") == line("A", "1", more=1)
