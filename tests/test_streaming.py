import json
import time

from pagelathe.streaming import revisions as stream


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("page", "ver", "contributor", "text"), r))) for r in rows))


def test_diffs_of_arriving_revisions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    query = stream.arriving_diffs(stream.read_revisions(spark, str(source))).writeStream.format("memory").queryName("arriving").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        put(source, "1.json", [("P", "1", None, "a b"), ("Q", "1", None, "x"), (None, "1", None, "x")])
        query.processAllAvailable()
        time.sleep(0.1)
        put(source, "2.json", [("P", "2", None, "a [[C]]"), ("P", "3", None, ""), ("P", "0", None, "late")])
        query.processAllAvailable()
        rows = spark.table("arriving").collect()
    finally:
        query.stop()
    assert [(r.page, r.ver1, r.ver2, [(o.action, o.position, list(o.tokens)) for o in r.diff]) for r in rows] == [("P", "1", "2", [("DEL", 2, ["b"]), ("INS", 2, ["[E]C"])])]


def test_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, "1.json", [("P", "2020-01-01T00:10:00Z", None, "a"), ("P", "2020-01-01T00:20:00Z", None, "a"), ("P", "2020-01-01T01:20:00Z", None, "a")])
    query = stream.revisions_per_window(stream.read_revisions(spark, str(source))).writeStream.format("memory").outputMode("complete").queryName("windows").start()
    try:
        query.processAllAvailable()
        assert sorted(r.revs for r in spark.table("windows").collect()) == [1, 2]
    finally:
        query.stop()
