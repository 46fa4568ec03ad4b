import bz2
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pagelathe import config
from pagelathe.__main__ import main
from pagelathe.operators import revisions as R
from pagelathe.plans import pipeline
from pagelathe.sources import dumps, files, selection

XML = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><siteinfo><sitename>x</sitename></siteinfo>
<page><title>A</title><ns>0</ns><revision><id>1</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username> Ann </username></contributor><format>text/x-wiki</format><text xml:space="preserve">a b [[B]] &amp;nbsp;</text></revision>
<revision><timestamp>2020-01-02T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><format> text/x-wiki
</format><text>a c [[B]]</text></revision>
<revision><timestamp>2020-01-03T00:00:00Z</timestamp><contributor><username>Bot</username></contributor><format>application/json</format><text>{}</text></revision>
<revision><timestamp>2020-01-04T00:00:00Z</timestamp><contributor><username>Bot</username></contributor><format>text/x-wiki</format><text>lost</text></revision></page>
<page><title>C++</title><revision><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username></username></contributor><format>text/x-wiki</format><text></text></revision></page>
</mediawiki>"""


@pytest.fixture
def dump(tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    (folder / "one.xml.bz2").write_bytes(bz2.compress(XML.encode()))
    (folder / "ignored.txt").write_text("<page><title>no</title></page>")
    return str(folder)


def test_dump_and_revisions(spark, dump):
    rows = dumps.kept_revisions(dumps.read_dump(spark, dump)).orderBy("page", "rev_ord").collect()
    assert [(r.page, r.ver[:10], r.contributor, r.rev_ord) for r in rows] == [("A", "2020-01-01", "Ann", 0), ("A", "2020-01-02", None, 1), ("C++", "2020-01-01", None, 0)]
    assert rows[0].text == "a b [[B]] &nbsp;"
    split = dumps.read_dump(spark, dump)
    assert split.count() == 2 and split.exceptAll(dumps.read_dump(spark, dump, whole=True)).count() == 0


def test_splits_within_a_file_lose_no_page(spark, tmp_path):
    rng = random.Random(16)
    pages = "".join(f"<page>\n <title>T{i}</title>\n <revision><timestamp>{i}</timestamp><format>text/x-wiki</format><text>{rng.random()}\n{'z' * rng.randint(0, 900)}{rng.getrandbits(4000)}</text></revision>\n</page>\n" for i in range(2000))
    (tmp_path / "a.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>\n{pages}</mediawiki>".encode(), 1))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        split = dumps.read_dump(spark, str(tmp_path))
        assert split.rdd.getNumPartitions() > 2
        assert split.exceptAll(dumps.read_dump(spark, str(tmp_path), whole=True)).count() == 0 and split.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_pipeline_and_command_line(spark, dump, tmp_path, capsys):
    work = str(tmp_path / "work")
    log = tmp_path / "log"
    out = pipeline.run(spark, dumps.kept_revisions(dumps.read_dump(spark, dump)), work, str(log))
    assert {r.page: (r.revs, r.links, r.avg_tokens, r.inss, r.dels) for r in out["statistics"].collect()} == {"A": (2, 1, 4, 1, 2), "C++": (1, 0, 0, 0, 0)}
    assert [line.split(" -- ")[0] for line in log.read_text().splitlines()] == [f"{e}-{p}" for p in ("TASK1", "STAT1", "TASK2", "STAT2", "TASK3") for e in ("BEGIN", "END")]
    page = tmp_path / "page.txt"
    page.write_text("a [[b]]")
    main(["-s", str(page)])
    assert json.loads(capsys.readouterr().out)["unstructured_part"][1] == {"text": "b", "link": "b", "position": 2}


def test_json_lines_round_trip(spark, dump, tmp_path):
    parsed = R.parsed_pages(dumps.kept_revisions(dumps.read_dump(spark, dump)))
    for name, per_page in (("ranges", False), ("json", True)):
        files.write_pages(parsed, str(tmp_path / name), per_page)
        back = files.read_pages(spark, str(tmp_path / name))
        columns = ["page", "ver", "contributor", "structured_part", "unstructured_part"]
        assert back.select(columns).exceptAll(parsed.select(columns)).count() == 0 and back.count() == 3
    line = json.loads(next((tmp_path / "json" / "slug=c").glob("*.txt")).read_text())
    assert line == {"title": "C++", "timestamp": "2020-01-01T00:00:00Z", "contributor": None, "structured_part": [], "unstructured_part": []}
    diffs = R.page_diffs(parsed)
    files.write_diffs(diffs, str(tmp_path / "diffs"))
    assert files.read_diffs(spark, str(tmp_path / "diffs")).exceptAll(diffs).count() == 0
    counts = R.link_counts(R.page_links(parsed))
    files.write_counts(counts, str(tmp_path / "counts"))
    assert files.read_counts(spark, str(tmp_path / "counts")).count() == counts.count() == 2


def test_statistics_csv(spark, tmp_path):
    rows = spark.createDataFrame([('say "x", y', 1, 2, 3), ("b", 4, 5, 6)], files.FIRST)
    files.write_statistics(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"page","revs","links","avg_tokens"' in text and '"say ""x"", y",1,2,3' in text
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "statistics1_a.csv").write_text('"page","revs","links","avg_tokens"\n"a",1,2,3\n"a",4,5,6\n')
    (tmp_path / "in" / "statistics2_a.csv").write_text('"page","inss","dels","added_tokens","removed_tokens"\n"a",1,x,3,4\n')
    assert files.read_statistics(spark, str(tmp_path / "in"), 1).count() == 2
    assert [tuple(r) for r in files.read_statistics(spark, str(tmp_path / "in"), 1, last_wins=True).collect()] == [("a", 4, 5, 6)]
    with pytest.raises(Exception, match="(?s)MALFORMED|FAILFAST|x"):
        files.read_statistics(spark, str(tmp_path / "in"), 2).collect()


def test_selection_chunks_and_parts(spark, tmp_path):
    pages = spark.createDataFrame([(f"{t}", f"<page><title>{t}</title>{'x' * n}</page>") for t, n in (("A", 50), ("User:B", 50), ("User talk:C", 50), ("D", 1))], "t string, xml string")
    pages = pages.withColumn("title", selection.title_of(F.col("xml")))
    assert [r.title for r in selection.selected(pages, "xml", "title", 60).orderBy("title").collect()] == ["A", "User talk:C"]
    rng = random.Random(15)
    rows = spark.createDataFrame([(i, rng.randint(1, 30)) for i in range(200)], "i int, size int").repartition(7)
    kept = {r.i: r.chunk for r in selection.chunks(rows, ["i"], 7).collect()}
    assert kept == {i: i // 7 for i in range(200)}
    assert {r.i for r in selection.chunks(rows, ["i"], 30, whole=True).collect()} == set(range(180))
    assert {r.i for r in selection.chunks(rows, ["i"], 30, most=2).collect()} == set(range(60))
    with pytest.raises(ValueError):
        selection.chunks(rows, ["i"], 0)
    total, want = 0, {}
    for r in sorted(rows.collect()):
        want[r.i] = total // 100
        total += r["size"]
    assert {r.i: r.part for r in selection.rolling_parts(rows, ["i"], F.col("size"), 100).collect()} == want
    assert sorted(r.i for r in selection.resumed_after(rows, ["i"], "i", "150").collect()) == list(range(151, 200))
    assert selection.resumed_after(rows, ["i"], "i", "999").count() == 0
    files.write_xml_parts(selection.chunks(pages, ["t"], 2), "xml", "chunk", str(tmp_path / "xml"))
    assert dumps.read_dump(spark, [str(tmp_path / "xml")]).count() == dumps.read_dump(spark, [str(tmp_path / "xml")], whole=True).count() == 4


STATUS = {"jobs": {"articlesdump": {"status": "done", "files": {f"f{n}": {"url": f"/f{n}", "md5": hashlib.md5(b"x" * n).hexdigest(), "size": n} for n in (30, 10, 20)}}}}


def fake(url):
    return json.dumps(STATUS).encode() if url.endswith("dumpstatus.json") else b"x" * int(url.rsplit("/f", 1)[1])


def test_online_files(spark, tmp_path):
    found = dumps.listed_files(dumps.dump_status("http://e", "v", fake), most=2)
    assert [f.size for f in found] == [10, 20]
    path = dumps.cached_file("http://e", found[0], str(tmp_path), fake)
    assert dumps.cached_file("http://e", found[0], str(tmp_path), None) == path
    with pytest.raises(dumps.IntegrityError):
        dumps.cached_file("http://e", found[1], str(tmp_path), lambda url: b"broken")
    with pytest.raises(RuntimeError):
        dumps.listed_files({"jobs": {"articlesdump": {"status": "waiting", "files": {}}}})
    assert [(r.md5, r.size) for r in dumps.checked_files(spark, str(tmp_path)).collect()] == [(found[0].md5, 10)]

    assert dumps.cached_file("http://e", found[1], f"file://{tmp_path}/new", fake) == f"file://{tmp_path}/new/wikidump_{found[1].md5}.bz2"

    reader = dumps.OnlineReader({"endpoint": "http://e", "version": "v", "max": "2"}, fake)
    parts = reader.partitions()
    assert [next(iter(reader.read(p)))[2] for p in parts] == [10, 20]


def test_config():
    lines = ['{ "master": "local", # comment', '  "appName": "a#b",', "# whole line", '  "config": {"x": "1"} }']
    assert config.load(lines) == {"master": "local", "appName": "a#b", "config": {"x": "1"}}
    with pytest.raises(json.JSONDecodeError):
        config.load(["{"])
    with pytest.raises(KeyError):
        config.session({"master": "local"})
    assert config.online({"wiki-version": "1", "process-in-memory": True, "max-dump": None}) == config.Online("1", True, None)
    assert config.online().max_dump == 3


def test_records_of_a_stream():
    import io

    text = "a</page>bb</page></page>\nlast"
    for size in (1, 3, 100):
        assert sum(dumps.records_in(io.StringIO(text), "</page>", size), []) == ["a", "bb", "", "\nlast"]


def test_debug_options(spark, dump, tmp_path, capsys):
    conf = tmp_path / "conf.json"
    conf.write_text('{"master": "local", "appName": "x", "config": {}}')
    main(["--compressed", f"{dump}/one.xml.bz2", "-c", str(conf)])
    assert sorted(capsys.readouterr().out.splitlines()) == ["A 2020-01-01T00:00:00Z 4", "A 2020-01-02T00:00:00Z 3", "C++ 2020-01-01T00:00:00Z 0"]
    main(["--split", f"{dump}/one.xml.bz2", "--pages", "1", "-w", str(tmp_path / "w"), "-c", str(conf)])
    assert len(list((tmp_path / "w" / "parts").glob("chunk=*/*.txt"))) == 2


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from pagelathe.session import shared_dir

    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError):
        shared_dir(elsewhere)


def test_scratch_tables_are_deleted(spark):
    from pagelathe.session import clean, written

    table = written(spark.range(5), "numbers")
    assert table.count() == 5
    clean(spark)
    with pytest.raises(Exception, match="(?s)PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        written(spark.range(1), "other").sparkSession.read.parquet(table.inputFiles()[0]).count()
