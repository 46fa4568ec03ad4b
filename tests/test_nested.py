import json

import pytest

from pyspark.sql import functions as F

from pagelathe.operators import nested
from pagelathe.plans import wiki_queries


def bodies(spark, rows):
    return spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "raw_id bigint, body string").selectExpr("*", "'x' as tag", "'y' as pk", "0 as page_id")


REV = {"id": "7", "parentid": 6, "timestamp": "2020-01-01T00:00:00Z", "contributor": {"username": " Ann\n", "id": 3}, "format": "text/x-wiki", "text": {"#text": "hello", "@bytes": 5}}


def found(spark, rows):
    return sorted(tuple(r) for r in nested.flatten_pages(bodies(spark, rows)).found().collect())


def test_shapes_of_the_same_page_count_once(spark):
    page = {"title": "T", "ns": 0, "id": 1, "revision": [REV]}
    again = {"mediawiki": {"page": [{"title": "T", "id": "1", "revision": dict(REV, id=7, text=["hello"], contributor={"username": {"#text": "Ann"}})}]}}
    assert found(spark, [json.dumps(page), json.dumps({"page": page}), json.dumps(again), " " + json.dumps([page])]) == [(1, 7, "Ann", "main")]


def test_slots_contributors_and_blanks(spark):
    def page(i, **rev):
        return json.dumps({"id": i, "title": "x", "revision": {"id": i * 10, **rev}})

    rows = [
        page(1, text="a", slots=[{"role": "main", "text": "a"}, {"role": "notes", "text": {"#text": "n"}}, {"role": "talkbox", "text": " "}], contributor={"username": " ", "ip": " 1.2.3.4 "}),
        page(2, text={"@deleted": "deleted"}, slots={"slot": {"role": "main", "text": "m"}}, contributor={"@deleted": "deleted"}),
        page(3, text=None, contributor=None),
        page(4, text=[{"#text": "b"}], slots={"slot": [None, {"role": "q", "text": "z"}]}, contributor=[]),
    ]
    assert found(spark, rows) == [(1, 10, "1.2.3.4", "main"), (1, 10, "1.2.3.4", "notes"), (2, 20, "", "main"), (4, 40, "", "main"), (4, 40, "", "q")]


def test_damaged_empty_and_odd_bodies(spark):
    ok = json.dumps({"id": 1, "title": "x", "revision": {"id": 2, "text": "\ud800 odd \U0001f600"}})
    rows = [None, "", "null", "[]", "{}", "5", '"x"', ok[:-1], ok + "}", '{"id": 1, "revision": null, "title": "x"}', "[" * 100_000, "﻿" + ok]
    assert found(spark, rows) == [(1, 2, "", "main")]
    assert found(spark, []) == []


def test_flat_tables_keep_their_links(spark):
    long = "w " * 300_000
    page = {"id": 1, "title": "x", "ns": 0, "revision": [dict(REV, id=7), dict(REV, id=8, text=long), dict(REV, id=9, text="")]}
    flat = nested.flatten_pages(bodies(spark, [json.dumps(page)] * 2))
    pages, revisions, people, texts = (t.collect() for t in (flat.pages(), flat.revisions(), flat.contributors(), flat.texts()))
    assert [(p.pk, p.page_id, p.title, p.ns) for p in pages] == [("p1", 1, "x", 0)]
    assert {r.parent for r in revisions} == {"p1"} and {r.rev_id for r in revisions} == {7, 8, 9}
    assert {c.parent for c in people} == {r.pk for r in revisions} and {c.contributor for c in people} == {"Ann"}
    assert {(t.parent, len(t.text)) for t in texts} == {("p1/r7", 5), ("p1/r8", len(long))}


def test_format_truncate_reads_every_page(spark, tmp_path):
    def rev(i, form="text/x-wiki", **more):
        return {"id": i, "timestamp": f"v{i}", "format": form, "contributor": {"username": f" u{i} "}, "text": {"#text": "t"}, **more}

    rows = [
        {"title": "flat", "revision": [rev(1), rev(2, "application/json"), rev(3)]},
        {"title": "single", "revision": rev(4)},
        {"page": {"title": "wrapped", "revision": [rev(5, contributor="Ann"), rev(6, {"#text": " text/x-wiki\n"})]}},
        {"mediawiki": {"siteinfo": {"base": None}, "page": [{"title": {"#text": "first"}, "revision": [rev(7)]}, {"title": "second", "revision": rev(8, contributor=[{"username": {"#text": "Bo"}}])}]}},
        [{"title": "listed", "revision": [rev(9, contributor={"ip": "1.2.3.4"}), rev(10, None), rev(11)]}, {"title": "bare"}],
        {"ns": 0, "revision": [rev(12)]},
    ]
    bodies(spark, [*map(json.dumps, rows), "", None, json.dumps(rows[0])[:-1]]).write.parquet(str(tmp_path / "raw_pages.parquet"))
    got = sorted(tuple(r) for r in wiki_queries.QUERIES["format_truncate"](spark, str(tmp_path)).select(F.coalesce("page", F.lit("")), "ver", "contributor", "rev_ord").collect())
    assert got == [
        ("", "v12", "u12", 0), ("first", "v7", "u7", 0), ("flat", "v1", "u1", 0), ("listed", "v9", None, 0), ("second", "v8", "Bo", 0),
        ("single", "v4", "u4", 0), ("wrapped", "v5", "Ann", 0), ("wrapped", "v6", "u6", 1),
    ]


def test_pages_and_revisions_without_id_are_kept_apart(spark):
    def rev(n, **more):
        return {"timestamp": f"2020-01-0{n}T00:00:00Z", "contributor": {"username": f"u{n}"}, "text": f"t{n}", **more}

    rows = [
        {"id": 1, "title": "A", "revision": [rev(1), rev(2), rev(2, text="other")]},
        {"page": {"id": "1", "title": {"#text": "A"}, "revision": [rev(1, text=["t1"]), rev(2)]}},
        {"title": "B", "revision": [rev(1), rev(3, id=7)]},
        {"title": "B", "revision": rev(3, id="7")},
        {"title": "C", "revision": rev(1)},
        {"ns": 0, "revision": rev(4)},
        {"ns": 0, "revision": rev(5)},
    ]
    flat = nested.flatten_pages(bodies(spark, list(map(json.dumps, rows))))
    assert sorted(p.title or "" for p in flat.pages().collect()) == ["", "", "A", "B", "C"]
    people = {c.pk.removesuffix("/c"): c.contributor for c in flat.contributors().collect()}
    assert sorted(people.values()) == ["u1", "u1", "u1", "u2", "u2", "u3", "u4", "u5"]
    assert {r.pk for r in flat.revisions().collect()} == set(people) == {t.parent for t in flat.texts().collect()}
    assert sorted((str(r.page_id), str(r.rev_id), r.contributor) for r in flat.found().collect()) == sorted([("1", "None", u) for u in ("u1", "u2", "u2")] + [("None", "None", u) for u in ("u1", "u1", "u4", "u5")] + [("None", "7", "u3")])


def test_bodies_nested_to_any_depth(spark):
    from pagelathe.functions import jsontext

    depth = 50_000
    body = '{"title": "A", "id": 1, "x": ' + "[" * depth + "]" * depth + ', "revision": [{"id": 2, "text": "t", "timestamp": "2020"}]}'
    rows = [tuple(r) for r in nested.flatten_pages(spark.createDataFrame([(body,), (body[:-1],)], "body string")).found().collect()]
    assert rows == [(1, 2, "", "main")]
    for text in ('{"a": [1, -2.5e3, true, null, "x\\u00e9", {}, []], "b": {"c": ""}}', " [1 , 2] ", '"s"', "12"):
        assert jsontext.deep(text.strip()) == json.loads(text)
    for text in ("[1,]", '{"a" 1}', "[1", "[1]]", "", "NaN", '{"a": }', "[1 2]", '{1: 2}', "]"):
        with pytest.raises(ValueError):
            jsontext.deep(text)
    assert jsontext.loads('{"id": ' + "9" * 5000 + "}")["id"] == "9" * 5000


def test_wrapped_revisions_several_people_and_damaged_bodies(spark):
    rev = lambda n, **k: {"id": n, "text": f"t{n}", **k}
    bodies = [
        json.dumps({"title": "A", "id": 1, "revision": {"revision": [rev(1), {"revision": rev(2)}]}}),
        json.dumps({"title": "B", "id": 2, "revision": [rev(3, contributor=[{"username": "x"}, {"username": "y"}, "z"])]}),
        '{"title": "C", "id": 3, "revision": {"id": 4, "text": NaN}}', "{broken", "{broken", " ", None,
    ]
    flat = nested.flatten_pages(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert {tuple(r) for r in flat.found().collect()} == {(1, 1, "", "main"), (1, 2, "", "main"), (2, 3, "x", "main")}
    assert {(r.pk, r.contributor) for r in flat.contributors().where("page_id = 2").collect()} == {("p2/r3/c", "x"), ("p2/r3/c1", "y"), ("p2/r3/c2", "z")}
    assert {tuple(r) for r in flat.refused().collect()} == {("{broken", 2), (bodies[2], 1)}
