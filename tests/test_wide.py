from datetime import date
from decimal import Decimal

from pagelathe.operators import wide

HISTORY = "rev_id bigint, title string, timestamp string, structured_part array<struct<name string, text string, link string>>, loaded_at timestamp"
PARAMS = [("pop", "population", "int"), ("population", "population", "int"), ("area", "area", "decimal"), ("opened", "opened", "date"), ("live", "is_live", "bool"), ("genre", "genre", "string"), ("x", None, "int"), ("y", "why", "nokind"), (None, "area", "decimal")]


def tables(spark, rows, params=PARAMS):
    history = spark.createDataFrame([(i, t, ts, None if p is None else [(n, v, None) for n, v in p], None) for i, (t, ts, p) in enumerate(rows)], HISTORY).selectExpr("*", "1 as pos", "2 as cell", "'u' as parts")
    return history, spark.createDataFrame(params, "name string, column_name string, column_type string")


def test_typed_columns(spark):
    rows = [
        ("a_b", "2020-01-02T00:00:00Z", [("Population", "1,200 people"), ("pop", "unknown"), ("AREA", "3,50 km"), ("opened", "1 May 1900"), ("live", "Yes"), ("genre", " slow  march "), ("other", "5")]),
        ("A b", "2020-01-01T00:00:00Z", [("pop", "7")]),
        ("A b", "2020-01-03T00:00:00Z", None),
        ("c", "2020-01-01T00:00:00Z", []),
        ("c", "2019-01-01T00:00:00Z", [("pop", "1")]),
        (None, "2020-01-01T00:00:00Z", [("pop", "1")]),
    ]
    history, params = tables(spark, rows)
    got = {r.title: r for r in wide.wide_table(history, params).collect()}
    assert set(got) == {"A b", "C"}
    assert got["A b"].asDict() == {"title": "A b", "area": Decimal("3.5"), "genre": "slow march", "is_live": True, "opened": date(1900, 5, 1), "population": 1200}
    assert set(got["C"].asDict().values()) == {"C", None}
    cells = {(r.column_name, r.cell) for r in wide.found_cells(history, params).collect()}
    assert cells == {("area", "3.5"), ("genre", "slow march"), ("is_live", "true"), ("opened", "1900-05-01"), ("population", "1200")}


def test_last_stated_value_counts(spark):
    history, params = tables(spark, [("t", "2020-01-01T00:00:00Z", [("pop", "5"), ("population", "6"), ("pop", "2–3"), ("population", None), (None, "9")])])
    assert [(r.column_name, r.cell) for r in wide.found_cells(history, params).collect()] == [("population", "6")]


def test_empty_tables(spark):
    history, params = tables(spark, [])
    assert wide.wide_table(history, params).count() == 0 and wide.found_cells(history, params).count() == 0
    history, params = tables(spark, [("t", "2020-01-01T00:00:00Z", [("pop", "5")])], [])
    assert wide.wide_table(history, params).columns == ["title"] and wide.found_cells(history, params).count() == 0


def test_decimals_keep_their_digits(spark):
    numbers = ["3.14159265358979", "0.00000000001234", "123456789012345678901.5", "1." + "1" * 30]
    history, params = tables(spark, [(f"t{i}", "2020-01-01T00:00:00Z", [("area", n + " km")]) for i, n in enumerate(numbers)])
    assert [r.cell for r in wide.found_cells(history, params).orderBy("title").collect()] == numbers
    typed = [r.area for r in wide.wide_table(history, params).orderBy("title").collect()]
    assert typed[:3] == [Decimal(n) for n in numbers[:3]] and typed[3] == Decimal("1.1111111111111111")
