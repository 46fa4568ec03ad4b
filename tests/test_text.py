from pyspark.sql import functions as F

from pagelathe.functions import text, values


def column(spark, rows, *exprs):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*[e(F.col("x")).alias(f"c{i}") for i, e in enumerate(exprs)]).collect()]


def test_titles_and_names(spark):
    rows = ["  foo__bar  (x)_", "éa", "", " _ ", None, "A"]
    assert [r[0] for r in column(spark, rows, text.page_title)] == ["Foo bar (x)", "Éa", None, None, None, "A"]
    names = [" Height - Above_sea ", "a\tb", None, "X"]
    assert [r[0] for r in column(spark, names, text.param_name)] == ["height_above_sea", "a_b", None, "x"]


def test_very_long_runs(spark):
    rows = ["a" + " " * 200_000 + "b", "_" * 200_000, "x" * 300_000]
    assert [r[0] for r in column(spark, rows, text.page_title)] == ["A b", None, "X" + "x" * 299_999]
    assert [r[0] for r in column(spark, rows, text.param_name)] == ["a_b", "_", "x" * 300_000]
    assert [r[0] for r in column(spark, rows, lambda c: values.int_cell(text.squeeze(c)))] == [None] * 3


def test_instants(spark):
    rows = ["2020-01-01T00:00:00Z", "2020-01-01 02:00:00+02:00", "2019-12-31T19:00:00-05:00", "2020-01-01T00:00:00", "nonsense", None, ""]
    got = column(spark, rows, text.instant, lambda c: text.utc_text(text.instant(c)))
    assert [r[1] for r in got] == ["2020-01-01T00:00:00Z"] * 4 + [None] * 3
    assert len({r[0] for r in got[:4]}) == 1


def test_utc_text_follows_no_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = column(spark, ["2020-07-01T12:00:00Z", "1969-12-31T23:59:59Z"], lambda c: text.utc_text(text.instant(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r[0] for r in got] == ["2020-07-01T12:00:00Z", "1969-12-31T23:59:59Z"]


def test_slug(spark):
    assert [r[0] for r in column(spark, ["C++", "AC/DC (band)", "...", "Söhne_x"], text.slug)] == ["c", "ac_dc_band", "", "söhne_x"]


def test_numbers(spark):
    cases = {
        "1,669": ("1669", "1669"), "9 237": ("9237", "9237"), "4 255 people[2]": ("4255", "4255"), "−162 m": ("-162", "-162"), "0.2 million inhabitants": ("200000", "200000"),
        "1 thousand": ("1000", "1000"), "133,6": (None, "133.6"), "3,642.56 km": (None, "3642.56"), "5.0 t": ("5", "5"), "10 (est. of the council)": ("10", "10"), "12 m a.s.l. (2014 census)": ("12", "12"),
        "23-49": (None, None), "5–13": (None, None), "98 to 199": (None, None), "5 or 6": (None, None), "?": (None, None), "n/a": (None, None), "": (None, None), "about": (None, None), "-0": ("0", "0"), "5 million": ("5000000", "5000000"),
        "3.14159265358979": (None, "3.14159265358979"), "0.00000000001234 kg": (None, "0.00000000001234"), "123456789012345678901.5": (None, "123456789012345678901.5"), "−0.000 (2001)": ("0", "0"), "007": ("7", "7"), "0.50 million": ("500000", "500000"),
        "1.2345678901 million": (None, "1234567.8901"), "12345678901234567890 trillion": (None, "12345678901234567890000000000000"), "9223372036854775807": ("9223372036854775807",) * 2, "9223372036854775808": (None, "9223372036854775808"), "1,2345": (None, "1.2345"),
    }
    got = column(spark, list(cases), lambda c: values.int_cell(text.squeeze(c)), lambda c: values.decimal_cell(text.squeeze(c)))
    assert dict(zip(cases, got)) == cases


def test_dates_and_flags(spark):
    dates = {
        "1854-05-01": "1854-05-01", "1848/08/21": "1848-08-21", "23.12.1768": "1768-12-23", "6th of November 1674[2]": "1674-11-06", "17 Nov. 1811": "1811-11-17", "September 15, 1924": "1924-09-15", "7th  of  October  1944": "1944-10-07",
        "c. 1674": None, "late 1870s": None, "February 1900": None, "1890": None, "31 February 1900": None, "1 May 1900 – 3 June 1901": None, "—": None, "5 Foo 1900": None,
    }
    assert dict(zip(dates, [r[0] for r in column(spark, list(dates), lambda c: values.date_cell(text.squeeze(c)))])) == dates
    flags = {"Yes": "true", "NO": "false", "1": "true", "0": "false", "y [2]": "true", "no data": None, "10": None, "": None, "tbd": None}
    assert dict(zip(flags, [r[0] for r in column(spark, list(flags), lambda c: values.bool_cell(text.squeeze(c)))])) == flags
