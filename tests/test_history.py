import random
from datetime import datetime, timedelta

from pagelathe.operators import history

SCHEMA = "rev_id bigint, title string, timestamp string, contributor string, structured_part array<struct<name string, text string, link string>>, loaded_at timestamp"


def stamp(minutes):
    return (datetime(2020, 1, 1) + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")


def brute(rows):
    """Periods from first principles: every title, instant and name by itself."""
    best = {}
    for rev, title, ts, _, parts, loaded in rows:
        if title is None or not title.replace("_", " ").strip() or ts is None or parts is None:
            continue
        t = " ".join(title.replace("_", " ").split())
        key = (t[0].upper() + t[1:], ts)
        rank = (loaded is not None, loaded or datetime.min, rev is not None, rev or 0)
        if key not in best or rank >= best[key][0]:
            best[key] = (rank, parts)
    out = set()
    for title in {k[0] for k in best}:
        times = sorted(ts for t, ts in best if t == title)
        states = []
        for ts in times:
            state = {}
            for name, text, _ in best[title, ts][1]:
                n = "_".join((name or "").lower().replace("_", " ").replace("-", " ").split())
                if n:
                    state[n] = " ".join((text or "").split())
            states.append({n: v for n, v in state.items() if v})
        for i, state in enumerate(states):
            for n, v in state.items():
                if i and states[i - 1].get(n) == v:
                    continue
                end = next((times[j] for j in range(i + 1, len(times)) if states[j].get(n) != v), "")
                out.add((title, n, times[i], end))
    return out


def sample(rng, n, titles):
    rows = []
    for i in range(n):
        parts = None
        if rng.random() > 0.05:
            parts = [(rng.choice(["a", "B", " b ", "c-d", "C_d", None, ""]), rng.choice(["x", " x ", "y", "y  z", "", None]), None) for _ in range(rng.randint(0, 5))]
        ts = None if rng.random() < 0.03 else stamp(rng.randint(0, 40))
        rows.append((i, rng.choice(titles), ts, None, parts, datetime(2021, 1, 1) + timedelta(minutes=rng.randint(0, 5))))
    return rows


def test_periods_match_brute_force(spark):
    rows = sample(random.Random(1), 600, ["t_one", "T one ", "two", "Three", None, " "])
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    got = history.found_periods(df)
    assert [c for c, _ in got.dtypes] == ["title", "name", "valid_from", "valid_to"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_hot_titles_are_cut_without_a_trace(spark):
    rows = sample(random.Random(2), 500, ["Hot"] * 9 + ["Cold"])
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in history.attribute_periods(df).collect()}
    cut = [tuple(r) for r in history.attribute_periods(df, hot_rows=50).collect()]
    assert len(cut) == len(set(cut)) and set(cut) == whole


def test_empty_and_clashing_columns(spark):
    assert history.found_periods(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a", stamp(0), None, [("n", "x" * 300_000, None)], None)], SCHEMA).selectExpr("*", "1 as slot", "2 as tree", "'q' as name", "3 as at", "4 as before")
    assert [r.text for r in history.attribute_periods(df).collect()] == ["x" * 300_000]


def test_one_instant_with_most_rows(spark):
    rows = [(i, "Hot", stamp(5), None, [("a", f"v{i % 7}", None)], datetime(2021, 1, 1)) for i in range(300)] + sample(random.Random(3), 100, ["Hot", "Cold"])
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in history.attribute_periods(df, hot_rows=40).collect()} == {tuple(r) for r in history.attribute_periods(df).collect()}


def test_appends_give_what_a_rebuild_gives(spark, tmp_path):
    rng = random.Random(4)
    rows = sample(rng, 300, ["A", "B", "c", "D"])
    early = [r for r in rows if r[2] and r[2] < stamp(20)]
    batches = [early[:80], [r for r in rows if r[2] and stamp(20) <= r[2] < stamp(30) and r[1] != "D"], [], [r for r in rows if r[2] and r[2] >= stamp(30)], early[60:], rows]
    kept = history.History(spark, str(tmp_path / "history"))
    assert kept.periods().count() == 0
    seen = []
    for batch in batches:
        kept.append(spark.createDataFrame(batch, SCHEMA))
        seen += batch
        got = [tuple(r) for r in kept.periods().collect()]
        assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in history.attribute_periods(spark.createDataFrame(seen, SCHEMA)).collect()}
    second = spark.read.parquet(str(tmp_path / "history/1/events"))
    assert second.count() and {r.title for r in second.select("title").distinct().collect()} <= {"A", "B", "C"}
