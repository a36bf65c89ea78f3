"""Boundary rules on hand-made rows, and some queries against their SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import bars as B
from tidemark.operators import rolling as R
from tidemark.operators import studies as S
from tidemark.operators import validation as V

SF = "/root/testdata/sf0.001"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_resample_is_left_closed_and_right_closed(spark):
    ticks = spark.createDataFrame([("a", t, t, p) for t, p in ((0, 5), (59, 9), (60, 1), (61, 3))], "k string, t long, i long, p long")
    assert values(B.resample(ticks, ["k"], "t", ["t", "i"], "p", 60), "t", "open", "high", "low", "close", "n") == [(0, 5, 9, 5, 9, 2), (60, 1, 3, 1, 3, 2)]
    assert values(B.resample(ticks, ["k"], "t", ["t", "i"], "p", 60, right=True), "t", "n") == [(0, 1), (60, 2), (120, 1)]


def test_asof_takes_equal_times_and_never_later_ones(spark):
    left = spark.createDataFrame([("a", 4), ("a", 5), ("a", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 50), ("a", 8, 80), ("a", 10, 100)], "k string, u long, x long")
    assert values(B.asof(left, right, ["k"], "t", "u", ["x"]).na.fill(-1), "t", "u", "x") == [(4, -1, -1), (5, 5, 50), (9, 8, 80)]


def test_as_of_does_not_see_the_future(spark):
    left = spark.createDataFrame([("a", t) for t in range(0, 20, 2)], "k string, t long")
    right = spark.createDataFrame([("a", t, t * 10) for t in range(1, 20, 3)], "k string, u long, x long")
    changed = right.withColumn("x", F.when(F.col("u") > 10, F.lit(-7)).otherwise(F.col("x")))
    one, two = (values(B.asof(left, r, ["k"], "t", "u", ["x"]).na.fill(-1), "t", "x") for r in (right, changed))
    assert [x for x in one if x[0] <= 10] == [x for x in two if x[0] <= 10] and one != two


def test_recurrence_is_seeded_with_the_first_value(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate((2.0, 4.0, 8.0))], "k string, t int, x double")
    assert values(R.recurrences(rows, ["k"], "t", "x", {"e": (0.5, 2)}).na.fill(-1.0), "t", "e") == [(0, -1.0), (1, 3.0), (2, 5.5)]


def test_ties_of_extremes_take_the_latest_and_touches_the_earliest(spark):
    bars = spark.createDataFrame([("a", t, 10, 10 + u, 10 - u, 10) for t, u in ((0, 0), (60, 3), (120, 3), (180, 1))], "k string, t long, open int, high int, low int, close int")
    assert values(R.forward_extremes(bars, ["k"], "t", 180), "t", "f_n", "f_high_t")[0] == (0, 3, 120)
    assert values(R.first_touch(bars, ["k"], "t", 180, 3), "t", "t_up", "t_down", "first")[0] == (0, 60, 60, 2)


@pytest.mark.parametrize(("equal", "starts"), [(False, [0, 11]), (True, [0, 10])])
def test_greedy_episodes_and_thinning_differ_at_the_boundary(spark, equal, starts):
    rows = spark.createDataFrame([("a", t) for t in (0, 4, 10, 11)], "k string, t long")
    assert [r.start for r in S.greedy_starts(rows, ["k"], "t", 10, keep_equal=equal).orderBy("start").collect()] == starts


def test_islands_split_at_the_gap_and_purges_are_half_open(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 9, 19)], "k string, t long")
    assert [r.island for r in S.islands(rows, ["k"], "t", 10).orderBy("t").collect()] == [0, 0, 1]
    spans = spark.createDataFrame([("a", 0, 9), ("a", 5, 7)], "k string, lo long, hi long")
    assert values(S.outside(rows, spans, ["k"], "t"), "t") == [(9,), (19,)]


@pytest.mark.parametrize("name", ["ohlc_resample", "asof_backward", "ema", "forward_extremes", "greedy_episodes", "matched_controls", "purge_anti_join", "quote_forward_fill"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    rows = lambda df: sorted(tuple("" if pd.isna(x) else str(round(float(x), 4)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(ours) == rows(theirs)


def made_events(con, path, wide, until=48, symbols=("click", "view")):
    """Two ticks in every hour from a Monday on, far apart where `wide` (SQL on the hour h) holds."""
    con.execute(f"""copy (select row_number() over () as event_id, timestamp '2024-01-01 00:10:00' + to_hours(CAST(h AS INT)) + to_minutes(CAST(i AS INT)) as ts, 1 as user_id, s as event_type,
      CAST(10 + i * (case when {wide} then 100 else 1 end) AS DOUBLE) as value, '' as props from range({until}) r(h), range(2) q(i), unnest({list(symbols)}) u(s)) to '{path}/events.parquet'""")


def both_results(spark, path, name):
    """Rows of a query and of its SQL as text, in which NaN and null differ."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    ours, theirs = entry.queries()[name](spark, str(path)), con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    return sorted(str([r[c] for c in columns]) for r in ours.collect()), sorted(str(list(r)) for r in theirs.fetchall())


@pytest.mark.parametrize("wide", ["true", "false", "h % 3 = 0"])
def test_category_balance_with_one_kind_of_bars_only(spark, tmp_path, wide):
    made_events(duckdb.connect(), tmp_path, wide)
    ours, theirs = both_results(spark, tmp_path, "category_balance")
    assert len(ours) == 5 and ours == theirs


@pytest.mark.parametrize("wide", ["true", "false", "h % 3 = 0"])
def test_balance_report_with_one_kind_of_bars_only(spark, tmp_path, wide):
    made_events(duckdb.connect(), tmp_path, wide)
    ours, theirs = both_results(spark, tmp_path, "balance_report")
    assert len(ours) == 3 and ours == theirs


def test_balance_names_kinds_without_controls_and_meets_nothing_by_them(spark):
    events = spark.createDataFrame([("x", 1), ("y", 2)], "s string, v int")
    controls = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "kind string, s string, v int")
    columns = ("kind", "variable", "event_n", "control_n", "smd", "gap", "balanced")
    assert values(S.balance(events, controls, ["s", "v"], "kind", ["a", "b"]).na.fill(-1.0), *columns) == [("a", "s", 2, 2, -1.0, 0.0, True), ("a", "v", 2, 2, 0.0, 0.0, True), ("b", "s", 2, 0, -1.0, -1.0, False), ("b", "v", 2, 0, -1.0, -1.0, False)]
    assert {r.kind for r in S.balance(events, controls, ["s"], "kind").collect()} == {"a"} and {r.kind for r in S.balance(events, controls, ["s"], "kind", ["b"]).collect()} == {"b"}
    assert values(S.balance(events.where("false"), controls, ["s"], "kind").na.fill(-1.0), *columns) == [("a", "s", 0, 2, -1.0, -1.0, False)]


@pytest.mark.parametrize(("symbols", "until"), [(("click", "view"), 48), (("click", "view"), 1), (("click",), 48)])
def test_bar_audit_without_missing_slots_and_without_bars(spark, tmp_path, symbols, until):
    made_events(duckdb.connect(), tmp_path, "h % 3 = 0", until, symbols)
    ours, theirs = both_results(spark, tmp_path, "bar_audit")
    assert len(ours) == 30 and str(["worst_days", None]) in ours and ours == theirs


def test_audit_writes_large_medians_as_plain_numbers(spark):
    bars = spark.createDataFrame([("a", 3600 * i, 1, 1, 1, 1, n) for i, n in enumerate((20_000_000, 20_000_001))], "symbol string, t long, open int, high int, low int, close int, n long")
    assert dict(values(V.audit(bars, ["symbol"], "t", 3600).where("check = 'median_ticks'"), "check", "value")) == {"median_ticks": "20000000.5"}
