"""One long series over many blocks against the same work unsplit."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Source, StudyConfig
from tidemark.operators import bars as B
from tidemark.operators import blocks as K
from tidemark.operators import features as X
from tidemark.operators import matrix as M
from tidemark.operators import rolling as R
from tidemark.operators import studies as S
from tidemark.operators import ticks as T

KEY = ["k"]


@pytest.fixture(scope="module")
def series():
    """A symbol with gaps, another that is short, and rows without a symbol."""
    rng = random.Random(4)
    t, rows = 0, []
    for _ in range(700):
        t += rng.choice((1, 1, 1, 2, 5, 40))
        rows.append(("a", t, rng.choice((None, rng.randrange(50, 90))), float(rng.randrange(100))))
    return rows + [("b", 3, None, 1.0), ("b", 9, 70, 2.0), (None, 4, 60, 3.0), (None, 1000, None, 4.0)]


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series, "k string, t long, v long, x double").repartition(3).cache()


def pandas_of(series):
    out = pd.DataFrame(series, columns=["k", "t", "v", "x"]).astype({"v": "Int64"})
    return out.assign(k=out["k"].fillna("-")).sort_values(["k", "t"]).reset_index(drop=True)


def collected(df, *columns):
    out = df.select(F.coalesce("k", F.lit("-")).alias("k"), "t", *columns).orderBy("k", "t").toPandas()
    return out


def same(left, right):
    a, b = (pd.Series(x).astype(object).where(pd.notna(pd.Series(x)), None).tolist() for x in (left, right))
    assert len(a) == len(b) and all(x == y or (x is not None and y is not None and abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True))


def test_carries_sums_and_numbers(frame, series):
    plain = pandas_of(series)
    out = collected(K.carried(frame, KEY, "t", ["t"], {"now": F.col("v")}, size=16), "now")
    same(out["now"], plain.groupby("k")["v"].ffill())
    out = collected(K.previous(frame, KEY, "t", ["t"], {"before": F.col("v")}, size=16), "before")
    same(out["before"], plain.groupby("k")["v"].shift(1))
    out = collected(K.running(frame, KEY, "t", ["t"], {"total": F.col("x")}, size=16), "total")
    same(out["total"], plain.groupby("k")["x"].cumsum())
    out = collected(K.numbered(frame, KEY, "t", size=16), "__n")
    same(out["__n"], plain.groupby("k").cumcount())


def test_frames_behind_and_ahead(frame, series):
    plain = pandas_of(series)
    out = collected(K.trailing(frame, KEY, "t", 7, lambda df, w: df.withColumn("m", R.full("x", F.avg, w, 7)), size=30), "m")
    same(out["m"], plain.groupby("k")["x"].rolling(7).mean().reset_index(drop=True))
    out = collected(K.ahead(frame, KEY, "t", 50, lambda df, w: df.withColumn("m", F.max("x").over(w.rangeBetween(1, 50))), size=64), "m")
    expected = [max((r.x for r in plain[(plain.k == q.k) & (plain.t > q.t) & (plain.t <= q.t + 50)].itertuples()), default=None) for q in plain.itertuples()]
    same(out["m"], expected)


def test_recurrences(frame, series):
    rows = frame.withColumn("y", F.when(F.col("v").isNotNull(), F.col("x"))).where("k is not null")
    out = collected(R.recurrences_of(rows, KEY, "t", {("x", "e"): (2 / 301, 5), ("y", "g"): (1.0, 1), ("y", "h"): (0.1, 3)}, size=40), "e", "g", "h")
    plain = pandas_of(series)
    plain = plain[plain.k != "-"]
    y = plain["x"].where(plain["v"].notna())
    for name, value, alpha, least in (("e", plain["x"], 2 / 301, 5), ("g", y, 1.0, 1), ("h", y, 0.1, 3)):
        same(out[name], [z for _, part in value.groupby(plain["k"], sort=True) for z in part.ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean()])


@pytest.mark.parametrize("equal", [False, True])
def test_greedy_starts(frame, series, equal):
    got = {(r.k, r.start) for r in S.greedy_starts(frame.where("k is not null"), KEY, "t", 23, keep_equal=equal, size=64).collect()}
    expected = set()
    for k in ("a", "b"):
        last = None
        for t in sorted(r[1] for r in series if r[0] == k):
            if last is None or t > last + 23 or equal and t == last + 23:
                expected.add((k, t))
                last = t
    assert got == expected


def test_greedy_starts_with_a_span_of_each_row(frame, series):
    rows = frame.where("k = 'a'").withColumn("span", (F.col("x") / 4).cast("long"))
    got = sorted(r.start for r in S.greedy_starts(rows, KEY, "t", "span", keep_equal=False, size=64).collect())
    expected, until = [], None
    for _, t, _, x in sorted((r for r in series if r[0] == "a"), key=lambda r: r[1]):
        if until is None or t > until:
            expected.append(t)
            until = t + int(x / 4)
    assert got == expected


def test_episodes_keep_extremes_and_end(spark):
    rows = [("a", 0, 5, -1, "x"), ("a", 10, 9, -3, "y"), ("a", 11, 2, -9, "z"), ("a", 40, 1, 1, "q")]
    out = S.collapsed(spark.createDataFrame(rows, "k string, t long, up long, down long, tag string").withColumn("span", F.lit(10).cast("long")), KEY, "t", "span", 0, ["up"], ["down"])
    assert sorted((r.start, r.end, r.n, r.up, r.down, r.tag) for r in out.collect()) == [(0, 10, 2, 9, -3, "x"), (11, 21, 1, 2, -9, "z"), (40, 50, 1, 1, 1, "q")]


def test_purge_looks_ahead_and_is_half_open(spark):
    events = spark.createDataFrame([("a", 100, 110)], "k string, start long, end long")
    rows = spark.createDataFrame([("a", t) for t in (64, 65, 100, 114, 115)], "k string, t long")
    kept = S.outside(rows, S.purge_spans(events, KEY, "start", "end", 5, 30), KEY, "t")
    assert sorted(r.t for r in kept.collect()) == [64, 115]


def test_asof_quotes_and_steps(frame, series):
    plain = pandas_of(series)
    right = frame.where("v is not null").select("k", F.col("t").alias("u"), F.col("v").alias("w"))
    out = collected(B.asof(frame, right, KEY, "t", "u", ["w"], size=32), "w")
    same(out["w"], plain.groupby("k")["v"].ffill())
    quotes = frame.withColumns({"bid": F.when(F.col("x") > 50, F.col("v")), "ask": F.when(F.col("x") <= 50, F.col("v"))})
    out = collected(T.quote_book(quotes, KEY, ["t"], "t", "bid", "ask", size=32), "bid_now", "ask_t")
    same(out["bid_now"], plain["v"].where(plain["x"] > 50).groupby(plain["k"]).ffill())
    top = [r.step for r in T.step_topk(frame, KEY, "t", ["t"], "x", 9, size=32).collect()]
    assert top == sorted(plain.groupby("k")["x"].diff().abs().dropna(), reverse=True)[:9]


def test_matrix_in_blocks(spark):
    rng = np.random.default_rng(8)
    close = 10_000 + rng.integers(-30, 31, 3000).cumsum()
    rows = [("a", i * 300, i * 300 + 300, int(c) + 2, int(c) + 9, int(c) - 8, int(c), 12.0, 1.0) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "k string, t long, c_t long, open long, high long, low long, close long, spread double, coverage double")
    cfg = StudyConfig(sources=(Source("", "5m"),), timeframes=("5m",), ema_periods=(1, 3, 4), sma_periods=(1, 3, 9), consolidation_windows=(4, 6), crossover_windows=(5,), compression_percentile_lookback=10, atr_period=2, indicator_source_mode="previous_closed", wide_per_indicator_features=("dist_pips", "slope_raw", "slope_sign"))
    names = [f.name.split("__", 1)[1] for f in M.described(cfg)[0]["5m"].features]
    whole, split = (M.single(bars, cfg, KEY, names, size).orderBy("c_t").toPandas() for size in (1 << 16, 1))
    pd.testing.assert_frame_equal(whole, split, rtol=1e-12, atol=1e-9)
    assert M.depth(cfg) * 16 < len(rows) and whole["ema_3_price_dist_pips"].notna().sum() == 2997  # three bars of warm-up behind one of shift
    assert whole["consecutive_compressed_bars_4"].max() > 1 and whole["ema_sma_bars_since_cross"].max() > 1


def test_pairs_cross_between_blocks(spark):
    rows = spark.createDataFrame([("a", i, i, [float(x), 5.0]) for i, x in enumerate((4, 6, 6, 5, 4, 7))], "k string, n long, c_t long, x array<double>")
    out = X.crossed_pairs(rows, KEY, "n", (2, 5), (), ("ema",))
    assert sorted((r.c_t, r.fast, r.slow, r.direction) for r in out.collect()) == [(1, 2, 5, 1), (4, 2, 5, -1), (5, 2, 5, 1)]


def test_rows_since_a_flag_and_runs(frame, series):
    plain = pandas_of(series)
    flags = plain["x"].where(plain["v"].notna()).map(lambda x: None if pd.isna(x) else x > 40)
    since, run, before = [], [], None
    for k, f in zip(plain["k"], flags, strict=True):
        if k != before:
            n, length, before = None, 0, k
        n = 0 if f else (None if n is None else n + 1)
        length = length + 1 if f else 0
        since.append(n)
        run.append(None if f is None else length)
    out = collected(R.since_and_run(frame.withColumn("f", F.when(F.col("v").isNotNull(), F.col("x") > 40)), "f", KEY, size=16), "since", "run")
    same(out["since"], since)
    same(out["run"], run)


def test_places_in_a_cell_are_those_of_the_whole_cell(spark):
    rows = spark.createDataFrame([("hot" if t % 3 else "b", t) for t in range(5000)] + [("one", 1), (None, 2)], "k string, t long")
    out = S.placed(rows, KEY, "t", 3).withColumn("h", S.seeded(3, "t")).toPandas()
    assert len(out) == 5002
    for _, cell in out.groupby("k", dropna=False):
        assert cell.sort_values(["h", "t"])["__r"].tolist() == list(range(1, len(cell) + 1)) and set(cell["__size"]) == {len(cell)}


def test_controls_wrap_round_a_small_pool(spark):
    events = spark.createDataFrame([("a", t) for t in (10, 20, 30)] + [("b", 1)], "k string, e long")
    pool = spark.createDataFrame([("a", t) for t in (1, 2, 3, 4)], "k string, t long")
    found = S.matched_controls(events, pool, KEY, "e", "t", 3, 7).toPandas()
    assert found.groupby("e").size().to_dict() == {10: 3, 20: 3, 30: 3} and found.groupby("e")["t"].nunique().eq(3).all()
    order = S.placed(pool, KEY, "t", 7).orderBy("__r").toPandas()["t"].tolist()
    assert found.sort_values(["e", "slot"])["t"].tolist() == (order * 3)[:9]
