"""Configuration, dictionary and the command line, on a small export."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.__main__ import main
from tidemark.operators.dictionary import Feature, FeatureDictionary
from tidemark.plans import study

GIVEN = {
    "sources": [{"path": "bars.csv", "timeframe": "5m"}], "timeframes": ["5m", "15m", "1D"], "ema_periods": [2, 5, 9], "sma_periods": [2, 5, 9],
    "compression_percentile_lookback": 50, "consolidation_windows": [3, 6], "crossover_windows": [3, 6], "forward_horizons_minutes": [15, 60], "expansion_thresholds_pips": [2, 5],
    "step2": {"thresholds_pips": [2], "horizons_minutes": [15], "control_purge_minutes": 15}, "output_dir": "anywhere",
}


def bars(n=400):
    rng, price, lines = random.Random(5), 1.1, ["<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>"]
    for i in range(n):
        close = price + rng.gauss(0, 1e-4) + 1e-4 * math.sin(i / 20)
        high, low = max(price, close) + 5e-5, min(price, close) - 5e-5
        lines.append(f"2026.03.{2 + i // 288:02d}\t{i % 288 // 12:02d}:{i % 12 * 5:02d}:00\t{price:.5f}\t{high:.5f}\t{low:.5f}\t{close:.5f}\t10\t0\t12")
        price = close
    return "\n".join(lines) + "\n"


def test_derived_settings():
    cfg = config.from_dict(GIVEN, "/data")
    assert cfg.active_timeframes == ["5m", "15m"] and cfg.timeframe_pairs == [("5m", "15m")] and cfg.shift == 0
    assert cfg.base_source.path == "/data/bars.csv" and cfg.points_per_pip == 10
    twenty = [1, *range(17, 300, 16)][:19] + [300]
    cfg = config.from_dict({"sources": GIVEN["sources"], "ema_periods": twenty, "sma_periods": twenty})
    assert cfg.warmup_bars == 329 and len(study.dictionary(cfg).names) == 2259
    assert sum(len(study.outcome_names(h, cfg.expansion_thresholds_pips)) for h in cfg.forward_horizons_minutes) == 150


@pytest.mark.parametrize(
    "change",
    [{"pip_size": 0}, {"base_timeframe": "1h"}, {"timeframes": ["5m", "7m"]}, {"ema_periods": [], "sma_periods": []}, {"indicator_shift": 0}, {"price_basis": "renko"}, {"outcome_price_basis": "heikin_ashi"}, {"step2": {"purge": 3}}, {"wide_per_indicator_features": ["x"]}, {"ema_periods": [5, 2]}, {"ema_periods": [0, 2]}, {"indicator_source_shift_bars": 1}, {"primary_slope_lookback": 4},
     {"compression_percentile_threshold": 1.0}, {"crossover_windows": []}, {"cross_tf_mode": "none"}, {"cross_tf_mode": "selected_pairs"}, {"forward_horizons_minutes": [7]}, {"sources": []},
     {"sources": [{"path": "a", "timeframe": "1m"}]}, {"step2": {"directions": ["left"]}}],
)
def test_settings_that_cannot_be_run_are_refused(change):
    with pytest.raises(config.ConfigError):
        config.from_dict(GIVEN | change)


def test_dictionary_refuses_repeats_and_outcomes():
    made = FeatureDictionary([Feature("a", "5m", "f", "u", "d")])
    for name in ("a", "expansion_up_2p_15m"):
        with pytest.raises(ValueError):
            made.register(Feature(name, "5m", "f", "u", "d"))


def check_panel(panel, base, cfg):
    """The base timeframe's simple averages, slopes and places, against pandas."""
    averages = [("ema", p) for p in cfg.ema_periods] + [("sma", p) for p in cfg.sma_periods]
    got = panel.where(F.col("timeframe") == cfg.base_timeframe).toPandas().sort_values("c_t")
    bars_ = base.orderBy("c_t").toPandas().reset_index(drop=True)
    close = bars_[["open", "high", "low", "close"]].astype(float).mean(axis=1)  # averages are of smoothed bars unless a study says otherwise
    assert len(got) == len(close) * len(averages) and set(panel.select("timeframe").distinct().toPandas()["timeframe"]) == set(cfg.active_timeframes)
    stack = pd.DataFrame({p: close.rolling(p).mean() for p in cfg.sma_periods})
    back = cfg.slope_lookbacks[0]
    ranks = stack.fillna(-np.inf).rank(axis=1, method="first").where(stack.notna()) - 1
    for p in cfg.sma_periods:
        one = got[(got.kind == "sma") & (got.period == p)].reset_index(drop=True)
        np.testing.assert_allclose(one["value"].astype(float), stack[p], equal_nan=True)
        np.testing.assert_allclose(one[f"slope_pips_{back}"].astype(float), stack[p].diff(back) / back / cfg.points_per_pip, equal_nan=True, atol=1e-9)
        np.testing.assert_allclose(one["rank_in_stack"].astype(float), ranks[p], equal_nan=True)
        np.testing.assert_allclose(one["price_distance"].astype(float), one["price"].astype(float) - stack[p], equal_nan=True, atol=1e-6)


def test_command_line_end_to_end(spark, tmp_path, capsys):
    import yaml

    (tmp_path / "bars.csv").write_text(bars())
    (tmp_path / "study.yaml").write_text(yaml.safe_dump(GIVEN))
    out, given = str(tmp_path / "out"), ["--config", str(tmp_path / "study.yaml"), "--outdir", str(tmp_path / "out")]
    with pytest.raises(SystemExit, match="run `python -m tidemark features`"):
        main(["events", *given], spark)
    main(["features", *given, "--causality-rows", "200", "--panel"], spark)
    for step in ("events", "compare", "checkpoint"):
        main([step, *given], spark)
    cfg = config.load(given[1])
    assert spark.read.parquet(f"{out}/verdict").count() == 2 and spark.read.parquet(f"{out}/crossings_5m").count() > 0
    made, base = spark.read.parquet(f"{out}/features"), spark.read.parquet(f"{out}/bars")
    assert made.count() == base.count() == 400 and set(study.dictionary(cfg).names) == set(made.columns) - {"symbol", "c_t"}
    # a matrix built without the later bars holds the same rows
    early = study.feature_matrix(base.where(F.col("c_t") <= base.agg(F.max("c_t")).first()[0] - 100 * 300), cfg)
    assert early.count() == 300 and early.exceptAll(made).count() == 0
    check_panel(spark.read.parquet(f"{out}/panel"), base, cfg)
    rates = spark.read.parquet(f"{out}/outcome_rates")
    assert rates.where("event_implied and event_rate < 1").count() == rates.where("control_implied and control_rate > 0").count() == 0 and rates.where("event_implied").count() > 0
    assert spark.read.parquet(f"{out}/outcome_magnitudes").select("control_type").distinct().count() == 2
    outcomes = spark.read.parquet(f"{out}/outcomes")
    assert set(outcomes.columns) == {"symbol", "c_t", *(n for h in (15, 60) for n in study.outcome_names(h, (2, 5)))}
    events, controls = spark.read.parquet(f"{out}/events"), spark.read.parquet(f"{out}/controls")
    starts = {(r.direction, r.c_t) for r in events.collect()}
    assert starts and events.where("not hit").count() == 0 and {r.control_type for r in controls.collect()} == {"matched", "random"}
    ends = [(r.direction, r.start, r.end) for r in events.collect()]
    # neither a look ahead into an episode nor the time it is still felt
    assert all(not a - 15 * 60 - 15 * 60 <= r.control_t < b + 15 * 60 for r in controls.collect() for d, a, b in ends if d == r.direction)
    reasons = {r.reason: r.rows for r in spark.read.parquet(f"{out}/exclusions").where("direction = 'up'").collect()}
    assert sum(reasons.values()) == 400 and reasons["feature_row_invalid"] == sum(not r.feature_row_valid for r in spark.read.parquet(f"{out}/alignment").collect())
    assert spark.read.parquet(f"{out}/lookahead").where("violations > 0 or status <> 'ok'").count() == 0
    assert {r.direction: r.episodes for r in spark.read.parquet(f"{out}/comparisons").collect()}["up"] == sum(d == "up" for d, _ in starts)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["tables"]["features"]["rows"] == 400
    capsys.readouterr()
    main(["explore", "dict", "--text", "TREND", "--outdir", out], spark)
    assert "x_5m_15m__trend_agreement" in capsys.readouterr().out


def test_tick_audit(spark, tmp_path):
    rows = ["<DATE>\t<TIME>\t<BID>\t<ASK>\t<LAST>\t<VOLUME>\t<FLAGS>", *(f"2026.03.02\t10:00:0{i}.000\t1.1000{i}\t1.1001{i}\t\t\t6" for i in range(5)), "2026.03.02\t10:00:07.000", *(f"2026.03.02\t10:05:0{i}.000\t\t1.0999{i}\t\t\t4" for i in range(3)), "2026.03.02\t10:04:59.000\t1.10009\t\t\t\t2"]
    (tmp_path / "ticks.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "bars.csv").write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2026.03.02\t10:00:00\t1.10000\t1.10009\t1.10000\t1.10009\t6\t0\t1\n2026.03.02\t10:05:00\t1.10004\t1.10004\t1.10004\t1.10004\t3\t0\t1\n")
    out = str(tmp_path / "out")
    main(["ticks", str(tmp_path / "ticks.csv"), "--outdir", out, "--bars", str(tmp_path / "bars.csv"), "--sample-lines", "2"], spark)
    table = lambda name: spark.read.parquet(f"{out}/{name}")
    quality = table("field_quality").first()
    assert (quality.rows, quality.malformed) == (10, 1) and {r.spread: r["count"] for r in table("spreads").collect()}[10] == 5
    assert {r.clock: (r.covered, r.exact_pct) for r in table("rebuilt").collect()} == {"A_native": (2, 100.0), "B_one_hour": (0, None)}
    assert table("clock").first().verdict == "INCONCLUSIVE"
    found = {(r.kind, r.finding): r.value for r in table("readiness").collect()}
    assert found["blocker", "out_of_order"] == 1 and found["blocker", "crossed_quotes"] == 4 and found["recommendation", "REQUEST DIFFERENT DATA"] == 2
    lines = [(r.kind, r.line.split("\t")[1]) for r in table("samples").orderBy("kind", "row").collect()]
    assert lines == [("begin", "10:00:00.000"), ("begin", "10:00:01.000"), ("busiest_hour", "10:00:00.000"), ("busiest_hour", "10:00:01.000"), ("end", "10:05:02.000"), ("end", "10:04:59.000"), ("middle", "10:05:00.000"), ("middle", "10:05:01.000")]


def test_files_of_bare_returns_and_latin_letters(spark, tmp_path):
    from tidemark.sources import text as E

    path = tmp_path / "old.csv"
    path.write_bytes("<DATE>\t<TIME>\t<BID>\t<ASK>\r2026.03.02\t10:00:00\t1.1\t1.2\r2026.03.02\t10:00:01\tn\u00fcll\r".encode("latin-1"))
    form = E.sniff(E.prefix_of(spark, str(path)))
    assert (form.encoding, form.line_end) == ("latin-1", "\r")
    rows = E.read_ticks(spark, str(path), form, 0.1).orderBy("row").collect()
    assert [(r.bid, r.malformed) for r in rows] == [(11, None), (None, "2026.03.02\t10:00:01\tn\u00fcll")]
