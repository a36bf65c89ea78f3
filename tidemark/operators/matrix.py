"""The feature matrix: all features of one timeframe's bars, and all features between timeframes.

Twenty periods of two kinds of average have 380 pairs, too many for column expressions, so a timeframe's features are one vectorised
pass over blocks of bars with as many bars before them as the deepest window or the slowest average needs to be exact in double
precision. What reaches back without a bound (bars since a crossing, length of a compression) is carried from block to block. The
features between timeframes are a second pass over aligned rows, without a shuffle.

Every feature is defined once, where it is computed; the dictionary is read off a run over two bars. Prices are points; missing values
are NaN inside the passes and null outside."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import blocks as K
from tidemark.operators.dictionary import Feature
from tidemark.operators.rolling import exponential
from tidemark.sources import artefacts as A

#: An average's past beyond so many time constants is below double precision.
TIME_CONSTANTS = 40
#: Bars of a block, if four times what overlaps is not more.
ROWS = 1 << 14
#: How features travel between passes.
WIRE = {"float": "<f4", "double": "<f8"}
BARS = ("open", "high", "low", "close", "spread", "coverage")


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is zero or missing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / np.where((b == 0) | ~np.isfinite(b), np.nan, b)


def shifted(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]]) if n else x


def framed(x: np.ndarray, n: int) -> np.ndarray:
    """The trailing n values of each row, NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def averaged(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the last n values, from the n-th on; sums of points and their quarters are exact."""
    if len(x) < n:
        return np.full(len(x), np.nan)
    start = int(np.argmax(np.isfinite(x))) if np.isfinite(x).any() else len(x)
    total = np.concatenate([[0.0], np.cumsum(x[start:])])
    out = np.full(len(x), np.nan)
    if len(total) > n:
        out[start + n - 1 :] = (total[n:] - total[:-n]) / n
    return out


def smoothed(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Exponential average, seeded with the first value and shown from the least-th on. Missing values stand only in front."""
    there, out = np.flatnonzero(np.isfinite(x)), np.full(len(x), np.nan)
    if len(there) >= least:
        y = exponential(x[there], alpha, x[there[0]])
        out[there[least - 1 :]] = y[least - 1 :]
    return out


def ranked(x: np.ndarray, lookback: int, least: int) -> np.ndarray:
    """Average rank of each value among the last `lookback`, as a share of their number."""
    out, frames = np.full(len(x), np.nan), framed(x, lookback)
    for at in range(0, len(x), 2048):
        part, own = frames[at : at + 2048], x[at : at + 2048, None]
        count = np.isfinite(part).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            rank = ((part < own).sum(axis=1) + ((part == own).sum(axis=1) + 1) / 2) / count
        out[at : at + 2048] = np.where(np.isfinite(own[:, 0]) & (count >= least), rank, np.nan)
    return out


def heikin_ashi(bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    close = (bars["open"] + bars["high"] + bars["low"] + bars["close"]) / 4
    first = (bars["open"][:1] + bars["close"][:1]) / 2
    opened = exponential(np.concatenate([first, close[:-1]]), 0.5, first[0]) if len(close) else close
    return {"open": opened, "high": np.maximum(bars["high"], np.maximum(opened, close)), "low": np.minimum(bars["low"], np.minimum(opened, close)), "close": close}


@dataclass
class Columns:
    """Features in order, and those (by place) that count bars since a flag: the flags, and whether a missing value stays missing."""

    prefix: str
    timeframe: str
    features: list[Feature] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    flags: list[np.ndarray] = field(default_factory=list)
    since: list[tuple[int, bool]] = field(default_factory=list)

    def add(self, name: str, values: np.ndarray, family: str, unit: str, text: str) -> np.ndarray:
        self.features.append(Feature(f"{self.prefix}{name}", self.timeframe, family, unit, text))
        self.values.append(values)
        return values

    def add_since(self, name: str, flag: np.ndarray, missing: np.ndarray | None, family: str, text: str) -> None:
        """Bars since the flag; with `missing`, bars since the last one that broke a run, whose values stay missing where it is set."""
        self.since.append((len(self.features), missing is not None))
        self.flags.append(flag)
        self.add(name, np.where(missing, np.nan, 0.0) if missing is not None else np.zeros(len(flag)), family, "bars", text)

    def table(self) -> np.ndarray:
        return np.stack(self.values, axis=1) if self.values else np.zeros((0, 0))


def _pairs(m: np.ndarray) -> np.ndarray:
    a, b = np.triu_indices(m.shape[1], 1)
    return m[:, a] - m[:, b]


def _turns(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign of each gap, of the row before, and whether both are there."""
    there, side = np.isfinite(gap), np.sign(np.where(np.isfinite(gap), gap, 0))
    before = lambda x: np.concatenate([np.zeros((1, x.shape[1]), x.dtype), x[:-1]])
    return side, before(side), there & before(there)


def _stack(out: Columns, kind: str, m: np.ndarray, atr: np.ndarray, price: np.ndarray, cfg: StudyConfig) -> None:
    """Order, crossings and ribbon of one kind of average (a column per period)."""
    pip, size, lb = cfg.points_per_pip, cfg.point_size, cfg.dispersion_change_lookback
    if m.shape[1] > 1:
        gap = _pairs(m)
        there = np.isfinite(gap)
        number = np.where(there.any(axis=1), there.sum(axis=1), np.nan)
        with np.errstate(invalid="ignore"):
            up, down, near = ((t & there).sum(axis=1) / number for t in (gap > 0, gap < 0, np.abs(gap) < cfg.entanglement_atr_fraction * atr[:, None]))
        out.add(f"{kind}_bullish_pair_fraction", up, "ordering", "fraction", "pairs whose shorter period is above the longer")
        out.add(f"{kind}_bearish_pair_fraction", down, "ordering", "fraction", "pairs whose shorter period is below the longer")
        out.add(f"{kind}_ordering_score", up - down, "ordering", "score_-1_to_1", "rising order less falling order")
        side, past, valid = _turns(gap)
        ups, downs = ((valid & t).sum(axis=1).astype(float) for t in ((side > 0) & (past <= 0), (side < 0) & (past >= 0)))
        events = ups + downs
        out.add(f"{kind}_cross_events", events, "crossover", "count", "pairs that changed order on this bar")
        out.add(f"{kind}_cross_net_direction", ups - downs, "crossover", "count", "pairs that turned up less those that turned down")
        out.add(f"{kind}_new_cross_flag", (events > 0).astype(float), "crossover", "boolean", "whether any pair crossed on this bar")
        out.add_since(f"{kind}_bars_since_cross", events > 0, None, "crossover", "bars since the last crossing")
        for w in cfg.crossover_windows:
            count = out.add(f"{kind}_cross_count_{w}", framed(events, w).sum(axis=1), "crossover", "count", f"crossings of the last {w} bars")
            out.add(f"{kind}_cross_density_{w}", count / w, "crossover", "count_per_bar", f"crossings a bar over the last {w} bars")
        out.add(f"{kind}_entanglement_fraction", near, "crossover", "fraction", f"pairs nearer than {cfg.entanglement_atr_fraction} ATR")
    low, high, mean, spread = (f(m, axis=1) for f in (np.nanmin, np.nanmax, np.nanmean, np.nanstd))
    width = high - low
    out.add(f"{kind}_ribbon_min", low * size, "ribbon_structure", "price", "lowest average")
    out.add(f"{kind}_ribbon_max", high * size, "ribbon_structure", "price", "highest average")
    out.add(f"{kind}_ribbon_width_pips", width / pip, "ribbon_structure", "pips", "highest less lowest average")
    width_atr = out.add(f"{kind}_ribbon_width_atr", divided(width, atr), "ribbon_structure", "atr_multiples", "width per ATR")
    out.add(f"{kind}_ribbon_mean", mean * size, "ribbon_structure", "price", "mean of the averages")
    out.add(f"{kind}_ribbon_dispersion_pips", spread / pip, "ribbon_structure", "pips", "standard deviation of the averages")
    spread_atr = out.add(f"{kind}_ribbon_dispersion_atr", divided(spread, atr), "ribbon_structure", "atr_multiples", "dispersion per ATR")
    out.add(f"{kind}_dispersion_change_{lb}", spread_atr - shifted(spread_atr, lb), "ribbon_structure", "atr_multiples", f"change of the dispersion over {lb} bars")
    out.add(f"{kind}_expansion_rate_{lb}", (width_atr - shifted(width_atr, lb)) / lb, "ribbon_structure", "atr_multiples_per_bar", f"growth of the width a bar over {lb} bars")
    with np.errstate(invalid="ignore"):
        out.add(f"{kind}_fraction_below_price", (m < price[:, None]).sum(axis=1) / m.shape[1], "ordering", "fraction", "averages below the price")
    out.add(f"{kind}_price_position_in_ribbon", divided(price - low, width), "ribbon_structure", "fraction", "price in the ribbon: 0 at its lowest, 1 at its highest average")


def _consolidation(out: Columns, bars: dict[str, np.ndarray], atr: np.ndarray, cfg: StudyConfig) -> None:
    pip, close, look = cfg.points_per_pip, bars["close"], cfg.compression_percentile_lookback
    for w in cfg.consolidation_windows:
        high, low = framed(bars["high"], w).max(axis=1), framed(bars["low"], w).min(axis=1)
        width = high - low
        add = lambda name, values, unit, text: out.add(f"{name}_{w}", values, "consolidation", unit, f"{text}, last {w} bars")  # noqa: B023, E731
        add("range_pips", width / pip, "pips", "highest high less lowest low")
        width_atr = add("range_atr", divided(width, atr), "atr_multiples", "range per ATR")
        add("close_std_pips", framed(close, w).std(axis=1) / pip, "pips", "standard deviation of closes")
        add("position_in_range", divided(close - low, width), "fraction", "close in the range: 0 at its low, 1 at its high")
        add("dist_to_range_high_pips", (high - close) / pip, "pips", "distance up to the high")
        add("dist_to_range_low_pips", (close - low) / pip, "pips", "distance down to the low")
        add("dist_to_range_high_atr", divided(high - close, atr), "atr_multiples", "distance up to the high per ATR")
        add("dist_to_range_low_atr", divided(close - low, atr), "atr_multiples", "distance down to the low per ATR")
        before_high, before_low = shifted(high, 1), shifted(low, 1)
        for name, broke in (("up", np.where(np.isfinite(before_high), close > before_high, np.nan)), ("down", np.where(np.isfinite(before_low), close < before_low, np.nan))):
            add(f"breakout_{name}_count", framed(broke, w).sum(axis=1), "count", "closes beyond the range before them")
        place = add("compression_percentile", ranked(width_atr, look, max(2, look // 10)), "percentile_0_to_1", f"rank of the range per ATR in its last {look} bars")
        missing, low_share = ~np.isfinite(place), cfg.compression_percentile_threshold
        with np.errstate(invalid="ignore"):
            compressed, expanded = place <= low_share, place >= 1 - low_share
        add("is_compressed", np.where(missing, np.nan, compressed), "boolean", f"rank at most {low_share}")
        out.add_since(f"consecutive_compressed_bars_{w}", ~compressed, missing, "consolidation", f"compressed bars in a row, last {w} bars")
        add("is_expanded", np.where(missing, np.nan, expanded), "boolean", f"rank at least {1 - low_share}")
        add("range_atr_change", width_atr - shifted(width_atr, w), "atr_multiples", f"change of the range per ATR over {w} bars")


def of_bars(bars: dict[str, np.ndarray], cfg: StudyConfig, timeframe: str) -> tuple[Columns, np.ndarray]:
    """All features of one timeframe, and the numbers that features between timeframes need: a column for each average, one for each of
    their primary slopes per ATR, the ATR, the price."""
    out, pip, size = Columns(f"{timeframe}__", timeframe), cfg.points_per_pip, cfg.point_size
    ha = heikin_ashi(bars) if "heikin_ashi" in (cfg.price_basis, cfg.atr_price_basis) else bars
    price, of_atr = (ha if cfg.price_basis == "heikin_ashi" else bars)["close"], ha if cfg.atr_price_basis == "heikin_ashi" else bars
    before = shifted(of_atr["close"], 1)
    true_range = np.nanmax(np.stack([of_atr["high"] - of_atr["low"], np.abs(of_atr["high"] - before), np.abs(of_atr["low"] - before)]), axis=0)
    atr = smoothed(true_range, 1 / cfg.atr_period, cfg.atr_period)
    atr = np.where(atr > 0, atr, np.nan)
    source = shifted(price, cfg.shift)
    averages = {("ema", p): smoothed(source, 2 / (p + 1), p) for p in cfg.ema_periods} | {("sma", p): averaged(source, p) for p in cfg.sma_periods}
    wanted, slopes = set(cfg.wide_per_indicator_features), []
    for (kind, p), m in averages.items():
        key, gap = f"{kind}_{p}", price - m
        if "dist_pips" in wanted:
            out.add(f"{key}_price_dist_pips", gap / pip, "indicator_distance", "pips", f"price less {kind} {p}")
        if "dist_atr" in wanted:
            out.add(f"{key}_price_dist_atr", divided(gap, atr), "indicator_distance", "atr_multiples", f"price less {kind} {p}, per ATR")
        for lb in cfg.slope_lookbacks:
            slope = (m - shifted(m, lb)) / lb
            if lb == cfg.primary_slope_lookback:
                slopes.append(divided(slope, atr))
            kinds = {"slope_atr": (divided(slope, atr), "atr_multiples_per_bar"), "slope_pips": (slope / pip, "pips_per_bar"), "slope_raw": (slope * size, "price_per_bar"), "slope_sign": (np.sign(slope), "sign")}
            for name, (values, unit) in kinds.items():
                if name in wanted:
                    out.add(f"{key}_{name}_{lb}", values, "indicator_slope", unit, f"change of {kind} {p} a bar over {lb} bars")
    for kind, periods in (("ema", cfg.ema_periods), ("sma", cfg.sma_periods)):
        if periods:
            _stack(out, kind, np.stack([averages[kind, p] for p in periods], axis=1), atr, price, cfg)
    everything, lb = np.stack(list(averages.values()), axis=1), cfg.dispersion_change_lookback
    if everything.shape[1] > 1:
        width = np.nanmax(everything, axis=1) - np.nanmin(everything, axis=1)
        out.add("combined_ribbon_width_pips", width / pip, "ribbon_structure", "pips", "width of both kinds' ribbon")
        width_atr = out.add("combined_ribbon_width_atr", divided(width, atr), "ribbon_structure", "atr_multiples", "width of both kinds' ribbon per ATR")
        out.add("combined_ribbon_dispersion_atr", divided(np.nanstd(everything, axis=1), atr), "ribbon_structure", "atr_multiples", "dispersion of all averages per ATR")
        out.add(f"combined_expansion_rate_{lb}", (width_atr - shifted(width_atr, lb)) / lb, "ribbon_structure", "atr_multiples_per_bar", f"growth of both kinds' ribbon a bar over {lb} bars")
    shared = [p for p in cfg.ema_periods if p in cfg.sma_periods]
    if shared:
        gap = np.stack([averages["ema", p] - averages["sma", p] for p in shared], axis=1)
        side, past, valid = _turns(gap)
        events = (valid & (side * past < 0)).sum(axis=1).astype(float)
        there = np.isfinite(gap)
        out.add("ema_sma_cross_events", events, "crossover", "count", "ema and sma of one period that crossed on this bar")
        out.add_since("ema_sma_bars_since_cross", events > 0, None, "crossover", "bars since an ema and its sma crossed")
        out.add("ema_above_sma_fraction", (there & (side > 0)).sum(axis=1) / np.where(there.any(axis=1), there.sum(axis=1), np.nan), "ordering", "fraction", "periods whose ema is above its sma")
        for w in cfg.crossover_windows:
            out.add(f"ema_sma_cross_count_{w}", framed(events, w).sum(axis=1), "crossover", "count", f"crossings of ema and sma of the last {w} bars")
    out.add("atr_pips", atr / pip, "volatility", "pips", f"true range averaged over {cfg.atr_period} bars")
    out.add(f"atr_change_{cfg.atr_period}", divided(atr, shifted(atr, cfg.atr_period)) - 1, "volatility", "ratio", f"change of the ATR over {cfg.atr_period} bars")
    with np.errstate(divide="ignore", invalid="ignore"):
        returns = np.log(bars["close"] / shifted(bars["close"], 1))
    for w in cfg.consolidation_windows:
        vol = out.add(f"realized_vol_{w}", framed(returns, w).std(axis=1, ddof=1), "volatility", "log_return_sd", f"standard deviation of returns, last {w} bars")
        out.add(f"realized_vol_change_{w}", divided(vol, shifted(vol, w)) - 1, "volatility", "ratio", f"change of it over {w} bars")
    out.add("spread_pips_last", bars["spread"] / pip, "execution_context", "pips", "spread of the last base bar")
    out.add("base_bar_coverage", bars["coverage"], "execution_context", "fraction", "base bars there of those expected")
    _consolidation(out, bars, atr, cfg)
    return out, np.stack([*averages.values(), *slopes, atr, price], axis=1)


def depth(cfg: StudyConfig) -> int:
    """Bars before a block that make its features exact."""
    slowest = max((*((p + 1) / 2 for p in cfg.ema_periods), cfg.atr_period, 2))
    window = max((*cfg.sma_periods, 1)) + max(cfg.slope_lookbacks) + max(*cfg.consolidation_windows, *cfg.crossover_windows, cfg.dispersion_change_lookback, cfg.atr_period)
    return int(np.ceil(TIME_CONSTANTS * slowest)) + window + cfg.compression_percentile_lookback + 2 * max(cfg.consolidation_windows) + cfg.shift


def of_timeframe(bars: DataFrame, cfg: StudyConfig, timeframe: str, keys: list[str], size: int = ROWS, kind: str = "float") -> DataFrame:
    """keys, c_t, n, x (numbers for features between timeframes), v (the bytes of all features as `kind`, which move faster than lists),
    last (places of the last flags in the block, -1 before any) of bars (keys, t, c_t and BARS)."""
    out, _ = K.overlapped(K.numbered(bars, keys, "t"), keys, "__n", depth(cfg), 0, size)
    columns, kinds = [*keys, "c_t"], {f.name: f.dataType.simpleString() for f in bars.schema.fields}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__n")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # rows without any average
            made, x = of_bars({c: group[c].to_numpy(float) for c in BARS}, cfg, timeframe)
        n, own = group["__n"].to_numpy(), group[K.OWN].to_numpy()
        last = [np.maximum.accumulate(np.where(flag, n, -1)) for flag in made.flags]
        held = group.loc[own, columns].reset_index(drop=True)
        held["n"] = n[own]
        held["x"], held["v"] = list(x[own]), [row.tobytes() for row in made.table()[own].astype(WIRE[kind])]
        held["last"] = list(np.stack(last, axis=1)[own]) if last else [[]] * int(own.sum())
        return held

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n long, x array<double>, v binary, last array<long>"
    return out.groupBy(*keys, K.BLOCK).applyInPandas(run, schema)


def with_carries(made: DataFrame, keys: list[str], size: int = ROWS) -> DataFrame:
    """made (a table of of_timeframe) with the places of the last flags taken from earlier blocks where a block has none (-1: never)."""
    rows = made.withColumn(K.BLOCK, K.block_of(F.col("n"), size))
    ends = rows.groupBy(*keys, K.BLOCK).agg(F.max_by("last", "n").alias("__past"))
    past = Window.partitionBy(*keys).orderBy(K.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    most = F.aggregate(F.collect_list("__past").over(past), F.transform("__past", lambda _: F.lit(-1).cast("long")), lambda a, x: F.zip_with(a, x, lambda p, q: F.greatest(p, q)))
    rows = K._with_carries(rows, ends.withColumn("__past", most), keys, ["__past"])
    return rows.withColumn("last", F.zip_with("last", "__past", lambda a, b: F.greatest(a, b))).drop(K.BLOCK, "__past")


def single(bars: DataFrame, cfg: StudyConfig, keys: list[str], names: list[str], size: int = ROWS) -> DataFrame:
    """keys, c_t and the named features of the base timeframe alone, as double."""
    made = A.materialize(of_timeframe(bars, cfg, cfg.base_timeframe, keys, size, "double"), "single")
    columns = described(cfg)[0][cfg.base_timeframe]
    place = {f.name.split("__", 1)[1]: i for i, f in enumerate(columns.features)}
    kinds = {f.name: f.dataType.simpleString() for f in made.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unpacked(batch.column("v"), len(columns.features), "double")
            v = _finished(columns, batch.column("n").to_numpy().astype(float), v, _rows(batch.column("last"), len(columns.since)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "c_t")), *(pa.array(np.ascontiguousarray(v[:, place[n]]), from_pandas=True) for n in names)], names=[*keys, "c_t", *names])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*keys, "c_t")), *(f"`{n}` double" for n in names)])
    return with_carries(made, keys, size).select(*keys, "c_t", "n", "v", "last").mapInArrow(run, schema)


def _finished(made: Columns, n: np.ndarray, v: np.ndarray, last: np.ndarray) -> np.ndarray:
    """v with the bars since the flags."""
    for i, (at, run) in enumerate(made.since):
        gap = n - last[:, i]
        v[:, at] = np.where(np.isfinite(v[:, at]), gap, np.nan) if run else np.where(last[:, i] >= 0, gap, np.nan)
    return v


def between(cfg: StudyConfig, made: dict[str, Columns], v: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> Columns:
    """Features between timeframes and over all of them. v, x: rows by timeframe."""
    averages = [*(("ema", p) for p in cfg.ema_periods), *(("sma", p) for p in cfg.sma_periods)]
    keys, wanted, pip = [f"{k}_{p}" for k, p in averages], set(cfg.cross_tf_per_indicator_features), cfg.points_per_pip
    place = {tf: {f.name.split("__", 1)[1]: i for i, f in enumerate(c.features)} for tf, c in made.items()}
    rows = len(next(iter(v.values())))
    named = lambda tf, name: v[tf][:, place[tf][name]].astype(float) if name in place[tf] else np.full(rows, np.nan)
    value, slope = (lambda tf, i: x[tf][:, i]), (lambda tf, i: x[tf][:, len(keys) + i])
    atr, price = (lambda tf: x[tf][:, -2]), (lambda tf: x[tf][:, -1])
    out = Columns("", "")
    for lo, hi in cfg.timeframe_pairs:
        out.prefix, out.timeframe = f"x_{lo}_{hi}__", f"{lo}|{hi}"
        for i, j in cfg.combinations(keys):
            tag = keys[i] if i == j else f"{keys[i]}_vs_{keys[j]}"
            gap, one, two = value(lo, i) - value(hi, j), slope(lo, i), slope(hi, j)
            both = np.isfinite(one) & np.isfinite(two)
            kinds = {
                "value_dist_pips": (gap / pip, "cross_tf_distance", "pips"), "value_dist_atr": (divided(gap, atr(lo)), "cross_tf_distance", "atr_multiples"), "slope_diff_atr": (one - two, "cross_tf_slope", "atr_multiples_per_bar"),
                "slope_sign_agree": (np.where(both, np.sign(one) == np.sign(two), np.nan), "cross_tf_slope", "boolean"), "slope_ratio": (divided(one, two), "cross_tf_slope", "ratio"),
            }
            for name, (values, family, unit) in kinds.items():
                if name in wanted:
                    out.add(f"{tag}_{name}", values, family, unit, f"{lo} {keys[i]} against {hi} {keys[j]}")
    base = cfg.base_timeframe
    for hi in cfg.higher_timeframes:
        out.prefix, out.timeframe = f"p2h_{hi}__", hi
        for i, key in enumerate(keys):
            gap = price(base) - value(hi, i)
            out.add(f"{key}_dist_pips", gap / pip, "price_to_htf", "pips", f"base price less {hi} {key}")
            out.add(f"{key}_dist_atr", divided(gap, atr(hi)), "price_to_htf", "atr_multiples", f"base price less {hi} {key}, per its ATR")
    w, dense = cfg.consolidation_windows[0], cfg.crossover_windows[-1]
    for lo, hi in cfg.timeframe_pairs:
        out.prefix, out.timeframe = f"x_{lo}_{hi}__", f"{lo}|{hi}"
        a, b = ({n: named(tf, n) for n in ("ema_ordering_score", "combined_ribbon_width_atr", f"ema_cross_density_{dense}", "ema_entanglement_fraction", f"is_compressed_{w}", f"is_expanded_{w}")} for tf in (lo, hi))
        tell = lambda p, q, test: np.where(np.isfinite(p) & np.isfinite(q), test, np.nan)
        score, tight, wide = "ema_ordering_score", f"is_compressed_{w}", f"is_expanded_{w}"
        with np.errstate(invalid="ignore"):
            out.add("trend_agreement", np.sign(a[score]) * np.sign(b[score]), "cross_tf_direction", "score_-1_to_1", "whether both orders agree")
            out.add("ordering_score_diff", a[score] - b[score], "cross_tf_direction", "score", "difference of both orders")
            out.add("ribbon_width_ratio_atr", divided(a["combined_ribbon_width_atr"], b["combined_ribbon_width_atr"]), "cross_tf_structure", "ratio", "ratio of both ribbons' widths")
            out.add("cross_density_ratio", divided(a[f"ema_cross_density_{dense}"], b[f"ema_cross_density_{dense}"]), "cross_tf_structure", "ratio", "ratio of both densities of crossings")
            out.add("entanglement_diff", a["ema_entanglement_fraction"] - b["ema_entanglement_fraction"], "cross_tf_structure", "fraction", "difference of both entanglements")
            out.add("ltf_compressed_htf_trending", tell(a[tight], b[score], (a[tight] > 0.5) & (np.abs(b[score]) >= cfg.trend_ordering_threshold)), "cross_tf_structure", "boolean", "lower compressed, higher in a trend")
            out.add("ltf_expanding_htf_compressed", tell(a[wide], b[tight], (a[wide] > 0.5) & (b[tight] > 0.5)), "cross_tf_structure", "boolean", "lower expanded, higher compressed")
            out.add("both_compressed", tell(a[tight], b[tight], (a[tight] > 0.5) & (b[tight] > 0.5)), "cross_tf_structure", "boolean", "both compressed")
            out.add("ltf_bull_htf_bear", tell(a[score], b[score], (a[score] > 0) & (b[score] < 0)), "cross_tf_structure", "boolean", "lower in rising, higher in falling order")
    out.prefix, out.timeframe = "mtf__", "all"
    scores, tight = (np.stack([named(tf, n) for tf in cfg.active_timeframes], axis=1) for n in ("ema_ordering_score", f"is_compressed_{w}"))
    some = lambda m, values: np.where(np.isfinite(m).any(axis=1), values, np.nan)
    with np.errstate(invalid="ignore"):
        out.add("n_timeframes_bullish", some(scores, (scores > 0).sum(axis=1)), "cross_tf_direction", "count", "timeframes in rising order")
        out.add("n_timeframes_bearish", some(scores, (scores < 0).sum(axis=1)), "cross_tf_direction", "count", "timeframes in falling order")
        out.add("direction_disagreement", np.nanstd(scores, axis=1), "cross_tf_direction", "score_sd", "spread of the orders")
        out.add("mean_ordering_score", np.nanmean(scores, axis=1), "cross_tf_direction", "score_-1_to_1", "mean of the orders")
        out.add("n_timeframes_compressed", some(tight, (tight > 0.5).sum(axis=1)), "cross_tf_structure", "count", "timeframes that are compressed")
    return out


def described(cfg: StudyConfig) -> tuple[dict[str, Columns], Columns]:
    """The columns of each timeframe and of those between, from a run over two bars."""
    bars = {c: np.array([1.0, 2.0]) for c in BARS}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        made = {tf: of_bars(bars, cfg, tf) for tf in cfg.active_timeframes}
        columns = {tf: c for tf, (c, _) in made.items()}
        return columns, between(cfg, columns, {tf: c.table() for tf, c in columns.items()}, {tf: x for tf, (_, x) in made.items()})


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of numbers, NaN where it is null."""
    out = np.full((len(column), width), np.nan)
    there = np.asarray(column.is_valid())
    if there.any():
        out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _unpacked(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of numbers out of their bytes, NaN where the column is null."""
    out, there = np.full((len(column), width), np.nan, WIRE[kind]), np.asarray(column.is_valid())
    out[there] = np.frombuffer(b"".join(column.drop_null().to_pylist()), WIRE[kind]).reshape(-1, width)
    return out


def matrix(aligned: DataFrame, cfg: StudyConfig, keys: list[str]) -> DataFrame:
    """keys and every feature as float. aligned: keys and a struct n, x, v, last for each timeframe, null where no bar has closed."""
    columns, extra = described(cfg)
    names = [f.name for c in (*columns.values(), extra) for f in c.features]
    numbers = 2 * (len(cfg.ema_periods) + len(cfg.sma_periods)) + 2
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                v, x = {}, {}
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", RuntimeWarning)
                    for tf, made in columns.items():
                        n, x_, v_, last = (pc.struct_field(batch.column(tf), f) for f in ("n", "x", "v", "last"))
                        x[tf] = _rows(x_, numbers)
                        v[tf] = _finished(made, n.to_numpy(zero_copy_only=False).astype(float), _unpacked(v_, len(made.features), "float"), _rows(last, len(made.since)))
                    cross = between(cfg, columns, v, x).table()
                table = np.concatenate([*v.values(), cross], axis=1).astype(np.float32)
                values = [pa.array(np.ascontiguousarray(table[:, i]), pa.float32(), from_pandas=True) for i in range(table.shape[1])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *values], names=[*keys, *names])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{n}` float" for n in names)])
    return aligned.select(*keys, *columns).mapInArrow(run, schema)

