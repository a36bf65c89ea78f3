"""Trailing windows, recurrences and forward windows over ordered series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators import blocks as K


def full(value: str, aggregate: Callable[[Column], Column], w: WindowSpec, rows: int) -> Column:
    """The aggregate of the last `rows` values, null until there are so many."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) == rows, aggregate(F.col(value)).over(frame))


def true_range(high: str, low: str, close: str, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def percentile_rank(value: str, w: WindowSpec, rows: int, least: int) -> Column:
    """Share of the trailing non-null values below the current one, ties half: average rank over their number."""
    held = F.collect_list(value).over(w.rowsBetween(1 - rows, 0))
    below, same = F.size(F.filter(held, lambda x: x < F.col(value))), F.size(F.filter(held, lambda x: x == F.col(value)))
    return F.when(F.col(value).isNotNull() & (F.size(held) >= least), (below + (same + 1) / 2) / F.size(held))


def since_and_run(rows: DataFrame, flag: str, keys: list[str], t: str = "t", size: int = K.TIME) -> DataFrame:
    """Adds `since`, rows since the flag was last true (0 on it, null before), and `run`, consecutive true rows up to here (0 on false,
    null on null, which breaks the run)."""
    n = F.col("__n")
    marks = {"__held": F.when(F.col(flag), n), "__broken": F.when(~F.coalesce(F.col(flag), F.lit(False)), n)}
    out = K.carried(K.numbered(rows, keys, t, size), keys, t, [t], marks, size)
    run = F.when(F.col(flag).isNotNull(), n - F.coalesce("__broken", F.lit(-1)))
    return out.withColumns({"since": n - F.col("__held"), "run": run}).drop("__n", *marks)


def recurrences(rows: DataFrame, keys: list[str], t: str, value: str, alphas: dict[str, tuple[float, int]]) -> DataFrame:
    """Exponential averages y = a x + (1 - a) y', seeded with the first value and shown once the given number of values was seen; all of
    them in one pass over each series."""
    return recurrences_of(rows, keys, t, {(value, name): rule for name, rule in alphas.items()})


def exponential(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """y = alpha x + (1 - alpha) y' from y' = before on, without a loop over rows: spans of 256 by a triangular matrix of weights, their
    ends carried from span to span."""
    if not len(x):
        return np.zeros(0)
    n, span = len(x), 256
    lag = np.arange(span)[None, :] - np.arange(span)[:, None]
    keep = 1 - alpha
    weights = np.where(lag >= 0, alpha * np.power(keep, np.maximum(lag, 0)), 0.0)
    local = np.pad(x, (0, -n % span)).reshape(-1, span) @ weights
    carries, fade = np.empty(len(local)), keep**span
    for i, end in enumerate(local[:, -1]):
        carries[i] = before
        before = end + fade * before
    return (local + carries[:, None] * np.power(keep, np.arange(1, span + 1))).ravel()[:n]


def recurrences_of(rows: DataFrame, keys: list[str], t: str, alphas: dict[tuple[str, str], tuple[float, int]], size: int = K.ROWS) -> DataFrame:
    """As recurrences, for any number of columns: (column, name of its average) to factor and number of values.

    An average is linear in what came before it, so that blocks of rows are summed up alone (their own end, how far they let the past
    fade), the summaries of a series are chained, and each block is then done from its start."""
    names, values = [name for _, name in alphas], sorted({value for value, _ in alphas})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    dealt = K.numbered(rows, keys, t).withColumn(K.BLOCK, K.block_of(F.col("__n"), size))

    def valid(group: pd.DataFrame, value: str) -> np.ndarray:
        x = group[value].to_numpy(float)
        return x[x == x]

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(t)
        row = {k: group[k].iloc[0] for k in (*keys, K.BLOCK)}
        for i, value in enumerate(values):
            x = valid(group, value)
            row |= {f"n{i}": len(x), f"x{i}": x[0] if len(x) else np.nan}
        ends = [exponential(valid(group, value), alpha, 0.0)[-1:] for (value, _), (alpha, _) in alphas.items()]
        return pd.DataFrame([row | {"ends": [float(e[0]) if len(e) else 0.0 for e in ends]}])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        """A row per block of a series: what each average was before it, and how many values of each column came before."""
        state, seen, out = [np.nan] * len(alphas), [0] * len(values), []
        for row in group.sort_values(K.BLOCK).to_dict("records"):
            out.append({k: row[k] for k in (*keys, K.BLOCK)} | {"state": list(state), "seen": list(seen)})
            for j, ((value, _), (alpha, _)) in enumerate(alphas.items()):
                i = values.index(value)
                if row[f"n{i}"]:
                    start = row[f"x{i}"] if seen[i] == 0 else state[j]
                    state[j] = row["ends"][j] + (1 - alpha) ** row[f"n{i}"] * start
            seen = [s + row[f"n{i}"] for i, s in enumerate(seen)]
        return pd.DataFrame(out)

    def apply(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        group, made, held = group.sort_values(t), {}, before.iloc[0]
        for j, ((value, name), (alpha, least)) in enumerate(alphas.items()):
            x, seen = group[value].to_numpy(float), int(held["seen"][values.index(value)])
            there = x == x
            count, start = np.cumsum(there), held["state"][j]
            y = exponential(x[there], alpha, start if seen else (x[there][0] if there.any() else np.nan))
            filled = np.concatenate([[start], y])[count]
            made[name] = np.where(seen + count >= max(least, 1), filled, np.nan)
        return group.drop(columns=[K.BLOCK, "__n"]).assign(**made)

    needed = dealt.select(*keys, t, K.BLOCK, *(v for v in values if v not in (*keys, t)))
    numbers = ", ".join(f"n{i} long, x{i} double" for i in range(len(values)))
    ends = needed.groupBy(*keys, K.BLOCK).applyInPandas(sum_up, f"{kinds}, {K.BLOCK} long, {numbers}, ends array<double>")
    chained = ends.groupBy(*keys).applyInPandas(chain, f"{kinds}, {K.BLOCK} long, state array<double>, seen array<long>")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"`{n}` double" for n in names)])
    out = dealt.groupBy(*keys, K.BLOCK).cogroup(chained.groupBy(*keys, K.BLOCK)).applyInPandas(apply, schema)
    return out.select(*rows.columns, *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names))


def heikin_ashi(bars: DataFrame, keys: list[str], depth: int = 60) -> DataFrame:
    """Adds ha_open, ha_high, ha_low, ha_close. The open halves its past with each bar, so that a fold over the last `depth` closes is
    exact in double precision."""
    close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4.0

    def make(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("ha_close", close).withColumn("__first", F.first((F.col("open") + F.col("close")) / 2.0).over(w))
        past = F.collect_list("ha_close").over(w.rowsBetween(-depth, -1))
        seed = F.when(F.col("__n") <= depth, F.col("__first")).otherwise(F.element_at("__past", 1))
        rows = rows.withColumn("__past", past).withColumn("ha_open", F.aggregate("__past", seed, lambda a, x: (a + x) / 2.0))
        return rows.withColumn("ha_high", F.greatest("high", "ha_open", "ha_close")).withColumn("ha_low", F.least("low", "ha_open", "ha_close")).drop("__first", "__past")

    return K.trailing(bars, keys, "t", depth + 1, make)


def forward_extremes(bars: DataFrame, keys: list[str], t: str, horizon: int) -> DataFrame:
    """Over (t, t + horizon]: bars, highest high and lowest low with the time of the latest, and the last close."""

    def make(rows: DataFrame, w: WindowSpec) -> DataFrame:
        w = w.rangeBetween(1, horizon)
        high, low = F.max(F.struct("high", t)).over(w), F.min(F.struct(F.col("low"), (-F.col(t)).alias("back"))).over(w)
        return rows.withColumns({"f_n": F.count("*").over(w), "f_high": high["high"], "f_high_t": high[t] - F.col(t), "f_low": low["low"], "f_low_t": -low["back"] - F.col(t), "f_close": F.max_by("close", t).over(w)})

    return K.ahead(bars, keys, t, horizon, make)


def first_touches(bars: DataFrame, keys: list[str], t: str, horizon: int, distances: dict[str, int]) -> DataFrame:
    """For each tag: up_, down_ (units of time to the first bar in (t, t + horizon] that reaches close + distance, or close - distance) and
    first_ (which came first: 1 up, -1 down, 0 neither, 2 both in one bar). All distances share one pass over the bars ahead."""
    columns = list(bars.columns)

    def make(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("__ahead", F.collect_list(F.struct(F.col(t).alias("at"), "high", "low")).over(w.rangeBetween(1, horizon)))
        reach = lambda hit: F.array_min(F.transform(F.filter("__ahead", hit), lambda x: x["at"])) - F.col(t)
        up = lambda d: reach(lambda x: x["high"] >= F.col("close") + d)
        down = lambda d: reach(lambda x: x["low"] <= F.col("close") - d)
        touches = {f"{word}_{tag}": of(d) for tag, d in distances.items() for word, of in (("up", up), ("down", down))}
        return rows.withColumns(touches).drop("__ahead")

    out = K.ahead(bars, keys, t, horizon, make)
    firsts = {}
    for tag in distances:
        up, down = F.col(f"up_{tag}"), F.col(f"down_{tag}")
        firsts[f"first_{tag}"] = F.when(up.isNull() & down.isNull(), 0).when(down.isNull() | (up < down), 1).when(up.isNull() | (down < up), -1).otherwise(2)
    return out.withColumns(firsts).select(*columns, *(f"{x}_{tag}" for tag in distances for x in ("up", "down", "first")))


def first_touch(bars: DataFrame, keys: list[str], t: str, horizon: int, distance: int) -> DataFrame:
    """As first_touches for one distance: t_up, t_down, first."""
    out = first_touches(bars, keys, t, horizon, {"x": distance})
    return out.withColumnsRenamed({"up_x": "t_up", "down_x": "t_down", "first_x": "first"})
