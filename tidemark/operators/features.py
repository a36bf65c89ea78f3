"""Features of one timeframe from its bars and averages, and features between timeframes. Prices are points."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.scalars import safe_divide
from tidemark.operators import blocks as K
from tidemark.operators import rolling as R

TIE = 1e-9


def pairs_of(values: list[Column], shape: Callable[[Column, Column], Column]) -> list[Column]:
    """shape(a, b) of every two values, the earlier one first."""
    return [shape(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]


def _count(tests: list[Column]) -> Column:
    return reduce(Column.__add__, (F.coalesce(t.cast("int"), F.lit(0)) for t in tests))


def _share(tests: list[Column], held: list[Column]) -> Column:
    return safe_divide(_count(tests), _count(held))


def ordering_score(averages: list[Column]) -> Column:
    """Share of pairs in rising order less the share in falling order (shorter period first), null where no pair is there."""
    gaps = pairs_of(averages, lambda a, b: a - b)
    held = [g.isNotNull() for g in gaps]
    return _share([g > TIE for g in gaps], held) - _share([g < -TIE for g in gaps], held)


def entanglement(averages: list[Column], atr: Column, fraction: float) -> Column:
    """Share of pairs nearer to each other than a fraction of the true range's average; null without one."""
    gaps = pairs_of(averages, lambda a, b: F.abs(a - b))
    return F.when(atr.isNotNull(), _share([g < atr * fraction for g in gaps], [g.isNotNull() for g in gaps]))


def crossings(averages: list[Column], before: list[Column]) -> tuple[Column, Column]:
    """Events and net direction of the pairs whose sign turned since the row before, where both rows have both averages."""
    now, past = pairs_of(averages, lambda a, b: F.signum(F.round(a - b, 6))), pairs_of(before, lambda a, b: F.signum(F.round(a - b, 6)))
    ups = _count([(n > 0) & (p <= 0) for n, p in zip(now, past, strict=True)])
    downs = _count([(n < 0) & (p >= 0) for n, p in zip(now, past, strict=True)])
    return ups + downs, ups - downs


def width(averages: list[Column]) -> Column:
    return F.greatest(*averages) - F.least(*averages)


def timeframe_features(bars: DataFrame, keys: list[str], periods: tuple[int, ...], *, atr: int = 14, slope: int = 3, window: int = 12, lookback: int = 50, least: int = 10, low: float = 0.2, entangled: float = 0.25, average: str = "sma", price: str = "close") -> DataFrame:
    """One row per bar (keys, t, c_t, close): averages m<period> and their ribbon, order, entanglement, crossings of the last `window` bars,
    slope of the second period per ATR, and whether the range of the last `window` bars is compressed or expanded against `lookback`.

    `average` is sma or ema, taken of the column `price`; ranges and the true range are of the bars themselves. Windows and averages go
    over blocks of a series."""
    names = [f"m{p}" for p in periods]
    exponential = {("price", n): (2 / (p + 1), p) for n, p in zip(names, periods, strict=True)} if average == "ema" else {}
    columns = [*keys, "t", "c_t", "high", "low", "close", F.col(price).alias("price")]
    rows = K.trailing(bars.select(*columns), keys, "t", 1, lambda df, w: df.withColumn("tr", R.true_range("high", "low", "close", w).cast("double")))
    rows = R.recurrences_of(rows, keys, "t", {("tr", "atr"): (1 / atr, atr)} | exponential)
    averages, main = [F.col(n) for n in names], F.col(names[1])

    def make(df: DataFrame, w: WindowSpec) -> DataFrame:
        plain = {} if exponential else {n: R.full("price", F.avg, w, p) for p, n in zip(periods, names, strict=True)}
        df = df.withColumns({"atr": F.when(F.col("atr") > 0, F.col("atr")), "range": R.full("high", F.max, w, window) - R.full("low", F.min, w, window)} | plain)
        df = df.withColumns({f"__{n}": F.lag(n).over(w) for n in names}).withColumn("range_atr", safe_divide(F.col("range"), F.col("atr")))
        events, net = crossings(averages, [F.col(f"__{n}") for n in names])
        df = df.withColumns({
            "score": ordering_score(averages), "entangled": entanglement(averages, F.col("atr"), entangled), "width": width(averages), "width_atr": safe_divide(width(averages), F.col("atr")),
            "slope_atr": safe_divide((main - F.lag(main, slope).over(w)) / float(slope), F.col("atr")), "crossed": events, "net": net, "pct": R.percentile_rank("range_atr", w, lookback, least),
        })
        return df.withColumns({"cross_count": R.full("crossed", F.sum, w, window), "compressed": F.col("pct") <= low, "expanded": F.col("pct") >= 1 - low})

    rows = K.trailing(rows, keys, "t", lookback + window + max(periods) + slope + 2, make)
    made = ["range_atr", "score", "entangled", "width", "width_atr", "slope_atr", "crossed", "net", "pct", "cross_count", "compressed", "expanded"]
    return rows.select(*keys, "t", "c_t", F.col("price").alias("close"), "atr", *names, "range", *made)


def between(lo: str, hi: str, average: str, trend: float) -> dict[str, Column]:
    """Columns that set the struct `lo` (a lower timeframe) against the struct `hi` (a higher one, closed at that time). Distances are per
    the lower one's true range, except price to the higher average, which is per the higher one's."""
    a, b = (lambda c: F.col(f"{lo}.{c}")), (lambda c: F.col(f"{hi}.{c}"))
    both = lambda x, y, test: F.when(x.isNotNull() & y.isNotNull(), test)
    return {
        "value_dist": a(average) - b(average), "value_dist_atr": safe_divide(a(average) - b(average), a("atr")), "slope_diff_atr": a("slope_atr") - b("slope_atr"),
        "price_dist": a("close") - b(average), "price_dist_atr": safe_divide(a("close") - b(average), b("atr")),
        "agreement": F.signum(a("score")) * F.signum(b("score")), "score_diff": a("score") - b("score"), "entangled_diff": a("entangled") - b("entangled"),
        "width_ratio": safe_divide(a("width_atr"), b("width_atr")), "density_ratio": safe_divide(a("cross_count"), b("cross_count")),
        "compressed_in_trend": both(a("compressed"), b("score"), a("compressed") & (F.abs(b("score")) >= trend)),
        "expanding_in_compression": both(a("expanded"), b("compressed"), a("expanded") & b("compressed")),
        "both_compressed": both(a("compressed"), b("compressed"), a("compressed") & b("compressed")),
        "bull_in_bear": both(a("score"), b("score"), (a("score") > 0) & (b("score") < 0)),
    }


def across(frames: list[str]) -> dict[str, Column]:
    """Columns over all timeframes (structs): how many are in rising order, falling order or compressed, and the spread and mean of their
    scores; null where all are missing."""
    scores, compressed = [F.col(f"{f}.score") for f in frames], [F.col(f"{f}.compressed") for f in frames]
    held, some = _count([s.isNotNull() for s in scores]), F.coalesce(*scores).isNotNull()
    mean = safe_divide(reduce(Column.__add__, (F.coalesce(s, F.lit(0.0)) for s in scores)), held)
    spread = reduce(Column.__add__, (F.coalesce((s - mean) * (s - mean), F.lit(0.0)) for s in scores))
    return {
        "bullish": F.when(some, _count([s > 0 for s in scores])), "bearish": F.when(some, _count([s < 0 for s in scores])),
        "n_compressed": F.when(F.coalesce(*compressed).isNotNull(), _count(compressed)), "disagreement": F.sqrt(safe_divide(spread, held)), "mean_score": mean,
    }


def states(compressed: Column, net: Column, higher: Column, trend: float) -> dict[str, Column]:
    """Named predicates for both directions; a missing value never satisfies one."""
    out: dict[str, Column] = {}
    for word, sign in (("up", 1), ("down", -1)):
        cross, aligned = net * sign > 0, higher * sign >= trend
        tests = {"crossing": cross, "compression": compressed, "compression_crossing": compressed & cross, "compression_higher": compressed & aligned, "compression_crossing_higher": compressed & cross & aligned}
        out |= {f"{name}_{word}": F.coalesce(test, F.lit(False)) for name, test in tests.items()}
    return out


def average_kinds_crossed(ema: list[str], sma: list[str], w) -> Column:
    """How many same-period pairs of the two kinds changed sides since the row before; a pair that touches is on neither side."""
    side = lambda e, s: F.signum(F.round(e - s, 6))
    now = [side(F.col(e), F.col(s)) for e, s in zip(ema, sma, strict=True)]
    past = [side(F.lag(e).over(w), F.lag(s).over(w)) for e, s in zip(ema, sma, strict=True)]
    return _count([n * p < 0 for n, p in zip(now, past, strict=True)])


def crossed_pairs(rows: DataFrame, keys: list[str], order: str, ema: tuple[int, ...], sma: tuple[int, ...], families: tuple[str, ...] = ("ema", "sma", "ema_vs_sma")) -> DataFrame:
    """keys, c_t, family, fast, slow, direction (1 up, -1 down) of every pair that changed order since the row before, a touch counted as
    before the turn. rows: keys, c_t, `order`, and x, an array that begins with the averages (ema, then sma)."""
    pairs = []
    if "ema" in families:
        pairs += [("ema", a, b, ema[a], ema[b]) for a in range(len(ema)) for b in range(a + 1, len(ema))]
    if "sma" in families:
        pairs += [("sma", len(ema) + a, len(ema) + b, sma[a], sma[b]) for a in range(len(sma)) for b in range(a + 1, len(sma))]
    if "ema_vs_sma" in families:
        pairs += [("ema_vs_sma", ema.index(p), len(ema) + sma.index(p), p, p) for p in ema if p in sma]
    table = F.from_json(F.lit(json.dumps([dict(zip(("family", "a", "b", "fast", "slow"), p, strict=True)) for p in pairs])), "array<struct<family: string, a: int, b: int, fast: int, slow: int>>")
    held = K.previous(rows, keys, order, [order], {"__past": F.col("x")})
    side = lambda x, p: F.signum(F.get(x, p["a"]) - F.get(x, p["b"]))
    number = lambda x: F.when(~F.isnan(x), x)

    def turned(p: Column) -> Column:
        now, past = number(side(F.col("x"), p)), number(side(F.col("__past"), p))
        direction = F.when((now > 0) & (past <= 0), 1).when((now < 0) & (past >= 0), -1)
        return F.struct(p["family"].alias("family"), p["fast"].alias("fast"), p["slow"].alias("slow"), direction.alias("direction"))

    hits = F.filter(F.transform(table, turned), lambda x: x["direction"].isNotNull())
    return held.select(*keys, "c_t", F.inline(hits))


def crossing_report(crossed: DataFrame, keys: list[str], gap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: per family and direction the pair events, distinct times and episodes; per pair its events; per session the distinct
    times."""
    from tidemark.functions.scalars import session_of
    from tidemark.operators.studies import islands

    group = [*keys, "family", "direction"]
    times = crossed.groupBy(*group, "c_t").agg(F.count("*").alias("pairs"))
    spans = islands(times, group, "c_t", gap).groupBy(*group).agg(F.sum("pairs").alias("events"), F.count("*").alias("times"), F.countDistinct("island").alias("episodes"))
    spans = spans.withColumns({"pairs_per_time": F.round(F.col("events") / F.col("times"), 2), "times_per_episode": F.round(F.col("times") / F.col("episodes"), 2)})
    by_pair = crossed.groupBy(*keys, "family", "fast", "slow", "direction").agg(F.count("*").alias("events"))
    by_session = times.groupBy(*group, session_of(F.floor(F.col("c_t") / 3600) % 24).alias("session")).agg(F.count("*").alias("times"))
    return spans, by_pair, by_session
