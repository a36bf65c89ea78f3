"""The registered queries of the engine's own operators on the driver's tables, and their SQL.

`events` is the tick tape: event_type is the symbol, value in hundredths the price in points. Bars are hourly unless said otherwise;
`t` is a bar's opening time and `c_t` its closing time, in seconds since 1970."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import compression_state, floored, safe_divide, session_of
from tidemark.operators import bars as B
from tidemark.operators import blocks as K
from tidemark.operators import rolling as R
from tidemark.operators import studies as S
from tidemark.operators import ticks as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY, HOUR = ["symbol"], 3600


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), "ts", B.epoch_seconds("ts").alias("s"), "event_id", F.round(F.col("value") * 100).cast("long").alias("p"))


def hourly(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    made = B.resample(tape(spark, sf_dir), KEY, "s", ["ts", "event_id"], "p", hours * HOUR)
    return made.withColumn("c_t", F.col("t") + hours * HOUR)


_TAPE = "tape AS (SELECT event_type AS symbol, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id, CAST(round(value * 100) AS BIGINT) AS p FROM events)"


def _bars(hours: int = 1, name: str = "bars") -> str:
    n = hours * HOUR
    return f"""{name} AS (SELECT symbol, CAST(s // {n} * {n} AS BIGINT) AS t, first(p ORDER BY ts, event_id) AS open, max(p) AS high, min(p) AS low,
  last(p ORDER BY ts, event_id) AS close, count(*) AS n, CAST(s // {n} * {n} + {n} AS BIGINT) AS c_t FROM tape GROUP BY symbol, s // {n})"""


_BASE = f"WITH RECURSIVE {_TAPE}, {_bars()}"
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY t)"


def _last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(expression: str, value: str, n: int) -> str:
    return f"CASE WHEN count({value}) {_last(n)} = {n} THEN {expression} {_last(n)} END"


def _ahead(seconds: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {seconds} FOLLOWING)"


# --- bars and alignment -------------------------------------------------------------------------------------------------


@query(f"{_BASE} SELECT * FROM bars")
def ohlc_resample(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(f"WITH {_TAPE} SELECT symbol, CAST(-((-s) // 3600) * 3600 AS BIGINT) AS t, first(p ORDER BY ts, event_id) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY ts, event_id) AS close, count(*) AS n FROM tape GROUP BY 1, 2".replace("-((-s) // 3600)", "((s + 3599) // 3600)"))
def ohlc_right_label(spark, sf_dir):
    return B.resample(tape(spark, sf_dir), KEY, "s", ["ts", "event_id"], "p", HOUR, right=True)


@query(f"WITH {_TAPE}, {_bars(4)} SELECT symbol, t, n FROM bars WHERE t + 14400 <= (SELECT max(s) FROM tape)")
def incomplete_tail_drop(spark, sf_dir):
    return B.drop_open_tail(hourly(spark, sf_dir, 4), tape(spark, sf_dir), "s", 4 * HOUR).select("symbol", "t", "n")


@query(f"{_BASE} SELECT symbol, count(*) AS bars, min(t) AS first_t, max(t) AS last_t, CAST((max(t) - min(t)) // 3600 + 1 AS BIGINT) AS expected, round(count(*) / ((max(t) - min(t)) // 3600 + 1), 6) AS coverage, median(n) AS median_ticks FROM bars GROUP BY symbol")
def bar_coverage(spark, sf_dir):
    slots = F.floor((F.max("t") - F.min("t")) / HOUR) + 1
    return hourly(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), slots.cast("long").alias("expected"), F.round(F.count("*") / slots, 6).alias("coverage"), F.median("n").alias("median_ticks"))


_ASOF = f"WITH {_TAPE}, {_bars()}, {_bars(4, 'four')}, aligned AS (SELECT b.symbol, b.t, b.c_t, b.close, f.c_t AS f_t, f.close AS f_close FROM bars b ASOF LEFT JOIN four f ON b.symbol = f.symbol AND b.c_t >= f.c_t)"


def aligned(spark, sf_dir, shift: int = 0):
    four = hourly(spark, sf_dir, 4).select("symbol", F.col("c_t").alias("f_t"), F.col("close").alias("f_close"))
    if shift:
        four = K.trailing(four.select("symbol", "f_t"), KEY, "f_t", shift, lambda df, w: df.withColumn("source_t", F.lag("f_t", shift).over(w)))
        return B.asof(hourly(spark, sf_dir).select("symbol", "t", "c_t"), four, KEY, "c_t", "f_t", ["source_t"])
    return B.asof(hourly(spark, sf_dir).select("symbol", "t", "c_t", "close"), four, KEY, "c_t", "f_t", ["f_close"])


@query(f"{_ASOF} SELECT * FROM aligned")
def asof_backward(spark, sf_dir):
    return aligned(spark, sf_dir)


@query(f"{_ASOF} SELECT symbol, count(*) AS rows, count(*) FILTER (f_t IS NULL) AS missing, count(*) FILTER (f_t > c_t) AS violations, min(c_t - f_t) AS min_age, max(c_t - f_t) AS max_age, round(avg(c_t - f_t), 6) AS mean_age, median(c_t - f_t) AS median_age FROM aligned GROUP BY symbol")
def asof_age_audit(spark, sf_dir):
    age = F.col("c_t") - F.col("f_t")
    return aligned(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(F.col("f_t").isNull()).alias("missing"), F.count_if(age < 0).alias("violations"), F.min(age).alias("min_age"), F.max(age).alias("max_age"), F.round(F.avg(age), 6).alias("mean_age"), F.median(age).alias("median_age"))


@query(f"WITH {_TAPE}, {_bars()}, {_bars(4, 'four')}, lagged AS (SELECT symbol, c_t AS f_t, lag(c_t) OVER (PARTITION BY symbol ORDER BY c_t) AS source_t FROM four) SELECT 'previous_closed' AS mode, min(b.c_t - source_t) AS min_lag, max(b.c_t - source_t) AS max_lag, round(avg(b.c_t - source_t), 6) AS mean_lag FROM bars b ASOF LEFT JOIN lagged f ON b.symbol = f.symbol AND b.c_t >= f.f_t UNION ALL SELECT 'latest_closed', min(b.c_t - f_t), max(b.c_t - f_t), round(avg(b.c_t - f_t), 6) FROM bars b ASOF LEFT JOIN lagged f ON b.symbol = f.symbol AND b.c_t >= f.f_t")
def lag_distribution(spark, sf_dir):
    rows = aligned(spark, sf_dir, shift=1)
    one = lambda mode, c: rows.agg(F.lit(mode).alias("mode"), *(f(F.col("c_t") - F.col(c)).alias(n) for f, n in ((F.min, "min_lag"), (F.max, "max_lag"))), F.round(F.avg(F.col("c_t") - F.col(c)), 6).alias("mean_lag"))
    return one("previous_closed", "source_t").unionByName(one("latest_closed", "f_t"))


# --- windows ------------------------------------------------------------------------------------------------------------


@query(f"{_BASE} SELECT symbol, t, round({_full('avg(close)', 'close', 5)}, 6) AS sma_5, round({_full('avg(close)', 'close', 20)}, 6) AS sma_20 FROM bars")
def sma(spark, sf_dir):
    made = lambda df, w: df.withColumns({f"sma_{n}": F.round(R.full("close", F.avg, w, n), 6) for n in (5, 20)})
    return K.trailing(hourly(spark, sf_dir).select("symbol", "t", "close"), KEY, "t", 20, made).drop("close")


@query(f"{_BASE} SELECT symbol, t, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, (close - lag(close, 3) OVER w) / 3.0 AS slope FROM bars {_W}")
def true_range_and_slope(spark, sf_dir):
    made = lambda df, w: df.withColumns({"tr": R.true_range("high", "low", "close", w), "slope": (F.col("close") - F.lag("close", 3).over(w)) / F.lit(3.0)})
    return K.trailing(hourly(spark, sf_dir), KEY, "t", 3, made).select("symbol", "t", "tr", "slope")


@query(f"{_BASE}, r AS (SELECT symbol, t, close, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / (lag(close) OVER w)) END AS ret FROM bars {_W}) SELECT symbol, t, round({_full('stddev_samp(ret)', 'ret', 12)}, 6) AS vol, round({_full('stddev_pop(close)', 'close', 12)}, 6) AS close_std FROM r")
def realized_vol(spark, sf_dir):
    def made(df, w):
        before = F.lag("close").over(w)
        df = df.withColumn("ret", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)))
        return df.withColumns({"vol": F.round(R.full("ret", F.stddev_samp, w, 12), 6), "close_std": F.round(R.full("close", F.stddev_pop, w, 12), 6)})

    return K.trailing(hourly(spark, sf_dir).select("symbol", "t", "close"), KEY, "t", 13, made).select("symbol", "t", "vol", "close_std")


_RANGE = f"r AS (SELECT symbol, t, high, low, close, {_full('max(high)', 'high', 12)} AS hi, {_full('min(low)', 'low', 12)} AS lo FROM bars)"


def ranges(spark, sf_dir):
    made = lambda df, w: df.withColumns({"hi": R.full("high", F.max, w, 12), "lo": R.full("low", F.min, w, 12)})
    return K.trailing(hourly(spark, sf_dir).select("symbol", "t", "high", "low", "close"), KEY, "t", 12, made)


@query(f"{_BASE}, {_RANGE} SELECT symbol, t, hi - lo AS range, round((close - lo) / nullif(hi - lo, 0), 6) AS position, hi - close AS to_high, close - lo AS to_low FROM r")
def rolling_range(spark, sf_dir):
    width = F.col("hi") - F.col("lo")
    return ranges(spark, sf_dir).select("symbol", "t", width.alias("range"), F.round(safe_divide(F.col("close") - F.col("lo"), width), 6).alias("position"), (F.col("hi") - F.col("close")).alias("to_high"), (F.col("close") - F.col("lo")).alias("to_low"))


_RANK = f"{_RANGE}, k AS (SELECT symbol, t, hi - lo AS range, list(hi - lo) FILTER (hi - lo IS NOT NULL) {_last(50)} AS held FROM r), ranked AS (SELECT symbol, t, range, CASE WHEN range IS NOT NULL AND len(held) >= 10 THEN (len(list_filter(held, lambda x: x < range)) + (len(list_filter(held, lambda x: x = range)) + 1) / 2) / len(held) END AS pct FROM k)"


def ranked_ranges(spark, sf_dir):
    rows = ranges(spark, sf_dir).select("symbol", "t", (F.col("hi") - F.col("lo")).alias("range"))
    return K.trailing(rows, KEY, "t", 50, lambda df, w: df.withColumn("pct", R.percentile_rank("range", w, 50, 10)))


@query(f"{_BASE}, {_RANK} SELECT symbol, t, round(pct, 6) AS pct FROM ranked")
def rolling_percentile(spark, sf_dir):
    return ranked_ranges(spark, sf_dir).select("symbol", "t", F.round("pct", 6).alias("pct"))


@query(f"{_BASE}, {_RANK} SELECT symbol, CASE WHEN pct IS NULL THEN 'unknown' WHEN pct <= 0.2 THEN 'compressed' WHEN pct >= 0.8 THEN 'expanding' ELSE 'neutral' END AS state, count(*) AS n FROM ranked GROUP BY 1, 2")
def compression_states(spark, sf_dir):
    return ranked_ranges(spark, sf_dir).groupBy("symbol", compression_state(F.col("pct")).alias("state")).agg(F.count("*").alias("n"))


@query(f"{_BASE}, f AS (SELECT symbol, t, CASE WHEN lag(close) OVER w IS NOT NULL THEN close > lag(close) OVER w END AS up, row_number() OVER w AS rn FROM bars {_W}), g AS (SELECT *, rn - max(CASE WHEN up THEN rn END) OVER (PARTITION BY symbol ORDER BY t) AS since, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY t) AS island FROM f) SELECT symbol, t, CAST(since AS BIGINT) AS since, CASE WHEN up IS NOT NULL THEN CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY t) AS BIGINT) END AS run FROM g")
def bars_since_and_run_length(spark, sf_dir):
    rows = K.previous(hourly(spark, sf_dir).select("symbol", "t", "close"), KEY, "t", ["t"], {"past": F.col("close")})
    return R.since_and_run(rows.withColumn("up", F.col("close") > F.col("past")), "up", KEY).select("symbol", "t", "since", "run")


_NUMBERED = f"{_BASE}, x AS (SELECT symbol, t, open, high, low, close, row_number() OVER w AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {_W})"


@query(f"{_NUMBERED}, y AS (SELECT symbol, t, rn, CAST(close AS DOUBLE) AS e5, CAST(close AS DOUBLE) AS e20 FROM x WHERE rn = 1 UNION ALL SELECT x.symbol, x.t, x.rn, (2.0 / 6) * x.close + (1 - 2.0 / 6) * y.e5, (2.0 / 21) * x.close + (1 - 2.0 / 21) * y.e20 FROM y JOIN x ON x.symbol = y.symbol AND x.rn = y.rn + 1) SELECT symbol, t, round(CASE WHEN rn >= 5 THEN e5 END, 4) AS ema_5, round(CASE WHEN rn >= 20 THEN e20 END, 4) AS ema_20 FROM y")
def ema(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("symbol", "t", F.col("close").cast("double").alias("x"))
    out = R.recurrences(rows, KEY, "t", "x", {"ema_5": (2 / 6, 5), "ema_20": (2 / 21, 20)})
    return out.select("symbol", "t", F.round("ema_5", 4).alias("ema_5"), F.round("ema_20", 4).alias("ema_20"))


@query(f"{_NUMBERED}, y AS (SELECT symbol, t, rn, CAST(tr AS DOUBLE) AS a FROM x WHERE rn = 1 UNION ALL SELECT x.symbol, x.t, x.rn, (1.0 / 14) * x.tr + (1 - 1.0 / 14) * y.a FROM y JOIN x ON x.symbol = y.symbol AND x.rn = y.rn + 1) SELECT symbol, t, round(CASE WHEN rn >= 14 AND a > 0 THEN a END, 4) AS atr FROM y")
def wilder_atr(spark, sf_dir):
    made = lambda df, w: df.withColumn("x", R.true_range("high", "low", "close", w).cast("double"))
    rows = K.trailing(hourly(spark, sf_dir).select("symbol", "t", "high", "low", "close"), KEY, "t", 1, made).select("symbol", "t", "x")
    out = R.recurrences(rows, KEY, "t", "x", {"atr": (1 / 14, 14)})
    return out.select("symbol", "t", F.round(F.when(F.col("atr") > 0, F.col("atr")), 4).alias("atr"))


@query(f"{_NUMBERED}, y AS (SELECT symbol, t, rn, (open + close) / 2.0 AS o, (open + high + low + close) / 4.0 AS c FROM x WHERE rn = 1 UNION ALL SELECT x.symbol, x.t, x.rn, (y.o + y.c) / 2.0, (x.open + x.high + x.low + x.close) / 4.0 FROM y JOIN x ON x.symbol = y.symbol AND x.rn = y.rn + 1) SELECT symbol, t, round(o, 4) AS ha_open, round(c, 4) AS ha_close, round(greatest(x.high, o, c), 4) AS ha_high, round(least(x.low, o, c), 4) AS ha_low FROM y JOIN x USING (symbol, t, rn)")
def heikin_ashi(spark, sf_dir):
    return R.heikin_ashi(hourly(spark, sf_dir), KEY).select("symbol", "t", *(F.round(c, 4).alias(c) for c in ("ha_open", "ha_close", "ha_high", "ha_low")))


# --- ribbons of averages ------------------------------------------------------------------------------------------------

PERIODS = (3, 6, 12, 24)
_PAIRS = [(a, b) for i, a in enumerate(PERIODS) for b in PERIODS[i + 1 :]]
_MA = f"ma AS (SELECT symbol, t, close, {', '.join(_full('avg(close)', 'close', p) + f' AS m{p}' for p in PERIODS)} FROM bars)"


def ribbon(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("symbol", "t", F.col("close").cast("double").alias("close"))
    rows = K.trailing(rows, KEY, "t", max(PERIODS), lambda df, w: df.withColumns({f"m{p}": R.full("close", F.avg, w, p) for p in PERIODS}))
    return rows.withColumn("ma", F.array(*(f"m{p}" for p in PERIODS)))


def _pairs(sign):
    """Array over pairs of periods (shorter first) of the sign of their difference, null unless both are there."""
    i = F.array(*(F.struct(F.lit(PERIODS.index(a)).alias("i"), F.lit(PERIODS.index(b)).alias("j")) for a, b in _PAIRS))
    return F.transform(i, lambda x: sign(F.get("ma", x["i"]) - F.get("ma", x["j"])))


def _each(expression: str, join: str = " + ") -> str:
    return join.join(expression.format(a=a, b=b) for a, b in _PAIRS)


@query(f"{_BASE}, {_MA} SELECT symbol, t, round(({_each('coalesce(CAST(m{a} - m{b} > 1e-9 AS INT), 0)')}) / nullif({_each('CAST(m{a} - m{b} IS NOT NULL AS INT)')}, 0), 6) AS bullish, round(({_each('coalesce(CAST(m{a} - m{b} < -1e-9 AS INT), 0)')}) / nullif({_each('CAST(m{a} - m{b} IS NOT NULL AS INT)')}, 0), 6) AS bearish, round(({_each('coalesce(CAST(abs(m{a} - m{b}) < 50 AS INT), 0)')}) / nullif({_each('CAST(m{a} - m{b} IS NOT NULL AS INT)')}, 0), 6) AS entangled FROM ma")
def pair_ordering_and_entanglement(spark, sf_dir):
    rows = ribbon(spark, sf_dir).withColumn("d", _pairs(lambda x: x))
    held = F.size(F.filter("d", lambda x: x.isNotNull()))
    share = lambda test: F.round(safe_divide(F.size(F.filter("d", lambda x: F.coalesce(test(x), F.lit(False)))), held), 6)
    return rows.select("symbol", "t", share(lambda x: x > 1e-9).alias("bullish"), share(lambda x: x < -1e-9).alias("bearish"), share(lambda x: F.abs(x) < 50).alias("entangled"))


_SIGN = "sign(round(m{a} - m{b}, 6)) AS s{a}_{b}, lag(sign(round(m{a} - m{b}, 6))) OVER w AS p{a}_{b}"


@query(f"{_BASE}, {_MA}, s AS (SELECT symbol, t, {_each(_SIGN, ', ')} FROM ma {_W}) " + " UNION ALL ".join(f"SELECT symbol, t, {a} AS fast, {b} AS slow, CASE WHEN s{a}_{b} > 0 THEN 1 ELSE -1 END AS direction FROM s WHERE (s{a}_{b} > 0 AND p{a}_{b} <= 0) OR (s{a}_{b} < 0 AND p{a}_{b} >= 0)" for a, b in _PAIRS))
def pair_crossings(spark, sf_dir):
    rows = ribbon(spark, sf_dir).withColumn("s", _pairs(lambda x: F.signum(F.round(x, 6))))
    rows = K.previous(rows, KEY, "t", ["t"], {"p": F.col("s")})
    pairs = F.array(*(F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow")) for a, b in _PAIRS))
    hit = F.transform(pairs, lambda x, i: F.struct(x["fast"].alias("fast"), x["slow"].alias("slow"), F.when((F.get("s", i) > 0) & (F.get("p", i) <= 0), 1).when((F.get("s", i) < 0) & (F.get("p", i) >= 0), -1).alias("direction")))
    return rows.select("symbol", "t", F.inline(F.filter(hit, lambda x: x["direction"].isNotNull())))


_LIST = f"list_filter([{', '.join(f'm{p}' for p in PERIODS)}], lambda x: x IS NOT NULL)"


@query(f"{_BASE}, {_MA}, l AS (SELECT *, {_LIST} AS v FROM ma) SELECT symbol, t, round(list_min(v), 4) AS ribbon_min, round(list_max(v), 4) AS ribbon_max, round(list_max(v) - list_min(v), 4) AS width, round(list_avg(v), 4) AS mean, round(list_stddev_pop(v), 4) AS dispersion, len(list_filter(v, lambda x: x < close)) / 4 AS below FROM l".replace("list_stddev_pop(v)", "list_aggregate(v, 'stddev_pop')"))
def ribbon_stats(spark, sf_dir):
    rows = ribbon(spark, sf_dir).withColumn("v", F.filter("ma", lambda x: x.isNotNull()))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = safe_divide(total("v"), F.size("v"))
    rows = rows.withColumn("mean", mean)
    spread = F.sqrt(safe_divide(total(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean")))), F.size("v")))
    low, high = F.array_min("v"), F.array_max("v")
    return rows.select("symbol", "t", F.round(low, 4).alias("ribbon_min"), F.round(high, 4).alias("ribbon_max"), F.round(high - low, 4).alias("width"), F.round("mean", 4).alias("mean"), F.round(spread, 4).alias("dispersion"), (F.size(F.filter("v", lambda x: x < F.col("close"))) / F.lit(len(PERIODS))).alias("below"))


@query(f"{_BASE}, {_RANGE}, b AS (SELECT symbol, t, CASE WHEN lag(hi) OVER w IS NOT NULL THEN CAST(close > lag(hi) OVER w AS INT) END AS up, CASE WHEN lag(lo) OVER w IS NOT NULL THEN CAST(close < lag(lo) OVER w AS INT) END AS down FROM r {_W}) SELECT symbol, t, CAST({_full('sum(up)', 'up', 12)} AS BIGINT) AS ups, CAST({_full('sum(down)', 'down', 12)} AS BIGINT) AS downs FROM b")
def breakouts(spark, sf_dir):
    def made(df, w):
        df = df.withColumns({"up": (F.col("close") > F.lag("hi").over(w)).cast("int"), "down": (F.col("close") < F.lag("lo").over(w)).cast("int")})
        return df.withColumns({"ups": R.full("up", F.sum, w, 12), "downs": R.full("down", F.sum, w, 12)})

    return K.trailing(ranges(spark, sf_dir), KEY, "t", 13, made).select("symbol", "t", "ups", "downs")


@query(f"{_BASE}, {_MA} SELECT symbol, t, p AS period, round(v, 4) AS value, CAST(rank_ AS INT) AS place FROM (SELECT symbol, t, p, v, rank() OVER (PARTITION BY symbol, t ORDER BY v, p) - 1 AS rank_ FROM (SELECT symbol, t, unnest([{', '.join(map(str, PERIODS))}]) AS p, unnest([{', '.join(f'round(m{p}, 6)' for p in PERIODS)}]) AS v FROM ma) WHERE v IS NOT NULL)")
def unpivot_panel(spark, sf_dir):
    rows = ribbon(spark, sf_dir).select("symbol", "t", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.round(f"m{p}", 6).alias("v")) for p in PERIODS))).alias("x")).where("x.v is not null")
    place = F.row_number().over(Window.partitionBy("symbol", "t").orderBy("x.v", "x.p")) - 1
    return rows.select("symbol", "t", F.col("x.p").alias("period"), F.round("x.v", 4).alias("value"), place.alias("place"))


# --- outcomes -----------------------------------------------------------------------------------------------------------

AHEAD = 6 * HOUR


def with_end(rows: DataFrame) -> DataFrame:
    """Adds the time of a symbol's last row: an aggregate of a row a symbol, joined back."""
    ends = rows.groupBy(F.col("symbol").alias("__s")).agg(F.max("t").alias("end"))
    return rows.join(ends, F.col("symbol").eqNullSafe(F.col("__s")), "left").drop("__s")


@query(f"{_BASE} SELECT symbol, t, count(*) OVER f AS f_n, max(high) OVER f - close AS max_delta, min(low) OVER f - close AS min_delta, greatest(0, max(high) OVER f - close) + 0 * (max(high) OVER f) AS mfe, greatest(0, close - min(low) OVER f) + 0 * (min(low) OVER f) AS mae, max({{'h': high, 't': t}}) OVER f AS best, last_value(close) OVER f - close AS change, t + {AHEAD} <= max(t) OVER (PARTITION BY symbol) AS complete FROM bars WINDOW f AS {_ahead(AHEAD)}".replace("max({'h': high, 't': t}) OVER f AS best", f"(SELECT max(x.t) FROM bars x WHERE x.symbol = bars.symbol AND x.t > bars.t AND x.t <= bars.t + {AHEAD} AND x.high = (SELECT max(y.high) FROM bars y WHERE y.symbol = bars.symbol AND y.t > bars.t AND y.t <= bars.t + {AHEAD})) - t AS t_high"))
def forward_extremes(spark, sf_dir):
    rows = with_end(R.forward_extremes(hourly(spark, sf_dir), KEY, "t", AHEAD))
    up, down = F.col("f_high") - F.col("close"), F.col("f_low") - F.col("close")
    complete = F.col("t") + AHEAD <= F.col("end")
    return rows.select("symbol", "t", "f_n", up.alias("max_delta"), down.alias("min_delta"), floored(up).alias("mfe"), floored(-down).alias("mae"), F.col("f_high_t").alias("t_high"), (F.col("f_close") - F.col("close")).alias("change"), complete.alias("complete"))


@query(f"{_BASE}, h AS (SELECT a.symbol, a.t, min(CASE WHEN b.high >= a.close + 3000 THEN b.t END) - a.t AS t_up, min(CASE WHEN b.low <= a.close - 3000 THEN b.t END) - a.t AS t_down FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.t > a.t AND b.t <= a.t + {AHEAD} GROUP BY a.symbol, a.t) SELECT symbol, t, t_up, t_down, CASE WHEN t_up IS NULL AND t_down IS NULL THEN 0 WHEN t_down IS NULL OR t_up < t_down THEN 1 WHEN t_up IS NULL OR t_down < t_up THEN -1 ELSE 2 END AS first FROM h")
def first_touch(spark, sf_dir):
    return R.first_touch(hourly(spark, sf_dir), KEY, "t", AHEAD, 3000).select("symbol", "t", "t_up", "t_down", "first")


_CONTEXT = "CAST(t // 3600 % 24 AS INT)"
_SESSION = f"CASE WHEN {_CONTEXT} < 8 THEN 'asia' WHEN {_CONTEXT} < 13 THEN 'london' WHEN {_CONTEXT} < 17 THEN 'london_ny_overlap' WHEN {_CONTEXT} < 22 THEN 'new_york' ELSE 'late' END"


def context(rows: DataFrame) -> DataFrame:
    hour = (F.floor(F.col("t") / HOUR) % 24).cast("int")
    return rows.withColumn("hour", hour).withColumn("session", session_of(hour)).withColumn("weekday", ((F.floor(F.col("t") / 86400) + 3) % 7).cast("int"))


@query(f"{_BASE} SELECT {_SESSION} AS session, {_CONTEXT} // 4 * 4 AS bucket, CAST((t // 86400 + 3) % 7 AS INT) AS weekday, count(*) AS n, CAST(sum(n) AS BIGINT) AS ticks FROM bars GROUP BY 1, 2, 3")
def session_context(spark, sf_dir):
    return context(hourly(spark, sf_dir)).groupBy("session", (F.floor(F.col("hour") / 4) * 4).cast("int").alias("bucket"), "weekday").agg(F.count("*").alias("n"), F.sum("n").alias("ticks"))


_WIDE = "high - low > 8000"


@query(f"{_BASE}, q AS (SELECT t, n >= 2 AS a, high > low AS b, close <> open AS c FROM bars) SELECT count(*) FILTER (NOT a) AS too_few, count(*) FILTER (a AND NOT b) AS no_range, count(*) FILTER (a AND b AND NOT c) AS unchanged, count(*) FILTER (a AND b AND c) AS eligible FROM q")
def eligibility_accounting(spark, sf_dir):
    reason = F.when(F.col("n") < 2, "too_few").when(F.col("high") <= F.col("low"), "no_range").when(F.col("close") == F.col("open"), "unchanged").otherwise("eligible")
    rows = hourly(spark, sf_dir).withColumn("reason", reason)
    return rows.agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("too_few", "no_range", "unchanged", "eligible")))


_EDGES = "e AS (SELECT quantile_cont(high - low, 0.3333) AS q1, quantile_cont(high - low, 0.6667) AS q2 FROM bars)"


def binned(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("range", F.col("high") - F.col("low"))
    edges = rows.agg(F.percentile("range", F.array(F.lit(0.3333), F.lit(0.6667))).alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", S.quantile_bins("range", ["q1", "q2"])).drop("q1", "q2")


_BINNED = f"{_EDGES}, binned AS (SELECT b.*, CASE WHEN high - low <= q1 THEN 0 WHEN high - low <= q2 THEN 1 ELSE 2 END AS bin, {_SESSION} AS session FROM bars b, e)"


@query(f"{_BASE}, {_BINNED} SELECT symbol, bin, count(*) AS n, min(high - low) AS low_edge, max(high - low) AS high_edge FROM binned GROUP BY symbol, bin")
def quantile_bins(spark, sf_dir):
    return binned(spark, sf_dir).groupBy("symbol", "bin").agg(F.count("*").alias("n"), F.min("range").alias("low_edge"), F.max("range").alias("high_edge"))


# --- episodes and controls ----------------------------------------------------------------------------------------------


@query(f"{_BASE}, e AS (SELECT symbol, t, sum(CASE WHEN t - p >= 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t) AS island FROM (SELECT symbol, t, lag(t) OVER w AS p FROM bars WHERE {_WIDE} {_W})) SELECT symbol, CAST(island AS BIGINT) AS island, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM e GROUP BY 1, 2")
def gap_islands(spark, sf_dir):
    return S.islands(hourly(spark, sf_dir).where(_WIDE), KEY, "t", 4 * HOUR).groupBy("symbol", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def _greedy(compare: str) -> str:
    return f"{_BASE}, ev AS (SELECT symbol, t, high - low AS range FROM bars WHERE {_WIDE}), g AS (SELECT symbol, min(t) AS t FROM ev GROUP BY symbol UNION ALL SELECT g.symbol, (SELECT min(ev.t) FROM ev WHERE ev.symbol = g.symbol AND ev.t {compare} g.t + 14400) FROM g WHERE g.t IS NOT NULL), st AS (SELECT * FROM g WHERE t IS NOT NULL)"


@query(f"{_greedy('>')} SELECT st.symbol, st.t AS start, max(ev.range) AS best, count(*) AS n FROM ev ASOF JOIN st ON ev.symbol = st.symbol AND ev.t >= st.t GROUP BY 1, 2")
def greedy_episodes(spark, sf_dir):
    events = hourly(spark, sf_dir).where(_WIDE).select("symbol", "t", (F.col("high") - F.col("low")).alias("range"))
    starts = S.greedy_starts(events, KEY, "t", 4 * HOUR, keep_equal=False)
    return B.asof(events, starts, KEY, "t", "start", []).groupBy("symbol", "start").agg(F.max("range").alias("best"), F.count("*").alias("n"))


@query(f"{_greedy('>=')} SELECT symbol, t AS start FROM st")
def separation_thinning(spark, sf_dir):
    return S.greedy_starts(hourly(spark, sf_dir).where(_WIDE), KEY, "t", 4 * HOUR, keep_equal=True)


@query(f"{_BASE} SELECT symbol, t FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bars e WHERE e.symbol = b.symbol AND e.high - e.low > 9500 AND b.t >= e.t - 3600 - 7200 AND b.t < e.t + 1800 + 3600)")
def purge_anti_join(spark, sf_dir):
    """Bars away from wide ones: an hour of purge, two hours of looking ahead, and an event that lasts half an hour."""
    rows = hourly(spark, sf_dir)
    events = rows.where("high - low > 9500").select("symbol", F.col("t").alias("start"), (F.col("t") + 1800).alias("end"))
    return S.outside(rows.select("symbol", "t"), S.purge_spans(events, KEY, "start", "end", HOUR, 2 * HOUR), KEY, "t")


@query(f"{_BASE} SELECT symbol, count(*) AS pool FROM bars WHERE (symbol, t) NOT IN (SELECT symbol, t FROM bars WHERE {_WIDE}) GROUP BY symbol")
def risk_set_pool(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return rows.join(rows.where(_WIDE).select("symbol", "t"), ["symbol", "t"], "left_anti").groupBy("symbol").agg(F.count("*").alias("pool"))


@query(f"{_BASE}, c AS (SELECT *, {_SESSION} AS session FROM bars), ev AS (SELECT symbol, session, t AS event_t, row_number() OVER (PARTITION BY symbol, session ORDER BY t) - 1 AS e FROM c WHERE high - low > 9500), pool AS (SELECT symbol, session, t AS pool_t, row_number() OVER (PARTITION BY symbol, session ORDER BY md5('7|' || t), t) - 1 AS r, count(*) OVER (PARTITION BY symbol, session) AS size FROM c WHERE high - low <= 9500), a AS (SELECT ev.*, s.size, unnest(range(least(3, s.size))) AS slot FROM ev JOIN (SELECT DISTINCT symbol, session, size FROM pool) s USING (symbol, session)) SELECT a.symbol, a.session, a.event_t, CAST(a.slot AS INT) AS slot, pool.pool_t FROM a JOIN pool ON a.symbol = pool.symbol AND a.session = pool.session AND (a.e * 3 + a.slot) % a.size = pool.r")
def matched_controls(spark, sf_dir):
    rows = context(hourly(spark, sf_dir))
    wide = F.col("high") - F.col("low") > 9500
    events = rows.where(wide).select("symbol", "session", F.col("t").alias("event_t"))
    return S.matched_controls(events, rows.where(~wide).select("symbol", "session", F.col("t").alias("pool_t")), ["symbol", "session"], "event_t", "pool_t", 3, 7)


@query(f"{_BASE}, r AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY md5('11|' || t), t) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, t FROM r WHERE r <= round_even(n * 0.1, 0)")
def stratified_sample(spark, sf_dir):
    return S.stratified(hourly(spark, sf_dir), "symbol", 0.1, "t", 11).select("symbol", "t")


@query(f"{_BASE}, {_BINNED}, s AS (SELECT session, count(*) FILTER ({_WIDE}) / sum(count(*) FILTER ({_WIDE})) OVER () AS a, count(*) FILTER (NOT ({_WIDE})) / sum(count(*) FILTER (NOT ({_WIDE}))) OVER () AS b FROM binned GROUP BY session) SELECT session, round(a, 6) AS events, round(b, 6) AS others, round(abs(a - b), 6) AS gap FROM s")
def category_balance(spark, sf_dir):
    counts = context(hourly(spark, sf_dir)).groupBy("session").agg(F.count_if(F.expr(_WIDE)).alias("a"), F.count_if(~F.expr(_WIDE)).alias("b"))
    everything = Window.partitionBy()
    a, b = (F.coalesce(F.try_divide(F.col(c), F.sum(c).over(everything)), F.lit(float("nan"))) for c in ("a", "b"))  # SQL's 0 / 0
    return counts.select("session", F.round(a, 6).alias("events"), F.round(b, 6).alias("others"), F.round(F.abs(a - b), 6).alias("gap"))


@query(f"{_BASE} SELECT symbol, round((avg(close) FILTER ({_WIDE}) - avg(close) FILTER (NOT ({_WIDE}))) / nullif(sqrt((var_pop(close) FILTER ({_WIDE}) + var_pop(close) FILTER (NOT ({_WIDE}))) / 2), 0), 6) AS smd FROM bars GROUP BY symbol")
def smd(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("symbol").agg(F.round(S.mean_difference(F.expr(_WIDE), "close"), 6).alias("smd"))


@query(f"{_BASE}, o AS (SELECT symbol, session, bin = 2 AS st, close > open AS hit FROM binned), c AS (SELECT symbol, session, count(*) FILTER (st) AS s, count(*) FILTER (NOT st) AS o, count(*) FILTER (NOT st AND hit) AS hits, count(*) FILTER (st AND hit) AS own FROM o GROUP BY 1, 2) SELECT round(sum(own) / sum(s), 6) AS state_rate, round(sum(s * hits / nullif(o, 0)) FILTER (s > 0 AND o > 0) / sum(s) FILTER (s > 0 AND o > 0), 6) AS baseline, round(sum(s) FILTER (s > 0 AND o > 0) / sum(s), 6) AS covered, count(*) FILTER (s > 0 AND o > 0) AS cells FROM c".replace("o AS (SELECT symbol", f"{_BINNED}, o AS (SELECT symbol", 1))
def direct_standardisation(spark, sf_dir):
    rows = context(binned(spark, sf_dir)).select("symbol", "session", (F.col("bin") == 2).alias("st"), (F.col("close") > F.col("open")).cast("int").alias("hit"))
    out = S.direct_standardisation(rows, "st", ["symbol", "session"], "hit")
    return out.select(*(F.round(c, 6).alias(c) for c in ("state_rate", "baseline", "covered")), "cells")


@query(f"{_BASE} SELECT symbol, count(*) AS n, round(avg(close - open), 6) AS mean, round(avg(abs(close - open)), 6) AS mean_abs, round(stddev_pop(close - open), 6) AS std, round(quantile_cont(close - open, 0.05), 6) AS q05, round(quantile_cont(close - open, 0.5), 6) AS q50, round(quantile_cont(close - open, 0.95), 6) AS q95 FROM bars GROUP BY symbol")
def distribution_quantiles(spark, sf_dir):
    x = F.col("close") - F.col("open")
    q = F.percentile(x, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return hourly(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.avg(F.abs(x)), 6).alias("mean_abs"), F.round(F.stddev_pop(x), 6).alias("std"), *(F.round(q[i], 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))))


@query(f"{_BASE}, a AS (SELECT symbol, close > open AS up, {_WIDE} AS wide FROM bars) SELECT symbol, count(*) FILTER (wide) AS n, round(avg(up::INT) FILTER (wide), 6) AS rate, round(avg(up::INT) FILTER (NOT wide), 6) AS other_rate, round(100 * (avg(up::INT) FILTER (wide) - avg(up::INT) FILTER (NOT wide)), 6) AS diff_pp, count(*) FILTER (wide) >= 30 AS enough FROM a GROUP BY symbol")
def rate_compare(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("symbol", (F.col("close") > F.col("open")).cast("int").alias("up"), F.expr(_WIDE).alias("wide"))
    one, two = F.avg(F.when(F.col("wide"), F.col("up"))), F.avg(F.when(~F.col("wide"), F.col("up")))
    return rows.groupBy("symbol").agg(F.count_if("wide").alias("n"), F.round(one, 6).alias("rate"), F.round(two, 6).alias("other_rate"), F.round(100 * (one - two), 6).alias("diff_pp"), (F.count_if("wide") >= 30).alias("enough"))


# --- calendar and tape --------------------------------------------------------------------------------------------------


@query(f"{_BASE}, s AS (SELECT symbol, unnest(range(min(t), max(t) + 1, 3600)) AS t FROM bars GROUP BY symbol) SELECT symbol, t // 86400 AS day, count(*) AS missing FROM s ANTI JOIN bars USING (symbol, t) GROUP BY 1, 2")
def calendar_gaps(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    slots = rows.groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("symbol", F.explode(F.sequence("a", "b", F.lit(HOUR).cast("long"))).alias("t"))
    return slots.join(rows.select("symbol", "t"), ["symbol", "t"], "left_anti").groupBy("symbol", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("missing"))


_QUOTES = "quotes AS (SELECT ts, s, event_id, CASE WHEN symbol = 'view' THEN p END AS bid, CASE WHEN symbol = 'click' THEN p END AS ask FROM tape WHERE symbol IN ('view', 'click')), book AS (SELECT *, last_value(bid IGNORE NULLS) OVER q AS bid_now, last_value(ask IGNORE NULLS) OVER q AS ask_now, max(CASE WHEN bid IS NOT NULL THEN s END) OVER q AS bid_t, max(CASE WHEN ask IS NOT NULL THEN s END) OVER q AS ask_t FROM quotes WINDOW q AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"


def book(spark, sf_dir):
    side = lambda name: F.when(F.col("symbol") == name, F.col("p"))
    quotes = tape(spark, sf_dir).where("symbol in ('view', 'click')").select(F.lit("pair").alias("symbol"), "ts", "s", "event_id", side("view").alias("bid"), side("click").alias("ask"))
    return T.quote_book(quotes, KEY, ["ts", "event_id"], "s", "bid", "ask")


@query(f"WITH {_TAPE}, {_QUOTES} SELECT event_id, bid_now, ask_now, ask_now - bid_now AS spread, coalesce(s - bid_t > 600, false) OR coalesce(s - ask_t > 600, false) AS stale FROM book")
def quote_forward_fill(spark, sf_dir):
    return book(spark, sf_dir).select("event_id", "bid_now", "ask_now", (F.col("ask_now") - F.col("bid_now")).alias("spread"), T.stale("s", 600).alias("stale"))


_SPREAD = "CAST(least(abs(ask_now - bid_now), 20000) // 100 AS BIGINT)"


def spreads(spark, sf_dir):
    wide = F.abs(F.col("ask_now") - F.col("bid_now"))
    return book(spark, sf_dir).where(wide.isNotNull()).withColumn("bucket", F.floor(F.least(wide, F.lit(20000)) / 100)).withColumn("hour", (F.floor(F.col("s") / HOUR) % 24).cast("int"))


@query(f"WITH {_TAPE}, {_QUOTES} SELECT {_SPREAD} AS bucket, CAST(s // 3600 % 24 AS INT) AS hour, count(*) AS n FROM book WHERE ask_now - bid_now IS NOT NULL GROUP BY GROUPING SETS ((1), (1, 2))")
def spread_histogram(spark, sf_dir):
    rows = spreads(spark, sf_dir)
    return rows.groupingSets([["bucket"], ["bucket", "hour"]], "bucket", "hour").agg(F.count("*").alias("n"))


@query(f"WITH {_TAPE}, {_QUOTES} SELECT CAST(quantile_disc({_SPREAD}, 0.95) AS BIGINT) AS value FROM book WHERE ask_now - bid_now IS NOT NULL")
def hist_quantile_disc(spark, sf_dir):
    return T.histogram_quantile(spreads(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n", 0.95)


@query(f"WITH {_TAPE} SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM tape GROUP BY s)) AS same_time, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM tape GROUP BY symbol, s, p)) AS same_row")
def duplicate_ticks(spark, sf_dir):
    return T.duplicates(tape(spark, sf_dir), "s", ["symbol", "s", "p"])


@query(f"WITH {_TAPE}, j AS (SELECT symbol, event_id, ts, abs(p - lag(p) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS step FROM tape) SELECT symbol, event_id, step FROM j WHERE step IS NOT NULL ORDER BY step DESC, symbol, ts, event_id LIMIT 200")
def jump_topk(spark, sf_dir):
    return T.step_topk(tape(spark, sf_dir), KEY, "s", ["ts", "event_id"], "p", 200).select("symbol", "event_id", "step")


@query(f"WITH {_TAPE}, j AS (SELECT symbol, event_id, ts, abs(s - lag(s) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS step FROM tape) SELECT symbol, event_id, step FROM j WHERE step IS NOT NULL ORDER BY step DESC, symbol, ts, event_id LIMIT 200")
def gap_topk(spark, sf_dir):
    return T.step_topk(tape(spark, sf_dir), KEY, "s", ["ts", "event_id"], "s", 200).select("symbol", "event_id", "step")


@query(f"WITH {_TAPE} SELECT symbol, s // 86400 AS day, count(*) AS n, min(s) AS first_s, max(s) AS last_s, median(p) AS median_p, quantile_disc(p, 0.95) AS p95 FROM tape GROUP BY 1, 2")
def daily_coverage(spark, sf_dir):
    return tape(spark, sf_dir).groupBy("symbol", F.floor(F.col("s") / 86400).alias("day")).agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.median("p").alias("median_p"), F.expr("percentile_disc(0.95) within group (order by p)").cast("long").alias("p95"))


@query(f"WITH {_TAPE} SELECT CAST((s // 86400 + 3) // 7 AS BIGINT) AS week, min(s) AS first_s, max(s) AS last_s, count(*) AS n FROM tape GROUP BY 1")
def weekly_sessions(spark, sf_dir):
    return tape(spark, sf_dir).groupBy(F.floor((F.floor(F.col("s") / 86400) + 3) / 7).alias("week")).agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.count("*").alias("n"))


@query(f"WITH {_TAPE}, d AS (SELECT 'day' AS unit, s // 86400 AS k, count(*) AS n FROM tape GROUP BY 2 UNION ALL SELECT 'hour', s // 3600, count(*) FROM tape GROUP BY 2 UNION ALL SELECT 'minute', s // 60, count(*) FROM tape GROUP BY 2) SELECT unit, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most FROM d GROUP BY unit")
def density(spark, sf_dir):
    rows = tape(spark, sf_dir)
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.floor(F.col("s") / n).alias("k")) for u, n in (("day", 86400), ("hour", 3600), ("minute", 60))))
    counts = rows.select(F.inline(units)).groupBy("unit", "k").agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return counts.groupBy("unit").agg(*(F.round(q[i], 6).alias(n) for i, n in enumerate(("p05", "median", "p95"))), F.max("n").alias("most"))


@query(f"WITH {_TAPE}, a AS (SELECT symbol, min(s) AS lo, max(s) AS hi FROM tape GROUP BY symbol) SELECT x.symbol AS a, y.symbol AS b, greatest(0, least(x.hi, y.hi) - greatest(x.lo, y.lo)) AS overlap, greatest(0, y.lo - x.lo) AS head FROM a x JOIN a y ON x.symbol < y.symbol")
def interval_overlap(spark, sf_dir):
    spans = tape(spark, sf_dir).groupBy("symbol").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    x, y = spans.alias("x"), spans.alias("y")
    return x.join(y, F.col("x.symbol") < F.col("y.symbol")).select(F.col("x.symbol").alias("a"), F.col("y.symbol").alias("b"), F.greatest(F.lit(0), F.least("x.hi", "y.hi") - F.greatest("x.lo", "y.lo")).alias("overlap"), F.greatest(F.lit(0), F.col("y.lo") - F.col("x.lo")).alias("head"))


@query(f"{_BASE}, c AS (SELECT count(*) AS rows, count(*) FILTER (close <= 0) AS non_positive, count(*) FILTER (high < low OR open > high OR close < low) AS invalid, count(*) FILTER (open IS NULL) AS nulls, count(*) - count(DISTINCT (symbol, t)) AS duplicates FROM bars) SELECT unnest(['rows', 'non_positive', 'invalid', 'nulls', 'duplicates']) AS name, CAST(unnest([rows, non_positive, invalid, nulls, duplicates]) AS VARCHAR) AS value FROM c".replace(" AS name", " AS \"check\""))
def audit_checks(spark, sf_dir):
    one = hourly(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(F.col("close") <= 0).alias("non_positive"), F.count_if(F.expr("high < low or open > high or close < low")).alias("invalid"), F.count_if(F.col("open").isNull()).alias("nulls"), (F.count("*") - F.count_distinct("symbol", "t")).alias("duplicates"))
    return one.unpivot([], ["rows", "non_positive", "invalid", "nulls", "duplicates"], "check", "v").select("check", F.col("v").cast("string").alias("value"))
