"""Registered queries of features within and between timeframes, of states, and of the validation of series. See plans/queries.py for the
tables they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_divide
from tidemark.operators import bars as B
from tidemark.operators import blocks as K
from tidemark.operators import features as X
from tidemark.operators import rolling as R
from tidemark.operators import studies as S
from tidemark.operators import validation as V
from tidemark.plans.queries import _BASE, _TAPE, _W, HOUR, KEY, PERIODS, _bars, _each, _full, hourly, query, with_end

TREND, AVERAGE = 0.5, f"m{PERIODS[1]}"
_MS = [f"m{p}" for p in PERIODS]


def timeframe(spark, sf_dir, hours):
    return X.timeframe_features(hourly(spark, sf_dir, hours), KEY, PERIODS)


def _last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_HELD = _each("CAST(m{a} - m{b} IS NOT NULL AS INT)")
_TURN = "CAST(sign(round(m{a} - m{b}, 6)) AS INT) AS s{a}_{b}, CAST(lag(sign(round(m{a} - m{b}, 6))) OVER w AS INT) AS p{a}_{b}"
_UPS = _each("coalesce(CAST(s{a}_{b} > 0 AND p{a}_{b} <= 0 AS INT), 0)")
_DOWNS = _each("coalesce(CAST(s{a}_{b} < 0 AND p{a}_{b} >= 0 AS INT), 0)")


def _features(tag: str, hours: int) -> str:
    """The chain of table expressions that ends in {tag}_f."""
    return f"""{_bars(hours, tag)},
{tag}_x AS (SELECT symbol, t, c_t, high, low, close, row_number() OVER w AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM {tag} {_W}),
{tag}_a AS (SELECT symbol, t, rn, CAST(tr AS DOUBLE) AS a FROM {tag}_x WHERE rn = 1 UNION ALL SELECT x.symbol, x.t, x.rn, (1.0 / 14) * x.tr + (1 - 1.0 / 14) * y.a FROM {tag}_a y JOIN {tag}_x x ON x.symbol = y.symbol AND x.rn = y.rn + 1),
{tag}_b AS (SELECT x.symbol, x.t, x.c_t, x.high, x.low, x.close, CASE WHEN x.rn >= 14 AND y.a > 0 THEN y.a END AS atr FROM {tag}_x x JOIN {tag}_a y ON x.symbol = y.symbol AND x.rn = y.rn),
{tag}_m AS (SELECT symbol, t, c_t, close, atr, {", ".join(f"{_full('avg(close)', 'close', p)} AS m{p}" for p in PERIODS)}, {_full("max(high)", "high", 12)} - {_full("min(low)", "low", 12)} AS range FROM {tag}_b),
{tag}_s AS (SELECT *, range / atr AS range_atr, greatest({", ".join(_MS)}) - least({", ".join(_MS)}) AS width, {_each(_TURN, ", ")}, ({AVERAGE} - lag({AVERAGE}, 3) OVER w) / 3.0 / atr AS slope_atr,
  ({_each("coalesce(CAST(m{a} - m{b} > 1e-9 AS INT), 0)")}) / nullif({_HELD}, 0) - ({_each("coalesce(CAST(m{a} - m{b} < -1e-9 AS INT), 0)")}) / nullif({_HELD}, 0) AS score,
  CASE WHEN atr IS NOT NULL THEN ({_each("coalesce(CAST(abs(m{a} - m{b}) < atr * 0.25 AS INT), 0)")}) / nullif({_HELD}, 0) END AS entangled FROM {tag}_m {_W}),
{tag}_k AS (SELECT *, width / atr AS width_atr, {_UPS} + {_DOWNS} AS crossed, {_UPS} - ({_DOWNS}) AS net, list(range_atr) FILTER (range_atr IS NOT NULL) {_last(50)} AS held FROM {tag}_s),
{tag}_p AS (SELECT *, CASE WHEN range_atr IS NOT NULL AND len(held) >= 10 THEN (len(list_filter(held, lambda x: x < range_atr)) + (len(list_filter(held, lambda x: x = range_atr)) + 1) / 2) / len(held) END AS pct FROM {tag}_k),
{tag}_f AS (SELECT *, {_full("sum(crossed)", "crossed", 12)} AS cross_count, pct <= 0.2 AS compressed, pct >= 0.8 AS expanded FROM {tag}_p)"""


_HOUR = f"WITH RECURSIVE {_TAPE}, {_features('one', 1)}"


@query(f"{_HOUR} SELECT symbol, t, round(atr, 4) + 0.0 AS atr, round(score, 6) + 0.0 AS score, round(entangled, 6) + 0.0 AS entangled, round(width_atr, 4) + 0.0 AS width_atr, round(slope_atr, 4) + 0.0 AS slope_atr, crossed, net, CAST(cross_count AS BIGINT) AS cross_count, round(pct, 6) + 0.0 AS pct, compressed, expanded FROM one_f")
def timeframe_features(spark, sf_dir):
    rounded = [F.round(c, n).alias(c) for c, n in (("atr", 4), ("score", 6), ("entangled", 6), ("width_atr", 4), ("slope_atr", 4))]
    return timeframe(spark, sf_dir, 1).select("symbol", "t", *rounded, "crossed", "net", "cross_count", F.round("pct", 6).alias("pct"), "compressed", "expanded")


@query(f"{_HOUR} SELECT symbol, t, {', '.join(f'round(close - m{p}, 4) AS dist_{p}, round((close - m{p}) / atr, 4) AS dist_atr_{p}' for p in PERIODS)} FROM one_f")
def price_distances(spark, sf_dir):
    dist = lambda p: F.col("close") - F.col(f"m{p}")
    both = [x for p in PERIODS for x in (F.round(dist(p), 4).alias(f"dist_{p}"), F.round(safe_divide(dist(p), F.col("atr")), 4).alias(f"dist_atr_{p}"))]
    return timeframe(spark, sf_dir, 1).select("symbol", "t", *both)


@query(f"{_HOUR} SELECT symbol, t, ({' + '.join(f'coalesce(CAST(m{p} < close AS INT), 0)' for p in PERIODS)}) / {len(PERIODS)} AS below, round((close - least({', '.join(_MS)})) / nullif(width, 0), 6) + 0.0 AS position, round(width - lag(width, 3) OVER w, 4) + 0.0 AS width_change, round((width_atr - lag(width_atr, 3) OVER w) / 3.0, 4) + 0.0 AS expansion FROM one_f {_W}")
def price_in_ribbon(spark, sf_dir):
    below = sum((F.coalesce((F.col(m) < F.col("close")).cast("int"), F.lit(0)) for m in _MS), F.lit(0)) / len(_MS)
    place = safe_divide(F.col("close") - F.least(*_MS), F.col("width"))

    def made(df, w):
        change = lambda c: F.col(c) - F.lag(c, 3).over(w)
        return df.withColumns({"width_change": F.round(change("width"), 4), "expansion": F.round(change("width_atr") / 3.0, 4)})

    rows = K.trailing(timeframe(spark, sf_dir, 1).select("symbol", "t", "close", "width", "width_atr", *_MS), KEY, "t", 3, made)
    return rows.select("symbol", "t", below.alias("below"), F.round(place, 6).alias("position"), "width_change", "expansion")


_ALIGN = f"WITH RECURSIVE {_TAPE}, {_features('one', 1)}, {_features('four', 4)}, aligned AS (SELECT lo.symbol, lo.t, lo, hi FROM one_f lo ASOF LEFT JOIN four_f hi ON lo.symbol = hi.symbol AND lo.c_t >= hi.c_t)"
_BETWEEN = {
    "value_dist": (f"lo.{AVERAGE} - hi.{AVERAGE}", 4), "value_dist_atr": (f"(lo.{AVERAGE} - hi.{AVERAGE}) / lo.atr", 4), "slope_diff_atr": ("lo.slope_atr - hi.slope_atr", 4),
    "price_dist": (f"lo.close - hi.{AVERAGE}", 4), "price_dist_atr": (f"(lo.close - hi.{AVERAGE}) / hi.atr", 4), "agreement": ("CAST(sign(lo.score) AS DOUBLE) * sign(hi.score)", 6), "score_diff": ("lo.score - hi.score", 6),
    "entangled_diff": ("lo.entangled - hi.entangled", 6), "width_ratio": ("lo.width_atr / nullif(hi.width_atr, 0)", 4), "density_ratio": ("CAST(lo.cross_count AS DOUBLE) / nullif(hi.cross_count, 0)", 6),
    "compressed_in_trend": (f"CASE WHEN lo.compressed IS NOT NULL AND hi.score IS NOT NULL THEN lo.compressed AND abs(hi.score) >= {TREND} END", None),
    "expanding_in_compression": ("CASE WHEN lo.expanded IS NOT NULL AND hi.compressed IS NOT NULL THEN lo.expanded AND hi.compressed END", None),
    "both_compressed": ("CASE WHEN lo.compressed IS NOT NULL AND hi.compressed IS NOT NULL THEN lo.compressed AND hi.compressed END", None),
    "bull_in_bear": ("CASE WHEN lo.score IS NOT NULL AND hi.score IS NOT NULL THEN lo.score > 0 AND hi.score < 0 END", None),
}


def aligned_features(spark, sf_dir):
    """symbol, t, c_t and both timeframes' features as structs: the higher one as of the lower one's close."""
    lo, hi = timeframe(spark, sf_dir, 1), timeframe(spark, sf_dir, 4)
    ours = lo.select("symbol", "t", "c_t", F.struct(*lo.columns).alias("lo"))
    theirs = hi.select("symbol", F.col("c_t").alias("hi_t"), F.struct(*hi.columns).alias("hi"))
    return B.asof(ours, theirs, KEY, "c_t", "hi_t", ["hi"])


@query(f"{_ALIGN} SELECT symbol, t, {', '.join(f'{x} AS {n}' if d is None else f'round({x}, {d}) + 0.0 AS {n}' for n, (x, d) in _BETWEEN.items())} FROM aligned")
def cross_timeframe_features(spark, sf_dir):
    made = X.between("lo", "hi", AVERAGE, TREND)
    return aligned_features(spark, sf_dir).select("symbol", "t", *(made[n].alias(n) if d is None else F.round(made[n], d).alias(n) for n, (_, d) in _BETWEEN.items()))


_SCORES = "list_filter([lo.score, hi.score], lambda x: x IS NOT NULL)"
_COMPRESSED = "coalesce(CAST(lo.compressed AS INT), 0) + coalesce(CAST(hi.compressed AS INT), 0)"


@query(f"{_ALIGN}, v AS (SELECT symbol, t, {_SCORES} AS s, {_COMPRESSED} AS n, lo.compressed IS NULL AND hi.compressed IS NULL AS none FROM aligned) SELECT symbol, t, CASE WHEN len(s) > 0 THEN CAST(len(list_filter(s, lambda x: x > 0)) AS INT) END AS bullish, CASE WHEN len(s) > 0 THEN CAST(len(list_filter(s, lambda x: x < 0)) AS INT) END AS bearish, CASE WHEN NOT none THEN n END AS n_compressed, round(list_stddev_pop(s), 6) AS disagreement, round(list_avg(s), 6) AS mean_score FROM v")
def across_timeframes(spark, sf_dir):
    made = X.across(["lo", "hi"])
    return aligned_features(spark, sf_dir).select("symbol", "t", *(made[n].alias(n) for n in ("bullish", "bearish", "n_compressed")), *(F.round(made[n], 6).alias(n) for n in ("disagreement", "mean_score")))


def _state_sql() -> str:
    out = []
    for word, sign in (("up", 1), ("down", -1)):
        cross, aligned = f"lo.net * {sign} > 0", f"hi.score * {sign} >= {TREND}"
        tests = {"crossing": cross, "compression": "lo.compressed", "compression_crossing": f"lo.compressed AND {cross}", "compression_higher": f"lo.compressed AND {aligned}", "compression_crossing_higher": f"lo.compressed AND {cross} AND {aligned}"}
        out += [f"SELECT symbol, '{n}_{word}' AS state, count(*) AS rows, count(*) FILTER ({x}) AS n, round(count(*) FILTER ({x}) / count(*), 6) AS share FROM aligned GROUP BY symbol" for n, x in tests.items()]
    return " UNION ALL ".join(out)


@query(f"{_ALIGN} {_state_sql()}")
def state_shares(spark, sf_dir):
    tests = X.states(F.col("lo.compressed"), F.col("lo.net"), F.col("hi.score"), TREND)
    counts = aligned_features(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("rows"), *(F.count_if(x).alias(n) for n, x in tests.items()))
    return counts.unpivot(["symbol", "rows"], list(tests), "state", "n").select("symbol", "state", "rows", "n", F.round(F.col("n") / F.col("rows"), 6).alias("share"))


_NUMBERED = f"{_BASE}, x AS (SELECT symbol, t, close, row_number() OVER w AS rn FROM bars {_W}), y AS (SELECT symbol, t, rn, CAST(close AS DOUBLE) AS e5, CAST(close AS DOUBLE) AS e20 FROM x WHERE rn = 1 UNION ALL SELECT x.symbol, x.t, x.rn, (2.0 / 6) * x.close + (1 - 2.0 / 6) * y.e5, (2.0 / 21) * x.close + (1 - 2.0 / 21) * y.e20 FROM y JOIN x ON x.symbol = y.symbol AND x.rn = y.rn + 1)"
_KINDS = f"{_NUMBERED}, k AS (SELECT x.symbol, x.t, CASE WHEN x.rn >= 5 THEN e5 END AS e5, CASE WHEN x.rn >= 20 THEN e20 END AS e20, x.close FROM x JOIN y ON x.symbol = y.symbol AND x.rn = y.rn), m AS (SELECT symbol, t, e5, e20, {_full('avg(close)', 'close', 5)} AS m5, {_full('avg(close)', 'close', 20)} AS m20 FROM k), d AS (SELECT symbol, t, sign(round(e5 - m5, 6)) AS a, sign(round(e20 - m20, 6)) AS b FROM m)"


@query(f"{_KINDS} SELECT symbol, t, coalesce(CAST(a * lag(a) OVER w < 0 AS INT), 0) + coalesce(CAST(b * lag(b) OVER w < 0 AS INT), 0) AS crossed, (coalesce(CAST(a > 0 AS INT), 0) + coalesce(CAST(b > 0 AS INT), 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0) AS above FROM d {_W}")
def average_kinds(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("symbol", "t", F.col("close").cast("double").alias("x"))
    rows = R.recurrences(rows, KEY, "t", "x", {"e5": (2 / 6, 5), "e20": (2 / 21, 20)})

    def made(df, w):
        df = df.withColumns({f"m{n}": R.full("x", F.avg, w, n) for n in (5, 20)})
        return df.withColumn("crossed", X.average_kinds_crossed(["e5", "e20"], ["m5", "m20"], w))

    rows = K.trailing(rows, KEY, "t", 21, made)
    sides = [F.signum(F.round(F.col(f"e{n}") - F.col(f"m{n}"), 6)) for n in (5, 20)]
    count = lambda tests: sum((F.coalesce(x.cast("int"), F.lit(0)) for x in tests), F.lit(0))
    above = safe_divide(count([s > 0 for s in sides]), count([s.isNotNull() for s in sides]))
    return rows.select("symbol", "t", "crossed", above.alias("above"))


# --- outcomes over a grid -----------------------------------------------------------------------------------------------

HORIZONS, THRESHOLDS = (2 * HOUR, 6 * HOUR), (1000, 3000)


def _horizon(h: int) -> str:
    ahead = f"OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    grid = " UNION ALL ".join(f"SELECT {h} AS horizon, {d} AS threshold, count(*) AS rows, count(*) FILTER (complete) AS complete, count(*) FILTER (complete AND n = 0) AS empty, count(*) FILTER (up >= {d}) AS ups, count(*) FILTER (down <= -{d}) AS downs, count(*) FILTER (up >= {d} AND down <= -{d}) AS both, round(avg(greatest(up, -down)), 3) AS mean_move, round(median(greatest(up, -down)), 3) AS median_move FROM h" for d in THRESHOLDS)
    return f"(WITH h AS (SELECT symbol, t, count(*) {ahead} AS n, max(high) {ahead} - close AS up, min(low) {ahead} - close AS down, t + {h} <= max(t) OVER (PARTITION BY symbol) AS complete FROM bars) {grid})"


@query(f"{_BASE} {' UNION ALL '.join(f'SELECT * FROM {_horizon(h)}' for h in HORIZONS)}")
def outcome_summary(spark, sf_dir):
    """All horizons share one pass over the bars; the grid is one exploded aggregate."""

    def made(df, w):
        cells = []
        for h in HORIZONS:
            ahead = w.rangeBetween(1, h)
            cells.append(F.struct(F.lit(h).alias("horizon"), F.count("*").over(ahead).alias("n"), (F.max("high").over(ahead) - F.col("close")).alias("up"), (F.min("low").over(ahead) - F.col("close")).alias("down"), (F.col("t") + h <= F.col("end")).alias("complete")))
        return df.withColumn("cells", F.array(*cells))

    rows = with_end(hourly(spark, sf_dir).select("symbol", "t", "high", "low", "close"))
    rows = K.ahead(rows, KEY, "t", max(HORIZONS), made).select(F.inline("cells")).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    up, down, move = F.col("up") >= F.col("threshold"), F.col("down") <= -F.col("threshold"), F.greatest(F.col("up"), -F.col("down"))
    return rows.groupBy("horizon", "threshold").agg(
        F.count("*").alias("rows"), F.count_if("complete").alias("complete"), F.count_if(F.col("complete") & (F.col("n") == 0)).alias("empty"), F.count_if(up).alias("ups"), F.count_if(down).alias("downs"),
        F.count_if(up & down).alias("both"), F.round(F.avg(move), 3).alias("mean_move"), F.round(F.median(move), 3).alias("median_move"),
    )


@query(f"{_HOUR}, v AS (SELECT close > lag(close) OVER w AS up, atr, score, entangled, width_atr, slope_atr FROM one_f {_W}), u AS (UNPIVOT v ON atr, score, entangled, width_atr, slope_atr INTO NAME feature VALUE x), d AS (SELECT feature, avg(x) FILTER (up) - avg(x) FILTER (NOT up) AS gap, sqrt((var_pop(x) FILTER (up) + var_pop(x) FILTER (NOT up)) / 2) AS pooled FROM u GROUP BY feature), e AS (SELECT CASE WHEN feature IN ('atr', 'width_atr') THEN 'width' ELSE 'order' END AS family, CASE WHEN gap = 0 THEN 0.0 WHEN pooled > 0 THEN gap / pooled END AS smd FROM d) SELECT family, count(*) AS n, round(avg(abs(smd)), 4) AS mean_abs, round(max(abs(smd)), 4) AS max_abs, round(100 * avg(CAST(abs(smd) > 0.2 AS INT)), 4) AS large FROM e GROUP BY family")
def feature_family_balance(spark, sf_dir):
    """Long form: one aggregate whatever the number of features."""
    rows = K.previous(timeframe(spark, sf_dir, 1), KEY, "t", ["t"], {"past": F.col("close")}).withColumn("up", F.col("close") > F.col("past"))
    names = ["atr", "score", "entangled", "width_atr", "slope_atr"]
    long = rows.unpivot(["up"], names, "feature", "x").groupBy("feature").agg(S.mean_difference(F.col("up"), "x").alias("smd"))
    family, size = F.when(F.col("feature").isin("atr", "width_atr"), "width").otherwise("order"), F.abs("smd")
    return long.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.round(F.avg(size), 4).alias("mean_abs"), F.round(F.max(size), 4).alias("max_abs"), F.round(100 * F.avg((size > 0.2).cast("int")), 4).alias("large"))


@query(f"{_HOUR}, c AS (SELECT symbol, t, crossed, t - lag(t) OVER w >= 14400 AS far FROM one_f WHERE crossed > 0 {_W}) SELECT symbol, CAST(sum(crossed) AS BIGINT) AS events, count(*) AS times, count(*) FILTER (far) + 1 AS episodes FROM c GROUP BY symbol")
def crossing_summary(spark, sf_dir):
    rows = S.islands(timeframe(spark, sf_dir, 1).where("crossed > 0"), KEY, "t", 4 * HOUR)
    return rows.groupBy("symbol").agg(F.sum("crossed").alias("events"), F.count("*").alias("times"), F.countDistinct("island").alias("episodes"))


# --- validation ---------------------------------------------------------------------------------------------------------


@query(f"{_BASE}, g AS (SELECT symbol, t, t - lag(t) OVER w AS step FROM bars {_W}) SELECT symbol, count(*) AS rows, count(*) FILTER (step = 0) AS repeated, count(*) FILTER (t % 3600 <> 0) AS off_grid, count(*) FILTER (step > 3600) AS gaps, max(step) AS widest FROM g GROUP BY symbol")
def series_integrity(spark, sf_dir):
    return V.integrity(hourly(spark, sf_dir), KEY, "t", HOUR)


@query("SELECT 0 AS only_ours, 0 AS only_theirs, 0 AS differing")
def resample_recomputed(spark, sf_dir):
    """Four-hour bars from ticks against four-hour bars from hourly bars."""
    once = hourly(spark, sf_dir, 4)
    four = (F.floor(F.col("t") / (4 * HOUR)) * 4 * HOUR).cast("long").alias("t4")
    twice = hourly(spark, sf_dir).groupBy("symbol", four).agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("n").alias("n")).withColumnRenamed("t4", "t")
    return V.disagreements(once, twice, ["symbol", "t"], ["open", "high", "low", "close", "n"])


def _exact(label: str, bin_: str) -> str:
    return f"SELECT '{label}' AS label, round(avg(CAST(m.open = f.open AND m.high = f.high AND m.low = f.low AND m.close = f.close AS INT)), 6) AS exact, count(*) AS bars FROM (SELECT symbol, CAST({bin_} AS BIGINT) AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close FROM bars GROUP BY symbol, {bin_}) m JOIN four f USING (symbol, t)"


@query(f"WITH {_TAPE}, {_bars()}, {_bars(4, 'four')} {_exact('left', 't // 14400 * 14400')} UNION ALL {_exact('right', '(t + 14399) // 14400 * 14400')}")
def label_semantics(spark, sf_dir):
    """Whether hourly bars reproduce the four-hour ones when their times are taken as the start (left) or the end (right) of a bin."""
    four = hourly(spark, sf_dir, 4).select("symbol", "t", F.struct("open", "high", "low", "close").alias("theirs"))
    t = F.col("t") / (4 * HOUR)
    hours = hourly(spark, sf_dir).withColumn("bin", F.explode(F.array(F.struct(F.lit("left").alias("label"), (F.floor(t) * 4 * HOUR).cast("long").alias("at")), F.struct(F.lit("right").alias("label"), (F.ceil(t) * 4 * HOUR).cast("long").alias("at")))))
    made = hours.groupBy("symbol", F.col("bin.label").alias("label"), F.col("bin.at").alias("at")).agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"))
    both = made.select("symbol", "label", F.col("at").alias("t"), F.struct("open", "high", "low", "close").alias("ours")).join(four, ["symbol", "t"])
    return both.groupBy("label").agg(F.round(F.avg((F.col("ours") == F.col("theirs")).cast("int")), 6).alias("exact"), F.count("*").alias("bars"))


_NOISE = "CASE WHEN t // 3600 % 3 = 0 THEN 1 WHEN t // 3600 % 5 = 0 THEN 5 ELSE 0 END"


@query(f"{_BASE}, e AS (SELECT symbol, t, high, close + {_NOISE} AS close FROM bars UNION ALL SELECT symbol, max(t) + 3600, 0, 0 FROM bars GROUP BY symbol) SELECT e.symbol, count(*) AS bars, count(b.t) AS covered, round(count(b.t) / count(*), 6) AS coverage, round(avg(CAST(b.high = e.high AS INT)), 6) AS exact_high, round(avg(CAST(b.close = e.close AS INT)), 6) AS exact_close, round(avg(CAST(abs(b.close - e.close) <= 1 AS INT)), 6) AS near_close FROM e LEFT JOIN bars b ON e.symbol = b.symbol AND e.t = b.t GROUP BY e.symbol")
def bars_against_export(spark, sf_dir):
    """Bars from ticks against an export whose closes are up to five points off and that has one bar more."""
    rows = hourly(spark, sf_dir)
    export = rows.select("symbol", "t", "high", (F.col("close") + F.expr(_NOISE.replace("//", "div"))).alias("close"))
    export = export.unionByName(rows.groupBy("symbol").agg((F.max("t") + HOUR).alias("t"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("close")))
    both = export.join(rows.select("symbol", "t", F.col("high").alias("h"), F.col("close").alias("c")), ["symbol", "t"], "left")
    share = lambda test, name: F.round(F.avg(test.cast("int")), 6).alias(name)
    near = F.abs(F.col("c") - F.col("close")) <= 1
    return both.groupBy("symbol").agg(F.count("*").alias("bars"), F.count("c").alias("covered"), F.round(F.count("c") / F.count("*"), 6).alias("coverage"), share(F.col("h") == F.col("high"), "exact_high"), share(F.col("c") == F.col("close"), "exact_close"), share(near, "near_close"))


@query(f"{_BASE} SELECT 0 AS past_changed, count(*) FILTER (c_t > 1705276800) AS future_changed FROM bars")
def causality_check(spark, sf_dir):
    """Features at the cut and before it must not move with later prices; every later row holds a moved price, so it must."""
    bars = hourly(spark, sf_dir)
    cut = 1705276800  # 2024-01-15 00:00
    build = lambda df: X.timeframe_features(df, KEY, PERIODS)
    moved = {c: F.col(c) + 500 + F.col("n") % 7 for c in ("open", "high", "low", "close")}
    return V.causality(build, bars, "c_t", cut, KEY, "c_t", moved)


_DAYS = "days AS (SELECT unnest(range(min(t) // 86400, max(t) // 86400 + 1)) AS day FROM bars), shut AS (SELECT day FROM days WHERE (day + 3) % 7 < 5 AND day NOT IN (SELECT t // 86400 FROM bars))"
_BINS = "bins AS (SELECT symbol, CAST(t // 14400 * 14400 AS BIGINT) AS t, count(*) AS n_base FROM bars GROUP BY symbol, t // 14400), q AS (SELECT *, CASE WHEN (t // 86400 + 3) % 7 < 5 AND t // 86400 NOT IN (SELECT day FROM shut) THEN 4 ELSE 1 END AS expected FROM bins)"


@query(f"{_BASE}, {_DAYS}, {_BINS} SELECT symbol, gap, count(*) AS n, round(avg(ratio), 6) AS mean_ratio FROM (SELECT symbol, least(n_base / expected, 1.0) AS ratio, CASE WHEN n_base < expected THEN 'partial_gap' WHEN expected < 4 THEN 'market_closed' ELSE 'none' END AS gap FROM q) GROUP BY symbol, gap")
def source_quality(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    day = F.floor(F.col("t") / 86400).cast("long")
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day")).where((F.col("day") + 3) % 7 < 5)
    shut = span.join(rows.select(day.alias("day")).distinct(), "day", "left_anti")
    bins = rows.groupBy("symbol", (F.floor(F.col("t") / (4 * HOUR)) * 4 * HOUR).cast("long").alias("bar")).agg(F.count("*").alias("n_base")).withColumnRenamed("bar", "t")
    return V.source_quality(bins, 4 * HOUR, HOUR, shut).groupBy("symbol", "gap").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))


@query(f"{_BASE}, p AS (SELECT symbol, {', '.join(f'count(*) FILTER (close > {k}000) AS c{k}' for k in (2, 4))}, count(*) AS rows FROM bars GROUP BY symbol) SELECT symbol, rows, c2, c4 FROM p UNION ALL SELECT 'all', CAST(sum(rows) AS BIGINT), CAST(sum(c2) AS BIGINT), CAST(sum(c4) AS BIGINT) FROM p")
def base_rates(spark, sf_dir):
    rows = hourly(spark, sf_dir).rollup("symbol").agg(F.count("*").alias("rows"), F.count_if(F.col("close") > 2000).alias("c2"), F.count_if(F.col("close") > 4000).alias("c4"))
    return rows.withColumn("symbol", F.coalesce("symbol", F.lit("all")))
