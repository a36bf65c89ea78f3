"""A study end to end, from its configuration: features and outcomes, eligibility, events with their controls, failed compressions,
comparisons, states, crossings, warnings.

Every step is one lazy DataFrame over the step before's table. Times are seconds since 1970 of closed bars; prices are points."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import MINUTES, StudyConfig
from tidemark.functions.scalars import compression_state, floored, points, safe_divide, session_of
from tidemark.operators import bars as B
from tidemark.operators import blocks as K
from tidemark.operators import features as X
from tidemark.operators import matrix as M
from tidemark.operators import rolling as R
from tidemark.operators import studies as S
from tidemark.operators import validation as V
from tidemark.operators.dictionary import FeatureDictionary
from tidemark.sources import artefacts as A
from tidemark.sources.text import read_bars

KEYS, STRATUM = ["symbol"], ["symbol", "direction", "threshold", "horizon"]
FEWEST_EPISODES, LEAST_MATCHED = 30, 0.95


def base_bars(spark: SparkSession, cfg: StudyConfig) -> DataFrame:
    source, seconds = cfg.base_source, MINUTES[cfg.base_timeframe] * 60
    rows = read_bars(spark, source.path, seconds, "open" if cfg.timestamp_semantics == "bar_open" else "close")
    prices = [points(F.col(c), cfg.point_size).alias(c) for c in ("open", "high", "low", "close")]
    return rows.select(F.lit(cfg.symbol).alias("symbol"), B.epoch_seconds("open_time").alias("t"), B.epoch_seconds("close_time").alias("c_t"), *prices, "spread_points", "tick_volume")


def closures(base: DataFrame) -> DataFrame:
    """Weekdays within the base bars' span that have none at all."""
    day = F.floor(F.col("t") / 86400).cast("long")
    span = base.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day")).where((F.col("day") + 3) % 7 < 5)
    return span.join(base.select(day.alias("day")).distinct(), "day", "left_anti")


def bars_of(base: DataFrame, cfg: StudyConfig, timeframe: str) -> DataFrame:
    """symbol, t, c_t, prices, spread and coverage of a timeframe's closed bars, with the quality of their sources (AG12's columns)."""
    seconds, step = MINUTES[timeframe] * 60, MINUTES[cfg.base_timeframe] * 60
    if timeframe == cfg.base_timeframe:
        made = base.withColumns({"n_base": F.lit(1).cast("long"), "spread": F.col("spread_points")})
    else:
        made = B.rebar(base.withColumnRenamed("spread_points", "spread"), KEYS, seconds, ("spread",))
        made = B.drop_open_tail(made, base.select(F.col("c_t").alias("end")), "end", seconds)
    made = V.source_quality(made.withColumn("coverage", F.col("n_base") / (seconds // step)), seconds, step, closures(base))
    return made.select(*KEYS, "t", "c_t", *M.BARS, "n_base", "expected", "ratio", "complete", "gap")


def of_timeframe(base: DataFrame, cfg: StudyConfig, timeframe: str) -> DataFrame:
    """symbol, c_t, the timeframe's features (as M.of_timeframe has them) and the quality of each bar's sources."""
    bars = bars_of(base, cfg, timeframe)
    made = A.materialize(M.of_timeframe(bars.select(*KEYS, "t", "c_t", *M.BARS), cfg, timeframe, KEYS), f"features-{timeframe}")
    return M.with_carries(made, KEYS).join(bars.select(*KEYS, "c_t", "t", "ratio", "complete", "gap"), [*KEYS, "c_t"])


def aligned(base: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per base bar, with each timeframe's latest closed bar at that time as a struct."""
    out = base.select(*KEYS, "t", "c_t")
    for tf in cfg.active_timeframes:
        rows = of_timeframe(base, cfg, tf)
        rows = rows.select(*KEYS, F.col("c_t").alias("closed"), F.struct("n", "x", "v", "last", "t", F.col("c_t").alias("closed"), "ratio", "complete", "gap").alias(tf))
        out = B.asof(out, rows, KEYS, "c_t", "closed", [tf]).drop("closed")
    return out


def dictionary(cfg: StudyConfig) -> FeatureDictionary:
    """Every feature of the matrix, as the passes that compute it name and describe it."""
    columns, extra = M.described(cfg)
    return FeatureDictionary(f for c in (*columns.values(), extra) for f in c.features)


def feature_matrix(base: DataFrame, cfg: StudyConfig) -> DataFrame:
    return M.matrix(aligned(base, cfg), cfg, [*KEYS, "c_t"])


def alignment(rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The map of aligned rows: per timeframe the source bar's place, times, age in minutes and quality ('no_bar' without one), and over
    all of them whether the row is valid (past the warm-up) and its sources are whole."""
    made: dict[str, Column] = {}
    for tf in cfg.active_timeframes:
        of = lambda c: F.col(f"`{tf}`.`{c}`")  # noqa: B023, E731
        made |= {
            f"{tf}__source_bar_index": F.coalesce(of("n"), F.lit(-1)), f"{tf}__source_bar_open_time": of("t"), f"{tf}__source_bar_close_time": of("closed"), f"{tf}__source_bar_age_minutes": (F.col("c_t") - of("closed")) / 60,
            f"{tf}__source_bar_complete": F.coalesce(of("complete"), F.lit(False)), f"{tf}__source_bar_completeness_ratio": of("ratio"), f"{tf}__source_bar_gap_kind": F.coalesce(of("gap"), F.lit("no_bar")),
        }
    every = lambda tests: reduce(Column.__and__, tests)
    made["feature_row_valid"] = every(F.coalesce(F.col(f"`{tf}`.n") >= cfg.warmup_bars, F.lit(False)) for tf in cfg.active_timeframes)
    made["source_quality_ok"] = every(F.coalesce(F.col(f"`{tf}`.complete"), F.lit(False)) for tf in cfg.active_timeframes)
    return rows.select(*KEYS, "c_t", *(c.alias(n) for n, c in made.items()))


def lookahead(mapped: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Per timeframe: rows checked, rows without a closed bar, source bars that closed after the decision (must be 0), ages in minutes."""
    long = mapped.select(F.inline(F.array(*(F.struct(F.lit(tf).alias("timeframe"), F.col(f"`{tf}__source_bar_age_minutes`").alias("age")) for tf in cfg.active_timeframes))))
    out = long.groupBy("timeframe").agg(F.count("age").alias("rows_checked"), F.count_if(F.col("age").isNull()).alias("rows_without_closed_bar"), F.count_if(F.col("age") < 0).alias("violations"), F.min("age").alias("min_age"), F.median("age").alias("median_age"), F.max("age").alias("max_age"))
    return out.withColumn("status", F.when(F.col("violations") == 0, "ok").otherwise("fail"))


def quality_report(base: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Per timeframe: bars, complete ones, those short by market closures and by gaps, the least ratio, and the five worst."""
    return reduce(DataFrame.unionByName, (S.quality_summary(bars_of(base, cfg, tf)).select(F.lit(tf).alias("timeframe"), "*") for tf in cfg.active_timeframes))


def outcome_names(horizon: int, thresholds: tuple[float, ...]) -> list[str]:
    """Names of a horizon's outcomes, in minutes and pips."""
    plain = ("fwd_price_change", "fwd_pips", "fwd_log_return", "max_future_delta_pips", "min_future_delta_pips", "long_mfe_pips", "long_mae_pips", "short_mfe_pips", "short_mae_pips", "time_to_max_high_minutes", "time_to_min_low_minutes", "max_abs_move_pips", "future_range_pips", "horizon_complete", "bars_in_window")
    return [f"{n}_{horizon}m" for n in plain] + [f"{n}_{x:g}p_{horizon}m" for x in thresholds for n in ("expansion_up", "expansion_down", "expansion_first", "time_to_expansion_up", "time_to_expansion_down")]


def outcomes(base: DataFrame, cfg: StudyConfig) -> DataFrame:
    """symbol, c_t and every horizon's outcomes. All thresholds of a horizon share one pass over the bars ahead."""
    rows, pip, out = base.select(*KEYS, "c_t", "close", "high", "low"), cfg.points_per_pip, []
    last = base.groupBy(*KEYS).agg(F.max("c_t").alias("__last"))
    for h in cfg.forward_horizons_minutes:
        rows = R.forward_extremes(rows, KEYS, "c_t", h * 60)
        change = F.col("f_close") - F.col("close")
        up, down, named = (F.col("f_high") - F.col("close")) / pip, (F.col("f_low") - F.col("close")) / pip, outcome_names(h, ())
        values = [change * cfg.point_size, change / pip, F.ln(F.col("f_close") / F.col("close")), up, down, floored(up), floored(-down), floored(-down), floored(up), F.col("f_high_t") / 60, F.col("f_low_t") / 60, F.greatest(F.abs(up), F.abs(down)), up - down, F.col("c_t") + h * 60, F.col("f_n")]
        rows = rows.withColumns(dict(zip(named, values, strict=True))).drop("f_n", "f_high", "f_high_t", "f_low", "f_low_t", "f_close")
        out += named
        tags = {f"{x:g}p_{h}m": round(x * pip) for x in cfg.expansion_thresholds_pips}
        rows = R.first_touches(rows, KEYS, "c_t", h * 60, tags)
        for tag in tags:
            up, down, first = (F.col(f"{c}_{tag}") for c in ("up", "down", "first"))
            rows = rows.withColumns({f"expansion_up_{tag}": up.isNotNull(), f"expansion_down_{tag}": down.isNotNull(), f"expansion_first_{tag}": first, f"time_to_expansion_up_{tag}": up / 60, f"time_to_expansion_down_{tag}": down / 60}).drop(f"up_{tag}", f"down_{tag}", f"first_{tag}")
        out += [n for n in outcome_names(h, cfg.expansion_thresholds_pips) if n not in named]
    rows = rows.join(last, KEYS)  # a row per symbol
    ends = {f"horizon_complete_{h}m": F.col(f"horizon_complete_{h}m") <= F.col("__last") for h in cfg.forward_horizons_minutes}
    return rows.withColumns(ends).select(*KEYS, "c_t", *out)


def context(rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Adds what controls are matched on (session, hour bucket, weekday, bin of volatility by quantiles of all rows, one row of edges) and
    the state of compression."""
    column, n = cfg.volatility_column, cfg.step2.volatility_bins
    edges = rows.agg(F.percentile(F.col(f"`{column}`"), F.array(*(F.lit(i / n) for i in range(1, n)))).alias("__q"))
    rows = rows.crossJoin(F.broadcast(edges)).withColumns({f"__q{i}": F.get("__q", F.lit(i)) for i in range(n - 1)})
    hour, held = F.floor(F.col("c_t") / 3600 % 24), cfg.step2
    made = {
        "session": session_of(hour), "hour_bucket": F.floor(hour / held.hour_bucket_hours) * held.hour_bucket_hours, "weekday": ((F.floor(F.col("c_t") / 86400) + 3) % 7).cast("int"), "volatility": S.quantile_bins(column, [f"__q{i}" for i in range(n - 1)]),
        "compression_state": compression_state(F.col(f"`{cfg.compression_column}`"), held.compression_compressed_max_percentile, held.compression_expanding_min_percentile),
    }
    return rows.withColumns(made).drop("__q", *(f"__q{i}" for i in range(n - 1)))


def cell(cfg: StudyConfig) -> list[str]:
    return [*STRATUM, *cfg.step2.match_keys]


#: Reasons in their order; the first that holds excludes a row.
REASONS = ("feature_row_invalid", "incomplete_horizon", "market_closed_window", "outcome_nan", "incomplete_htf_source_bar", "ambiguous_first_touch")


def labelled(rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """A row per bar and stratum: the keys of matching, c_t, the first reason that excludes it (null: eligible), whether the move came
    (`hit`), and what is known of it. rows: context() of features, outcomes and the alignment's flags."""
    cells, held = [], cfg.step2
    for d, x, h in held.strata:
        other, tag = "down" if d == "up" else "up", f"{x:g}p_{h}m"
        no = F.lit(False)
        tests = dict(zip(REASONS, (
            ~F.col("feature_row_valid"), ~F.col(f"horizon_complete_{h}m") if held.require_complete_horizon else no, F.col(f"bars_in_window_{h}m") <= 0 if held.require_observed_bars else no,
            F.col(f"max_future_delta_pips_{h}m").isNull(), ~F.col("source_quality_ok") if held.require_source_quality else no, F.col(f"expansion_first_{tag}") == 2 if held.exclude_ambiguous_first_touch else no,
        ), strict=True))
        reason = S.first_reason(tests)
        cells.append(F.struct(
            F.lit(d).alias("direction"), F.lit(float(x)).alias("threshold"), F.lit(h).alias("horizon"), reason.alias("reason"), F.col(f"expansion_{d}_{tag}").alias("hit"), F.col(f"expansion_{other}_{tag}").alias("opposite"),
            F.col(f"expansion_first_{tag}").alias("first_touch"), F.col(f"time_to_expansion_{d}_{tag}").alias("minutes_to_threshold"), F.col(f"max_future_delta_pips_{h}m").alias("max_up"), F.col(f"min_future_delta_pips_{h}m").alias("max_down"), F.col(f"fwd_pips_{h}m").alias("fwd_pips"),
        ))
    return rows.select("symbol", "c_t", "session", "hour_bucket", "weekday", "volatility", "compression_state", F.inline(F.array(*cells)))


def exclusions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per stratum, rows by their first reason, in its order; `eligible` for none. Reasons without rows are left out."""
    return rows.groupBy(*keys, F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("rows"))


def episodes(rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Eligible hits collapsed into episodes, one row each: that of its earliest hit, with start, end, the widest moves and the number of
    the hits within, and the context's label. A hit within the span of an episode's start (its horizon, or its time to the threshold)
    and the extra separation belongs to it."""
    hits = rows.where(F.col("reason").isNull() & F.col("hit"))
    span = (F.col("horizon") * 60).cast("long")
    if cfg.step2.suppression_rule == "to_threshold":
        span = F.coalesce(F.col("minutes_to_threshold") * 60, span).cast("long")
    out = S.collapsed(hits.withColumn("span", span), STRATUM, "c_t", "span", cfg.step2.extra_separation_minutes * 60, ["max_up"], ["max_down"])
    return out.withColumn("context", S.context_label(F.col("direction"), F.col("compression_state") == "compressed", F.lit(True)))


def failed_compressions(rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Eligible compressed rows without a move either way, thinned to one for each separation, with the number it stands for."""
    still = rows.where(F.col("reason").isNull() & (F.col("compression_state") == "compressed") & ~F.col("hit") & ~F.col("opposite"))
    out = S.thinned(still, STRATUM, "c_t", cfg.step2.consolidation_episode_separation_minutes * 60)
    return out.withColumn("context", S.context_label(F.col("direction"), F.lit(True), F.lit(False)))


def control_pool(rows: DataFrame, events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Eligible rows without the move, away from every episode of their stratum and from where they would look ahead into one."""
    spans = S.purge_spans(events.withColumn("look", F.col("horizon") * 60), STRATUM, "start", "end", cfg.step2.control_purge_minutes * 60, "look")
    return S.outside(rows.where(F.col("reason").isNull() & ~F.col("hit")), spans, STRATUM, "c_t")


def pool_counts(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Per stratum: rows of the pool before and after the purge."""
    before = rows.where(F.col("reason").isNull() & ~F.col("hit")).groupBy(*STRATUM).agg(F.count("*").alias("before_purge"))
    after = pool.groupBy(*STRATUM).agg(F.count("*").alias("after_purge"))
    left = F.coalesce("after_purge", F.lit(0))
    return before.join(after, STRATUM, "left").select(*STRATUM, "before_purge", (F.col("before_purge") - left).alias("purged"), left.alias("after_purge"))


def controls(pool: DataFrame, events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Rows of the pool matched to the episodes by cell, and random ones of the same stratum whatever their cell."""
    held, asked = cfg.step2, events.select(*cell(cfg), F.col("start").alias("event_t"))
    ready = pool.select(*cell(cfg), F.col("c_t").alias("control_t"))
    matched = S.matched_controls(asked, ready, cell(cfg), "event_t", "control_t", held.controls_per_event, held.random_seed)
    random = S.matched_controls(asked.select(*STRATUM, "event_t"), ready.select(*STRATUM, "control_t"), STRATUM, "event_t", "control_t", held.random_controls_per_event, held.random_seed + 1)
    columns = [*STRATUM, "event_t", "slot", "control_t"]
    return matched.select(*columns, F.lit("matched").alias("control_type")).unionByName(random.select(*columns, F.lit("random").alias("control_type")))


def overlap_report(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Per stratum: eligible rows, hits, episodes, and what their ratios say of overlapping windows."""
    per = rows.where(F.col("reason").isNull()).groupBy(*STRATUM).agg(F.count("*").alias("eligible"), F.count_if("hit").alias("candidates"))
    out = per.join(events.groupBy(*STRATUM).agg(F.count("*").alias("episodes")), STRATUM, "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    return S.overlap(out)


def event_counts(events: DataFrame, failed: DataFrame, matched: DataFrame) -> DataFrame:
    """Numbers of episodes by context and by session, of failed compressions and of controls, under one another."""
    one = lambda df, by, name: df.groupBy(*STRATUM, F.col(by).alias("context")).agg(F.count("*").alias("n")).withColumn("population", F.lit(name))
    parts = [one(events, "context", "event"), one(events, "session", "event_by_session"), one(failed, "context", "consolidation_failure"), one(matched, "control_type", "control")]
    return reduce(DataFrame.unionByName, parts)


def match_report(events: DataFrame, matched: DataFrame) -> DataFrame:
    """Per stratum and kind of control: episodes, those with a control, and the mean number found."""
    found = matched.groupBy(*STRATUM, "control_type").agg(F.count_distinct("event_t").alias("with_control"), F.count("*").alias("found"))
    n = events.groupBy(*STRATUM).agg(F.count("*").alias("episodes"))
    return n.join(found, STRATUM).select(*STRATUM, "control_type", "episodes", "with_control", (F.col("found") / F.col("episodes")).alias("mean_found"))


def run_warnings(events: DataFrame, matched: DataFrame, keys: list[str], per_event: int) -> DataFrame:
    """keys, warning, value: fewer than FEWEST_EPISODES episodes, or less than LEAST_MATCHED of the controls that were asked for."""
    n, found = events.groupBy(*keys).agg(F.count("*").alias("episodes")), matched.groupBy(*keys).agg(F.count("*").alias("found"))
    rows = n.join(found, keys, "left").withColumn("rate", F.coalesce("found", F.lit(0)) / (F.col("episodes") * per_event))
    few = F.when(F.col("episodes") < FEWEST_EPISODES, F.struct(F.lit("few_episodes").alias("warning"), F.col("episodes").cast("double").alias("value")))
    unmatched = F.when(F.col("rate") < LEAST_MATCHED, F.struct(F.lit("unmatched").alias("warning"), F.round("rate", 6).alias("value")))
    return rows.select(*keys, F.explode(F.array_compact(F.array(few, unmatched))).alias("w")).select(*keys, "w.*")


def comparisons(rows: DataFrame, events: DataFrame, matched: DataFrame, quantiles: tuple[float, ...] = ()) -> DataFrame:
    """Per stratum: episodes, matched controls, the mean forward move of both, their standardised difference, quantiles of the absolute
    move, and the base rate of hits among eligible rows."""
    held = matched.where("control_type = 'matched'").select(*STRATUM, F.col("control_t").alias("c_t")).join(rows, [*STRATUM, "c_t"])
    both = events.select(*STRATUM, "fwd_pips", F.lit(True).alias("event")).unionByName(held.select(*STRATUM, "fwd_pips", F.lit(False).alias("event")))
    mean = lambda test: F.avg(F.when(test, F.col("fwd_pips")))
    spread = [F.percentile(F.when(test, F.abs("fwd_pips")), F.array(*map(F.lit, quantiles))).alias(n) for n, test in (("event_quantiles", F.col("event")), ("control_quantiles", ~F.col("event")))] if quantiles else []
    out = both.groupBy(*STRATUM).agg(F.count_if("event").alias("episodes"), F.count_if(~F.col("event")).alias("controls"), mean(F.col("event")).alias("event_pips"), mean(~F.col("event")).alias("control_pips"), S.mean_difference(F.col("event"), "fwd_pips").alias("smd"), *spread)
    return out.join(rows.where(F.col("reason").isNull()).groupBy(*STRATUM).agg(F.avg(F.col("hit").cast("int")).alias("base_rate")), STRATUM)


def outcome_comparisons(table: DataFrame, events: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per stratum, kind of control and outcome: rates of all expansions, with those that the definitions imply marked, and magnitudes."""
    kinds = matched.select("control_type").distinct()  # a few words
    at = [*STRATUM, "control_type", F.col("start").alias("c_t")]
    ours = events.crossJoin(F.broadcast(kinds)).select(*at).join(table, [*KEYS, "c_t"])
    theirs = matched.select(*STRATUM, "control_type", F.col("control_t").alias("c_t")).join(table, [*KEYS, "c_t"])
    labels = [c for c in table.columns if V.label_of(c)]
    sizes = [c for c in table.columns if c.startswith(("fwd_pips_", "long_m", "short_m", "max_abs_move_pips_", "future_range_pips_"))]
    by = [*STRATUM, "control_type"]
    return S.compared_rates(ours, theirs, by, labels, ("direction", "threshold", "horizon")), S.compared_magnitudes(ours, theirs, by, sizes)


def panel(base: DataFrame, cfg: StudyConfig, timeframe: str) -> DataFrame:
    """symbol, c_t, timeframe, kind, period, value, price, atr, price_distance, price_distance_pips, normalized_price_distance,
    rank_in_stack (place among its kind's values, missing ones lowest, equal ones by period), slope_pips_<n>, slope_atr_<n>: a row for each
    bar and average."""
    rows = M.of_timeframe(bars_of(base, cfg, timeframe).select(*KEYS, "t", "c_t", *M.BARS), cfg, timeframe, KEYS).select(*KEYS, "c_t", "n", "x")
    specs, pip = [], cfg.points_per_pip
    for kind, periods in (("ema", cfg.ema_periods), ("sma", cfg.sma_periods)):
        first = len(specs)
        specs += [{"kind": kind, "period": p, "at": first + i, "first": first, "n": len(periods)} for i, p in enumerate(periods)]
    table = F.from_json(F.lit(json.dumps(specs)), "array<struct<kind: string, period: int, at: int, first: int, n: int>>")
    there = lambda c: F.when(~F.isnan(c), c)
    rows = K.trailing(rows, KEYS, "n", max(cfg.slope_lookbacks), lambda df, w: df.withColumns({f"__x{b}": F.lag("x", b).over(w) for b in cfg.slope_lookbacks}))
    rows = rows.withColumns({"price": there(F.element_at("x", -1)), "atr": there(F.element_at("x", -2))})

    def state(p: Column) -> Column:
        own = F.get("x", p["at"])
        lower = F.filter(F.slice("x", p["first"] + 1, p["n"]), lambda v, i: v.isNull() | F.isnan(v) | (v < own) | ((v == own) & (i < p["at"] - p["first"])))
        slopes = [((there(own) - there(F.get(f"__x{b}", p["at"]))) / b / pip).alias(f"slope_pips_{b}") for b in cfg.slope_lookbacks]
        return F.struct(p["kind"].alias("kind"), p["period"].alias("period"), there(own).alias("value"), F.when(there(own).isNotNull(), F.size(lower)).alias("rank_in_stack"), *slopes)

    rows = rows.withColumn("s", F.explode(F.transform(table, state))).select(*KEYS, "c_t", F.lit(timeframe).alias("timeframe"), "price", "atr", "s.*")
    gap = F.col("price") - F.col("value")
    rows = rows.withColumns({"price_distance": gap, "price_distance_pips": gap / pip, "normalized_price_distance": safe_divide(gap, F.col("atr"))})
    return rows.withColumns({f"slope_atr_{b}": safe_divide(F.col(f"slope_pips_{b}") * pip, F.col("atr")) for b in cfg.slope_lookbacks})


def breakdown(events: DataFrame, by: str) -> DataFrame:
    """Episodes and their moves by one column."""
    return S.breakdown(events, by, ["fwd_pips", "max_up", "max_down", "opposite"])


def balance(rows: DataFrame, events: DataFrame, matched: DataFrame, cfg: StudyConfig) -> DataFrame:
    """How alike episodes and their controls are in what they were matched on."""
    keys = cfg.step2.match_keys
    held = matched.select(*STRATUM, "control_type", F.col("control_t").alias("c_t")).join(rows.select(*STRATUM, "c_t", *keys), [*STRATUM, "c_t"])
    return S.balance(events, held, keys, "control_type")


def state_rates(features: DataFrame, rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Per stratum and state: eligible rows in it and its share of them, rate of hits, the baseline of rows outside it standardised to the
    state's cells, their difference in points of per cent, lift in per cent, the medians of the moves; and the whole market as B0."""
    held, base, top = cfg.day2_checkpoint, cfg.base_timeframe, cfg.active_timeframes[-1]
    compressed = F.col(f"`{held.compression_column or cfg.compression_column.replace('compression_percentile', 'is_compressed')}`") > 0.5
    net, score = F.col(f"`{held.crossover_direction_column or f'{base}__ema_cross_net_direction'}`"), F.col(f"`{held.htf_alignment_column or f'{top}__ema_ordering_score'}`")
    made = X.states(compressed, net, score, held.htf_alignment_min_abs_ordering)
    long = features.select("symbol", "c_t", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in made.items()))).alias("states"))
    joined = rows.where(F.col("reason").isNull()).join(long, ["symbol", "c_t"])
    return S.evaluated_states(joined, STRATUM, cfg.step2.match_keys, list(made))


def crossings(base: DataFrame, cfg: StudyConfig, timeframe: str, families: tuple[str, ...]) -> DataFrame:
    """symbol, c_t, family, fast, slow, direction of every pair of averages that crossed on a bar of the timeframe; in ema_vs_sma fast and
    slow are the ema and the sma of one period, and a pair that touches counts."""
    rows = M.of_timeframe(bars_of(base, cfg, timeframe).select(*KEYS, "t", "c_t", *M.BARS), cfg, timeframe, KEYS).select(*KEYS, "c_t", "n", "x")
    return X.crossed_pairs(rows, KEYS, "n", cfg.ema_periods, cfg.sma_periods, families)
