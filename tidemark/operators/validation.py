"""Checks of series, of alignment and of column names, and the labels' logic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks as K

#: Prefixes of columns that look ahead.
OUTCOME_PREFIXES = ("fwd_", "max_future_", "min_future_", "long_m", "short_m", "time_to_", "max_abs_move", "future_range", "horizon_complete", "bars_in_window", "expansion_")
_LABEL = re.compile(r"expansion_(up|down)_([0-9.]+)p_([0-9]+)m")


def label_of(column: str) -> tuple[str, float, int] | None:
    """Direction, threshold and horizon of an expansion column's name; None for any other."""
    found = _LABEL.fullmatch(column)
    return (found[1], float(found[2]), int(found[3])) if found else None


def implied(event: tuple[str, float, int], column: str) -> bool:
    """Whether the event alone makes the label true: same direction, no higher threshold, no shorter horizon."""
    label = label_of(column)
    return bool(label) and label[0] == event[0] and label[1] <= event[1] and label[2] >= event[2]


def excluded(threshold: float, horizon: int, column: str) -> bool:
    """Whether the absence of such an event alone makes the label false."""
    label = label_of(column)
    return bool(label) and label[1] >= threshold and label[2] <= horizon


def require_no_outcomes(columns: Iterable[str], role: str) -> None:
    """Features, match keys and states must not look ahead."""
    leaks = sorted(c for c in columns if c.split("__")[-1].startswith(OUTCOME_PREFIXES))
    if leaks:
        raise ValueError(f"{role} look ahead: {', '.join(leaks)}")


def schema_differences(columns: Iterable[str], documented: Iterable[str]) -> dict[str, list[str]]:
    """Names that only one side has, and names that come twice."""
    ours, theirs = list(columns), list(documented)
    twice = sorted({c for c in ours if ours.count(c) > 1} | {c for c in theirs if theirs.count(c) > 1})
    return {"missing": sorted(set(theirs) - set(ours)), "extra": sorted(set(ours) - set(theirs)), "twice": twice}


def integrity(bars: DataFrame, keys: list[str], t: str, seconds: int) -> DataFrame:
    """Per series: rows, repeated times, times off the grid, gaps (steps over one bar) and the widest step."""
    stepped = K.previous(bars.select(*keys, t), keys, t, [t], {"__past": F.col(t)}).withColumn("__step", F.col(t) - F.col("__past"))
    return stepped.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col("__step") == 0).alias("repeated"), F.count_if(F.col(t) % seconds != 0).alias("off_grid"),
        F.count_if(F.col("__step") > seconds).alias("gaps"), F.max("__step").alias("widest"),
    )


def disagreements(ours: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: rows on one side only, and rows on both whose fields differ, nulls being equal."""
    a, b = ours.select(*keys, F.struct(*fields).alias("__a")), theirs.select(*keys, F.struct(*fields).alias("__b"))
    both = a.join(b, keys, "full_outer")
    return both.agg(F.count_if(F.col("__b").isNull()).alias("only_ours"), F.count_if(F.col("__a").isNull()).alias("only_theirs"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("differing"))


def causality(build: Callable[[DataFrame], DataFrame], source: DataFrame, t: str, cut: int, keys: list[str], when: str, change: dict[str, Column]) -> DataFrame:
    """Builds features from the source and from the source changed after `cut`. One row: features known at the cut that differ (must be 0),
    and later ones that differ (must not be 0, or the check says nothing)."""
    moved = source.withColumns({c: F.when(F.col(t) > cut, x).otherwise(F.col(c)) for c, x in change.items()})
    one, two = build(source), build(moved)
    fields = [c for c in one.columns if c not in keys and c != when]
    split = lambda df, past: df.where(F.col(when) <= cut if past else F.col(when) > cut)
    count = lambda past, name: disagreements(split(one, past), split(two, past), [*keys, when], fields).select((F.col("only_ours") + F.col("only_theirs") + F.col("differing")).alias(name))
    return count(True, "past_changed").crossJoin(count(False, "future_changed"))


def source_quality(bars: DataFrame, seconds: int, base: int, closures: DataFrame | None = None) -> DataFrame:
    """Adds expected (tradeable base slots of the bar: weekdays that aren't closures, at least 1), ratio, complete and gap: none,
    market_closed (complete for the slots there were) or partial_gap. Bars of up to a day lie in one date. closures: one column, `day`."""
    day, nominal = F.floor(F.col("t") / 86400).cast("long"), seconds // base
    rows = bars.withColumn("__day", day)
    if closures is not None:
        rows = rows.join(closures.select(F.col("day").cast("long").alias("__day"), F.lit(True).alias("__closed")).distinct(), "__day", "left")
    else:
        rows = rows.withColumn("__closed", F.lit(None).cast("boolean"))
    open_ = ((F.col("__day") + 3) % 7 < 5) & F.col("__closed").isNull()
    rows = rows.withColumn("expected", F.when(open_, nominal).otherwise(1))
    rows = rows.withColumn("ratio", F.least(F.col("n_base") / F.col("expected"), F.lit(1.0))).withColumn("complete", F.col("n_base") >= F.col("expected"))
    return rows.withColumn("gap", F.when(~F.col("complete"), "partial_gap").when(F.col("expected") < nominal, "market_closed").otherwise("none")).drop("__day", "__closed")


def audit(bars: DataFrame, keys: list[str], t: str, seconds: int, closed: str | None = None) -> DataFrame:
    """check, value (text): what a series of bars (t, open, high, low, close, n) holds that it should not, and its calendar. One pass over
    the bars with the row before them, one over the slots of weekdays."""
    rows = K.previous(bars, keys, t, [t], {"__past": F.col(t)}).withColumn("__gap", F.col(t) - F.col("__past"))
    day = F.floor(F.col(t) / 86400).cast("long")
    weekday = lambda d: (d + 3) % 7
    prices = ("open", "high", "low", "close")
    weekend = lambda d: weekday(d) >= 5
    over = F.col("__gap") > seconds
    counted = {
        "rows": F.count("*"), "first": F.min(t), "last": F.max(t), "duplicate_times": F.count_if(F.col("__gap") == 0), "out_of_order": F.count_if(F.col("__gap") < 0), "off_grid": F.count_if(F.col(t) % seconds != 0),
        **{f"null_{c}": F.count_if(F.col(c).isNull()) for c in prices}, **{f"non_positive_{c}": F.count_if(F.col(c) <= 0) for c in prices},
        "high_below_low": F.count_if(F.col("high") < F.col("low")), "open_outside": F.count_if((F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))), "close_outside": F.count_if((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))),
        "flat_bars": F.count_if(F.col("high") == F.col("low")), "least_ticks": F.min("n"), "median_ticks": F.median("n").cast("decimal(38,1)"), "most_ticks": F.max("n"), "weekend_bars": F.count_if(weekend(day)), "gaps": F.count_if(over),
        "intraweek_gaps": F.count_if(over & (F.floor((day + 3) / 7) == F.floor((F.floor(F.col("__past") / 86400) + 3) / 7))), "session_gaps": F.count_if(F.col("__gap") > 7200), "largest_gap": F.max("__gap"),
    }
    after = F.when(F.col("__gap") > 7200, weekday(day) * 24 + F.floor(F.col(t) / 3600) % 24)
    one = rows.agg(*(c.cast("string").alias(n) for n, c in counted.items()), F.mode(after, True).cast("string").alias("modal_session_start"))
    missing = weekday_gaps(bars, keys, t, seconds)
    late = missing.agg(F.coalesce(F.sum("missing"), F.lit(0)).cast("string").alias("missing_weekday_slots"), F.count("*").cast("string").alias("days_with_missing_slots"))
    worst = missing.groupBy("day").agg(F.sum("missing").alias("missing")).orderBy(F.desc("missing"), "day").limit(6)
    text = worst.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("missing")).alias("m"), "day"))), lambda x: F.concat_ws(":", x["day"], -x["m"])), " ").alias("worst_days")).select(F.nullif("worst_days", F.lit("")).alias("worst_days"))
    names = [*counted, "modal_session_start", "missing_weekday_slots", "days_with_missing_slots", "worst_days"]
    return one.crossJoin(late).crossJoin(text).unpivot([], names, "check", "value")  # one row each


def weekday_gaps(bars: DataFrame, keys: list[str], t: str, seconds: int) -> DataFrame:
    """keys, day, missing: slots of weekdays between a series' first and last bar that have none. Days are counted, not slots listed."""
    day = F.floor(F.col(t) / 86400).cast("long")
    ends = bars.groupBy(*keys).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    days = ends.withColumn("day", F.explode(F.sequence(F.floor(F.col("__a") / 86400), F.floor(F.col("__b") / 86400)))).where((F.col("day") + 3) % 7 < 5)
    first, last = F.greatest(F.col("__a"), F.col("day") * 86400), F.least(F.col("__b"), F.col("day") * 86400 + 86400 - seconds)
    slots = days.withColumn("__slots", F.floor((last - first) / seconds) + 1).drop("__a", "__b")
    held = bars.groupBy(*keys, day.alias("day")).agg(F.count_distinct(t).alias("__held"))
    return slots.join(held, [*keys, "day"], "left").withColumn("missing", (F.col("__slots") - F.coalesce("__held", F.lit(0))).cast("long")).where("missing > 0").drop("__slots", "__held")


def decision_quality(decisions: DataFrame, frames: dict[str, DataFrame], keys: list[str], t: str) -> DataFrame:
    """decisions with, per timeframe, complete, ratio and gap of the bar in force ('no_bar' and not complete without one), and whether all
    are complete. frames: keys, c_t and source_quality's columns."""
    from tidemark.operators.bars import asof

    out, every = decisions, F.lit(True)
    for name, bars in frames.items():
        theirs = bars.select(*keys, F.col("c_t").alias("__closed"), F.struct("complete", "ratio", "gap").alias(f"__{name}"))
        out = asof(out, theirs, keys, t, "__closed", [f"__{name}"]).drop("__closed")
        of = lambda c: F.col(f"__{name}.{c}")  # noqa: B023, E731
        out = out.withColumns({f"{name}_complete": F.coalesce(of("complete"), F.lit(False)), f"{name}_ratio": of("ratio"), f"{name}_gap": F.coalesce(of("gap"), F.lit("no_bar"))}).drop(f"__{name}")
        every = every & F.col(f"{name}_complete")
    return out.withColumn("source_quality_ok", every)


def timing_audit(decisions: DataFrame, frames: dict[str, DataFrame], keys: list[str], t: str, n: int, seed: int, shifts: dict[str, int]) -> DataFrame:
    """For n decisions in seeded order, per timeframe and mode of indicators: the bar in force, the bar that indicators read, and how old it
    is. frames: keys, t, c_t of closed bars."""
    from tidemark.operators.bars import asof
    from tidemark.operators.studies import seeded

    picks = decisions.select(*keys, t).orderBy(seeded(seed, *keys, t), *keys, t).limit(n)
    out = None
    for name, bars in frames.items():
        rows = bars.select(*keys, F.col("t").alias("opened"), F.col("c_t").alias("closed"))
        rows = K.trailing(rows, keys, "closed", max(shifts.values()) + 1, lambda df, w: df.withColumn("inputs", F.array(*(F.struct(F.lit(m).alias("mode"), F.lag("opened", s).over(w).alias("input_open"), F.lag("closed", s).over(w).alias("input_close")) for m, s in shifts.items()))))
        joined = asof(picks, rows, keys, t, "closed", ["opened", "inputs"]).where("closed is not null")
        one = joined.select(F.lit(name).alias("timeframe"), *keys, F.col(t).alias("decision"), "opened", "closed", F.inline("inputs")).where("input_close is not null")
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"lag": F.col("decision") - F.col("input_close"), "closed_in_time": F.col("input_close") <= F.col("decision")})


def valid_rows(matrix: DataFrame, flag: Column) -> DataFrame:
    """One row: rows, valid ones, and whether a matrix is of any use (at least one is valid)."""
    return matrix.agg(F.count("*").alias("rows"), F.count_if(flag).alias("valid"), (F.count_if(flag) > 0).alias("usable"))


def reported(checks: Iterable[tuple[str, bool, object]], spark) -> DataFrame:
    """check, passed, value (text): results of checks in their order, as a table."""
    rows = [(i, name, bool(passed), "" if value is None else str(value)) for i, (name, passed, value) in enumerate(checks)]
    return spark.createDataFrame(rows, "place int, check string, passed boolean, value string").orderBy("place").drop("place")
