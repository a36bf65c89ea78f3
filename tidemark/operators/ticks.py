"""Tick tape audits: quote book, duplicates, gaps, histograms and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import blocks as K


def quote_book(ticks: DataFrame, keys: list[str], order: list[str], t: str, bid: str, ask: str, by: str | None = None, size: int = K.TIME) -> DataFrame:
    """Carries each side forward: bid_now, ask_now, and the times of their last updates. Blocks are cut by `by` (t, if not named), which
    must not run against `order` from one block to the next."""
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("now"), F.col(t).alias("at")))
    out = K.carried(ticks, keys, by or t, order, {"__bid": side(bid), "__ask": side(ask)}, size)
    made = {"bid_now": F.col("__bid.now"), "ask_now": F.col("__ask.now"), "bid_t": F.col("__bid.at"), "ask_t": F.col("__ask.at")}
    return out.withColumns(made).drop("__bid", "__ask")


def stale(t: str, limit: int) -> Column:
    """Whether a side that has a quote is older than limit."""
    old = lambda side: F.coalesce(F.col(t) - F.col(side) > limit, F.lit(False))
    return old("bid_t") | old("ask_t")


def histogram_quantile(histogram: DataFrame, bucket: str, n: str, q: float) -> DataFrame:
    """The first bucket whose cumulative count reaches q of all. The histogram has a bounded number of buckets."""
    upto = F.sum(n).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return histogram.withColumn("__upto", upto).withColumn("__all", F.sum(n).over(Window.partitionBy())).where(F.col("__upto") >= q * F.col("__all")).agg(F.min(bucket).alias("value"))


def duplicates(ticks: DataFrame, t: str, columns: list[str]) -> DataFrame:
    """One row: rows beyond the first of equal times, and beyond the first of wholly equal rows."""
    same_time = ticks.groupBy(t).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("same_time"))
    same_row = ticks.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("same_row"))
    return same_time.crossJoin(same_row)


def step_topk(ticks: DataFrame, keys: list[str], t: str, order: list[str], value: str, k: int, size: int = K.TIME) -> DataFrame:
    """The k largest absolute changes of value from row to row."""
    steps = K.previous(ticks, keys, t, order, {"__past": F.col(value)}, size).withColumn("step", F.abs(F.col(value) - F.col("__past"))).drop("__past")
    return steps.where("step is not null").orderBy(F.desc("step"), *keys, *order).limit(k)


def weeks(ticks: DataFrame, t: str) -> DataFrame:
    """week (from Monday), first and last time, ticks; times in seconds of the file's clock."""
    week = F.floor((F.floor(F.col(t) / 86400) + 3) / 7).cast("long")
    return ticks.groupBy(week.alias("week")).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"))


def turn_weeks(sessions: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Those weeks in which the zone's clock changes: its offset at their end differs from that at their start."""
    monday = (F.col("week") * 7 - 3) * 86400
    offset = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone)) - s
    return sessions.where(offset(monday) != offset(monday + 7 * 86400)).select("week")


#: Shares in per cent, hours and weeks of the rules on the clock.
CONSISTENT_PCT, LATE_HOUR, ENOUGH_WEEKS, EXACT_PCT = 95.0, 22, 20, 99.0


def clock_verdict(sessions: DataFrame, turns: DataFrame, exact_pct: DataFrame, documented: bool = False) -> DataFrame:
    """One row on whether the clock is New York's plus seven hours: weeks, shares that open on Monday and close on Friday, the commonest
    hours of both, weeks with a change of New York's clock and those of them that open on Monday, the share of bars that ticks rebuild
    exactly, and the verdict. sessions: weeks(); turns: week; exact_pct: one row with exact_pct."""
    weekday, hour = (lambda c: (F.floor(F.col(c) / 86400) + 3) % 7), (lambda c: F.floor(F.col(c) / 3600) % 24)
    rows = sessions.join(turns.select(F.col("week").alias("__turn")).distinct(), F.col("week") == F.col("__turn"), "left")
    monday, friday, turn = weekday("first") == 0, weekday("last") == 4, F.col("__turn").isNotNull()
    one = rows.agg(
        F.count("*").alias("weeks"), F.round(100 * F.avg(monday.cast("int")), 2).alias("pct_open_monday"), F.round(100 * F.avg(friday.cast("int")), 2).alias("pct_close_friday"), F.mode(hour("first"), True).alias("open_hour"),
        F.mode(hour("last"), True).alias("close_hour"), F.count_if(turn).alias("turn_weeks"), F.count_if(turn & monday).alias("turn_weeks_monday"),
    ).crossJoin(exact_pct.agg(F.max("exact_pct").alias("exact_pct")))
    consistent = (F.col("pct_open_monday") >= CONSISTENT_PCT) & (F.col("pct_close_friday") >= CONSISTENT_PCT) & (F.col("open_hour") == 0) & (F.col("close_hour") >= LATE_HOUR)
    agrees, stable = F.coalesce(F.col("exact_pct") >= EXACT_PCT, F.lit(False)), F.col("turn_weeks") == F.col("turn_weeks_monday")
    verdict = F.when(F.col("weeks") == 0, "INCONCLUSIVE").when(F.lit(documented), "CONFIRMED").when(consistent & stable & agrees, "STRONGLY SUPPORTED").when(consistent, "INCONCLUSIVE").when(F.col("weeks") >= ENOUGH_WEEKS, "CONTRADICTED").otherwise("INCONCLUSIVE")
    return one.withColumn("verdict", verdict)


def rebuilt(book: DataFrame, keys: list[str], t: str, order: list[str], seconds: int, shift: int = 0) -> DataFrame:
    """Bars of the carried bid (rows before any bid left out): t, open, high, low, close, n. shift: seconds by which the ticks' clock is
    behind the bars'."""
    from tidemark.operators.bars import resample

    moved = book.where("bid_now is not null").withColumn("__t", F.col(t) + shift)
    return resample(moved, keys, "__t", order, "bid_now", seconds)


def compared(bars: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the export's bars, those that ticks cover, and the share of those in per cent whose prices agree, one by one and all."""
    prices = ("open", "high", "low", "close")
    theirs = bars.select(*keys, "t", *(F.col(c).alias(f"__{c}") for c in prices))
    both = theirs.join(ours.select(*keys, "t", *prices), [*keys, "t"], "left")
    same, there = {c: F.col(c) == F.col(f"__{c}") for c in prices}, F.col("close").isNotNull()
    pct = lambda test: F.round(100 * F.avg(F.when(there, test.cast("int"))), 4)
    whole = same["open"] & same["high"] & same["low"] & same["close"]
    return both.agg(F.count("*").alias("bars"), F.count_if(there).alias("covered"), F.round(100 * F.avg(there.cast("int")), 4).alias("covered_pct"), *(pct(x).alias(f"exact_{c}") for c, x in same.items()), pct(whole).alias("exact_pct"))


#: Fixed values of the rules on readiness: days of a tail without ticks, per cent of coverage and of exact bars, per cent of crossed quotes.
TAIL_DAYS, COVERED_PCT, READY_PCT, CROSSED_PCT = 0.5, 99.0, 95.0, 0.01


def readiness(facts: DataFrame) -> DataFrame:
    """kind (blocker or concern), finding, value of every rule that holds, and a last row with the recommendation. facts: one row with
    tail_days, covered_pct, out_of_order, crossed, quotes, duplicates, mismatches, stale, exact_pct, clock, missing_bars."""
    crossed = F.coalesce(F.try_divide(100 * F.col("crossed"), F.col("quotes")), F.lit(0.0))
    rules = [
        ("blocker", "out_of_order", F.col("out_of_order") > 0, F.col("out_of_order")), ("blocker", "crossed_quotes", (F.col("crossed") > 0) & (crossed >= CROSSED_PCT), F.col("crossed")),
        ("blocker", "bars_not_rebuilt", F.coalesce(F.col("exact_pct") < READY_PCT, F.lit(True)), F.col("exact_pct")), ("blocker", "clock_contradicted", F.col("clock") == "CONTRADICTED", F.lit(None)),
        ("concern", "tail_without_ticks", F.col("tail_days") > TAIL_DAYS, F.col("tail_days")), ("concern", "partial_overlap", F.col("covered_pct") < COVERED_PCT, F.col("covered_pct")),
        ("concern", "few_crossed_quotes", (F.col("crossed") > 0) & (crossed < CROSSED_PCT), F.col("crossed")), ("concern", "exact_duplicates", F.col("duplicates") > 0, F.col("duplicates")),
        ("concern", "flags_disagree", F.col("mismatches") > 0, F.col("mismatches")), ("concern", "stale_sides", F.col("stale") > 0, F.col("stale")), ("concern", "bars_without_ticks", F.col("missing_bars") > 0, F.col("missing_bars")),
        ("concern", "clock_undocumented", F.col("clock") != "CONFIRMED", F.lit(None)),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("finding"), value.cast("double").alias("value"))) for kind, name, test, value in rules)))
    blockers = F.size(F.filter("found", lambda x: x["kind"] == "blocker"))
    last = F.struct(F.lit("recommendation").alias("kind"), F.when(blockers > 1, "REQUEST DIFFERENT DATA").otherwise("GO WITH CONDITIONS").alias("finding"), blockers.cast("double").alias("value"))
    return facts.select(found.alias("found")).select(F.inline(F.concat("found", F.array(last))))


#: Fixed value: points between bids of neighbouring ticks from which a move counts as a jump.
JUMP = 500


def quality_table(book: DataFrame, keys: list[str], t: str, by: str, order: list[str], limit: int, size: int = K.TIME) -> DataFrame:
    """metric, value, pct (of all records, null for ages): what a quote book's ticks (bid, ask, last, volume, flags) hold, how far fields
    and flags agree, and what the carried quotes look like. An empty side is no missing value: it did not change. One pass over the ticks
    with the carried bid before each."""
    rows = K.previous(book, keys, by, order, {"__was": F.col("bid_now")}, size)
    has = lambda c: F.col(c).isNotNull()
    flagged = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    quoted, spread, moved = has("bid_now") & has("ask_now"), F.col("ask_now") - F.col("bid_now"), F.abs(F.col("bid_now") - F.col("__was"))
    tests = {
        "no_bid": ~has("bid"), "no_ask": ~has("ask"), "no_side": ~has("bid") & ~has("ask"), "bid_not_as_flagged": flagged(2) != has("bid"), "ask_not_as_flagged": flagged(4) != has("ask"),
        "no_flags": ~has("flags"), "with_last": has("last"), "with_volume": has("volume"), "bid_not_positive": F.col("bid") <= 0, "ask_not_positive": F.col("ask") <= 0, "quotes": quoted, "no_quote": ~quoted,
        "stale_quotes": quoted & stale(t, limit), "crossed": spread < 0, "no_spread": spread == 0, "bid_jumps": moved >= JUMP, "bid_unchanged": moved == 0,
    }
    ages = {f"oldest_{side}": F.max(F.when(quoted, F.col(t) - F.col(f"{side}_t"))) for side in ("bid", "ask")}
    one = rows.agg(F.count("*").alias("records"), *(F.count_if(x).alias(n) for n, x in tests.items()), *(x.cast("long").alias(n) for n, x in ages.items()))
    share = F.when(~F.col("metric").isin(*ages), F.round(F.try_divide(100 * F.col("value"), F.col("all")), 5))
    return one.withColumn("all", F.col("records")).unpivot("all", ["records", *tests, *ages], "metric", "value").select("metric", "value", share.alias("pct"))


def spread_tables(quotes: DataFrame, seconds: str, spread: str, fresh: Column) -> DataFrame:
    """scope (all, fresh, hour, year, month), part, n, mean and discrete quantiles of the spread. Quotes are counted by hour, month and spread
    first; what comes after grows with the distinct spreads only."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(seconds) / 86400).cast("int"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.year(day).cast("string")
    parts = {"hour": two(F.floor(F.col(seconds) / 3600) % 24), "year": year, "month": F.concat_ws("-", year, two(F.month(day)))}
    counts = quotes.where(F.col(spread).isNotNull()).groupBy(*(c.alias(n) for n, c in parts.items()), fresh.alias("fresh"), F.col(spread).alias("spread")).agg(F.count("*").alias("n"))
    labels = [("all", F.lit("")), ("fresh", F.when(F.col("fresh"), F.lit(""))), *((n, F.col(n)) for n in parts)]
    counts = counts.select("spread", "n", F.inline(F.array(*(F.struct(F.lit(scope).alias("scope"), part.alias("part")) for scope, part in labels)))).where("part is not null")
    counts = counts.groupBy("scope", "part", "spread").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("scope", "part")
    counts = counts.withColumns({"upto": F.sum("n").over(whole.orderBy("spread")), "all": F.sum("n").over(whole)})
    quantiles = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    disc = [F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("spread"))).alias(n) for n, q in quantiles.items()]
    mean = F.round(F.sum(F.col("spread") * F.col("n")) / F.sum("n"), 4).alias("mean")
    return counts.groupBy("scope", "part").agg(F.sum("n").alias("n"), F.min("spread").alias("least"), *disc, F.max("spread").alias("most"), mean)


def daily_coverage(book: DataFrame, keys: list[str], t: str, by: str, order: list[str], unit: int, size: int = K.TIME) -> DataFrame:
    """day (since 1970), ticks, first and last time, their distance, the longest step to a tick of the day, median and 95th percentile of
    the carried spread. unit: units of t a second."""
    rows = K.previous(book, keys, by, order, {"__past": F.col(t)}, size).withColumn("__spread", F.col("ask_now") - F.col("bid_now"))
    day = F.floor(F.col(t) / (86400 * unit)).cast("long").alias("day")
    counts = rows.groupBy(*keys, day, "__spread").agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), F.max(F.greatest(F.col(t) - F.col("__past"), F.lit(0))).alias("gap"))
    w = Window.partitionBy(*keys, "day")
    held = F.when(F.col("__spread").isNotNull(), F.col("n"))
    counts = counts.withColumns({"upto": F.sum(held).over(w.orderBy("__spread")), "all": F.sum(held).over(w)})
    disc = lambda q: F.min(F.when(F.col("__spread").isNotNull() & (F.col("upto") >= q * F.col("all")), F.col("__spread")))
    days = counts.groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("gap").alias("longest_gap"), disc(0.5).alias("median"), disc(0.95).alias("p95"))
    return days.withColumn("span", F.col("last") - F.col("first"))


def odd_days(days: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day, kind: weekdays within the span that hold no tick (missing_weekday), and weekend days that hold some."""
    ends = days.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    weekend = (F.col("day") + 3) % 7 >= 5
    lacking = calendar.where(~weekend).join(days.select(*keys, "day"), [*keys, "day"], "left_anti").withColumn("kind", F.lit("missing_weekday"))
    return lacking.unionByName(days.where(weekend).select(*keys, "day", F.lit("weekend_ticks").alias("kind")))
