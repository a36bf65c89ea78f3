"""Episodes, purges, controls and comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import blocks as K


def islands(rows: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """Adds `island`: a new one begins where the time since the row before is at least gap."""
    out = K.previous(rows, keys, t, [t], {"__past": F.col(t)})
    return K.running(out, keys, t, [t], {"island": F.when(F.col(t) - F.col("__past") >= gap, 1).otherwise(0).cast("long")}).drop("__past")


def greedy_starts(rows: DataFrame, keys: list[str], t: str, span: int | str, keep_equal: bool, size: int = K.TIME) -> DataFrame:
    """keys and start: the first row opens, and the next to open is the first one later than start + span (from it on, if keep_equal).
    span: a number, or a column with each row's own; of rows of one time the longest counts.

    In a block of time, every time leads to the last start that a chain through it makes there; chains soon meet, so that a block is
    summed up by a few steps. The summaries of a series are chained, and each block then lists its starts from where it is entered."""
    own = F.lit(span) if isinstance(span, int) else F.col(span)
    times = rows.groupBy(*keys, F.col(t).cast("long").alias("start")).agg(F.max(own.cast("long")).alias("until"))
    times = times.withColumn("until", F.col("start") + F.col("until")).withColumn(K.BLOCK, K.block_of(F.col("start"), size))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    side = "left" if keep_equal else "right"

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        start, until = group["start"].to_numpy(), group["until"].to_numpy()
        here, after = np.arange(len(start)), np.searchsorted(start, until, side)
        last = np.where(after < len(start), after, here)
        while not np.array_equal(again := last[last], last):
            last = again
        edge = np.flatnonzero(np.append(last[1:] != last[:-1], True))  # the last time of each step
        return pd.DataFrame([{k: group[k].iloc[0] for k in (*keys, K.BLOCK)} | {"edges": start[edge], "leads": until[last[edge]]}])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        until, out = None, []
        for row in group.sort_values(K.BLOCK).to_dict("records"):
            out.append({k: row[k] for k in (*keys, K.BLOCK)} | {"entered": until})
            step = 0 if until is None else np.searchsorted(row["edges"], until, side)
            if step < len(row["edges"]):
                until = int(row["leads"][step])
        return pd.DataFrame(out).astype({"entered": "Int64"})

    def listed(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        start, until, entered = group["start"].to_numpy(), group["until"].to_numpy(), before["entered"].iloc[0]
        at, after, found = 0 if pd.isna(entered) else int(np.searchsorted(start, int(entered), side)), np.searchsorted(start, until, side), []
        while at < len(start):
            found.append(at)
            at = int(after[at])
        return group.iloc[found][[*keys, "start", "until"]]

    ends = times.groupBy(*keys, K.BLOCK).applyInPandas(sum_up, f"{kinds}, {K.BLOCK} long, edges array<long>, leads array<long>")
    entries = ends.groupBy(*keys).applyInPandas(chain, f"{kinds}, {K.BLOCK} long, entered long")
    found = times.groupBy(*keys, K.BLOCK).cogroup(entries.groupBy(*keys, K.BLOCK)).applyInPandas(listed, f"{kinds}, start long, until long")
    return found.select(*keys, "start") if isinstance(span, int) else found


def purge_spans(events: DataFrame, keys: list[str], start: str, end: str, purge: int, horizon: int | str) -> DataFrame:
    """keys, lo, hi: [start - purge - horizon, end + purge) of each event, in which rows look ahead into it or still feel it."""
    look = F.lit(horizon) if isinstance(horizon, int) else F.col(horizon)
    return events.select(*keys, (F.col(start) - purge - look).cast("long").alias("lo"), (F.col(end) + purge).cast("long").alias("hi"))


def outside(rows: DataFrame, spans: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Rows in no [lo, hi) of spans. Spans are points of their start that carry the furthest end so far, over blocks of time; a row looks
    at the last one that began, so no range join."""
    points = spans.select(*keys, F.col("lo").alias("__at"), F.lit(0).alias("__side"), F.col("hi").alias("__hi"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("__row"))
    ours = rows.select(*keys, F.col(t).cast("long").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__hi"), F.struct(*rows.columns).alias("__row"))
    both = points.unionByName(ours).withColumn(K.BLOCK, K.block_of(F.col("__at"), K.TIME))
    past = Window.partitionBy(*keys).orderBy(K.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    reach = both.groupBy(*keys, K.BLOCK).agg(F.max("__hi").alias("__reach")).withColumn("__reach", F.max("__reach").over(past))
    here = Window.partitionBy(*keys, K.BLOCK).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = K._with_carries(both.withColumn("__here", F.max("__hi").over(here)), reach, keys, ["__reach"])
    furthest = F.greatest("__here", "__reach")
    return joined.where((F.col("__side") == 1) & (furthest.isNull() | (F.col("__at") >= furthest))).select("__row.*")


def seeded(seed: int, *columns: str) -> Column:
    """A reproducible order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def placed(rows: DataFrame, cell: list[str], t: str, seed: int) -> DataFrame:
    """Adds __r, the place of a row in the seeded order of its cell (from 1), and __size, the rows of the cell. The order is by a hash, so
    its first digits cut a cell into parts of like size; a part's rows are ranked alone and follow those of the parts before."""
    rows = rows.withColumn("__hash", seeded(seed, t)).withColumn(K.BLOCK, F.conv(F.substring("__hash", 1, 3), 16, 10).cast("long"))
    whole = Window.partitionBy(*cell)
    before = whole.orderBy(K.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*cell, K.BLOCK).agg(F.count("*").alias("__part"))
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__part").over(before), F.lit(0)), "__size": F.sum("__part").over(whole)})
    own = F.row_number().over(Window.partitionBy(*cell, K.BLOCK).orderBy("__hash", t))
    out = K._with_carries(rows.withColumn("__r", own), parts, cell, ["__before", "__size"])
    return out.withColumn("__r", F.col("__r") + F.col("__before")).drop("__hash", "__before", K.BLOCK)


def matched_controls(events: DataFrame, pool: DataFrame, cell: list[str], event_t: str, pool_t: str, n: int, seed: int) -> DataFrame:
    """cell, event time, slot, control time: each cell's pool stands in seeded order once; its events in order of time take the next n
    with a cursor that wraps round, none twice for one event."""
    ranked = placed(pool, cell, pool_t, seed).drop("__size").withColumn("__r", F.col("__r") - 1)
    sizes = pool.groupBy(*cell).agg(F.count("*").alias("__n"))
    asked = K.numbered(events, cell, event_t, name="__e").join(sizes, cell)
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("__n")).cast("int") - 1)))
    asked = asked.withColumn("__r", ((F.col("__e") * n + F.col("slot")) % F.col("__n")).cast("long"))
    return asked.join(ranked, [*cell, "__r"]).select(*cell, event_t, "slot", pool_t)


def stratified(rows: DataFrame, stratum: str, share: float, t: str, seed: int) -> DataFrame:
    """round(share * size) rows of each stratum (half to even), without replacement."""
    return placed(rows, [stratum], t, seed).where(F.col("__r") <= F.bround(F.col("__size") * share)).drop("__r", "__size")


def mean_difference(group: Column, value: str) -> Column:
    """Standardised mean difference of value between rows that group holds for and the others: 0 for equal means, else null without spread."""
    one, two = F.when(group, F.col(value)), F.when(~group, F.col(value))
    gap, pooled = F.avg(one) - F.avg(two), F.sqrt((F.var_pop(one) + F.var_pop(two)) / 2)
    return F.when(gap == 0, F.lit(0.0)).when(pooled > 0, gap / pooled)


def direct_standardisation(rows: DataFrame, state: str, cell: list[str], outcome: str) -> DataFrame:
    """One row: rate in the state, baseline (rates outside it, weighted by the state's common cells), covered weight, cells."""
    cells = rows.groupBy(*cell).agg(F.count_if(state).alias("s"), F.count_if(~F.col(state)).alias("o"), F.sum(F.when(~F.col(state), F.col(outcome))).alias("hits"), F.sum(F.when(F.col(state), F.col(outcome))).alias("own"))
    both = (F.col("s") > 0) & (F.col("o") > 0)
    weight = F.sum(F.when(both, F.col("s")))
    return cells.agg(
        F.try_divide(F.sum("own"), F.sum("s")).alias("state_rate"), F.try_divide(F.sum(F.when(both, F.col("s") * F.col("hits") / F.col("o"))), weight).alias("baseline"),
        F.try_divide(weight, F.sum("s")).alias("covered"), F.count_if(both).alias("cells"),
    )


def quantile_bins(value: str, edges: list[str]) -> Column:
    """Right-closed bins between edge columns; -1 for null."""
    out = F.when(F.col(value).isNull(), -1)
    for i, edge in enumerate(edges):
        out = out.when(F.col(value) <= F.col(edge), i)
    return out.otherwise(len(edges))


def collapsed(rows: DataFrame, keys: list[str], t: str, span: str, extra: int, most: list[str], least: list[str]) -> DataFrame:
    """Episodes: the rows that open one, with start, end (start + their span), n (rows within the span and the extra separation of the
    start), and the widest values of the columns `most` and `least` over those."""
    from tidemark.operators.bars import asof

    reach = rows.withColumn("__reach", F.col(span) + extra)
    starts = greedy_starts(reach, keys, t, "__reach", keep_equal=False).drop("until")
    joined = asof(rows, starts, keys, t, "start", [])
    wide = [*(F.max(c).alias(f"__{c}") for c in most), *(F.min(c).alias(f"__{c}") for c in least)]
    groups = joined.groupBy(*keys, "start").agg(F.count("*").alias("n"), F.max(F.when(F.col(t) == F.col("start"), F.struct(span, *(c for c in rows.columns if c not in (*keys, span))))).alias("__row"), *wide)
    kept = [F.col(f"__{c}").alias(c) if c in (*most, *least) else F.col("__row")[c].alias(c) for c in rows.columns if c not in keys]
    return groups.select(*keys, *kept, "start", (F.col("start") + F.col("__row")[span]).alias("end"), "n")


def thinned(rows: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """The rows that are kept when each must come at least `gap` after the last one kept, with the number n of those they stand for."""
    from tidemark.operators.bars import asof

    starts = greedy_starts(rows, keys, t, gap, keep_equal=True)
    counts = asof(rows.select(*keys, t), starts, keys, t, "start", []).groupBy(*keys, F.col("start").alias(t)).agg(F.count("*").alias("n"))
    return rows.join(counts, [*keys, t])


def context_label(direction: Column, compressed: Column, expanded: Column) -> Column:
    after = F.when(compressed, "_after_compression").otherwise("_without_compression")
    return F.when(~expanded, "compressed_no_major_expansion").otherwise(F.concat(F.lit("major_"), direction, after))


def overlap(counts: DataFrame) -> DataFrame:
    """Adds to eligible, candidates, episodes: rows that stand for no episode of their own, rows an episode, rate of candidates in per cent
    (0 where there is nothing to divide by)."""
    share = lambda a, b, digits: F.coalesce(F.round(F.try_divide(a, b), digits), F.lit(0.0))
    return counts.withColumns({
        "suppressed": F.col("candidates") - F.col("episodes"), "rows_per_episode": share(F.col("candidates"), F.col("episodes"), 2), "candidate_rate_pct": share(100 * F.col("candidates"), F.col("eligible"), 4),
    })


def quality_summary(bars: DataFrame) -> DataFrame:
    """One row of source_quality's bars: numbers by kind of gap, the share of partial ones in per cent, the least ratio, and the five with
    the fewest source bars as text."""
    gap = lambda kind: F.col("gap") == kind
    worst = bars.where(gap("partial_gap")).orderBy("n_base", "t").limit(5).agg(F.array_sort(F.collect_list(F.struct("n_base", "t", "expected"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: F.format_string("%s(%d/%d)", F.date_format(F.timestamp_seconds(x["t"]), "yyyy-MM-dd HH:mm"), x["n_base"], x["expected"])), "; ")
    one = bars.agg(F.count("*").alias("bars"), F.count_if("complete").alias("whole"), F.count_if(gap("market_closed")).alias("market_closed"), F.count_if(gap("partial_gap")).alias("partial_gap"), F.round(100 * F.avg(gap("partial_gap").cast("int")), 4).alias("pct_partial"), F.round(F.min("ratio"), 4).alias("least_ratio"))
    return one.crossJoin(worst.select(F.when(text == "", "none").otherwise(text).alias("worst")))  # one row each


def balance(events: DataFrame, controls: DataFrame, variables: list[str], kind: str, kinds: list[str] | None = None) -> DataFrame:
    """control type, variable: numbers, standardised difference, largest gap between the shares of a value, the criterion that fits the
    variable, and whether it is met. Text has no mean, so it is judged by its shares. kinds: the control types to report, also where no
    control of theirs was found (not named: those that controls hold). Without events or without controls the gap is null and nothing is met."""
    numeric = {f.name for f in events.schema.fields if f.dataType.typeName() not in ("string", "boolean")}
    cells = lambda: F.inline(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value"), (F.col(v).cast("double") if v in numeric else F.lit(None).cast("double")).alias("x")) for v in variables)))
    if kinds is None:
        ours = events.select(cells()).crossJoin(F.broadcast(controls.select(kind).distinct()))  # a few words
    else:
        ours, controls = events.withColumn(kind, F.explode(F.array(*map(F.lit, kinds)))).select(kind, cells()), controls.where(F.col(kind).isin(kinds))
    both = ours.withColumn("event", F.lit(True)).unionByName(controls.select(kind, cells()).withColumn("event", F.lit(False)))
    sums = both.groupBy(kind, "variable").agg(F.count(F.when(F.col("event"), F.col("value"))).alias("event_n"), F.count(F.when(~F.col("event"), F.col("value"))).alias("control_n"), mean_difference(F.col("event"), "x").alias("smd"))
    counts = both.where("value is not null").groupBy(kind, "variable", "value").agg(F.count_if("event").alias("a"), F.count_if(~F.col("event")).alias("b"))
    gaps = counts.join(sums, [kind, "variable"]).groupBy(kind, "variable").agg(F.max(F.abs(F.try_divide("a", "event_n") - F.try_divide("b", "control_n"))).alias("gap"))
    out, by_share = sums.join(gaps, [kind, "variable"]), F.col("smd").isNull()
    criterion = F.when(by_share, "max_category_share_gap<0.05").otherwise("abs_smd<0.1")
    return out.select(kind, "variable", "event_n", "control_n", F.round("smd", 4).alias("smd"), F.round("gap", 4).alias("gap"), criterion.alias("criterion"), F.when(by_share, F.coalesce(F.col("gap") < 0.05, F.lit(False))).otherwise(F.abs("smd") < 0.1).alias("balanced"))


def evaluated_states(rows: DataFrame, stratum: list[str], cell: list[str], states: list[str], outcome: str = "hit") -> DataFrame:
    """stratum, state: rows in the state and their share of all, rate, baseline (rates of rows outside the state, weighted by the state's
    cells that both have), the weight those cover, their number, difference, lift, medians of fwd_pips, max_up and max_down; B0 is the
    whole market. rows: `states` is an array of the names that hold.

    Cells are counted once for all states: outside a state is all less inside."""
    hit, measures = F.col(outcome).cast("int"), ("fwd_pips", "max_up", "max_down")
    medians = [F.median(c).alias(f"median_{c}") for c in measures]
    total = rows.groupBy(*stratum).agg(F.count("*").alias("all"), F.avg(hit).alias("all_rate"), *medians)
    inside = rows.withColumn("state", F.explode("states"))
    per = inside.groupBy(*stratum, "state").agg(F.count("*").alias("n"), F.avg(hit).alias("rate"), *medians)
    every = rows.groupBy(*stratum, *cell).agg(F.count("*").alias("all_n"), F.sum(hit).alias("all_hits"))
    cells = inside.groupBy(*stratum, "state", *cell).agg(F.count("*").alias("s"), F.sum(hit).alias("own")).join(every, [*stratum, *cell])
    cells = cells.withColumns({"o": F.col("all_n") - F.col("s"), "hits": F.col("all_hits") - F.col("own")})
    both = F.col("o") > 0
    weight = F.sum(F.when(both, F.col("s")))
    based = cells.groupBy(*stratum, "state").agg(F.try_divide(F.sum(F.when(both, F.col("s") * F.col("hits") / F.col("o"))), weight).alias("baseline"), F.coalesce(weight / F.sum("s"), F.lit(0.0)).alias("covered"), F.count_if(both).alias("cells"))
    out = per.join(based, [*stratum, "state"]).join(total.select(*stratum, "all"), stratum)
    named = [F.round(f"median_{c}", 3).alias(f"median_{c}") for c in measures]
    out = out.select(
        *stratum, "state", "n", F.round("rate", 5).alias("rate"), F.round("baseline", 5).alias("baseline"), F.round(100 * (F.col("rate") - F.col("baseline")), 3).alias("difference_pp"),
        F.round(F.when(F.col("baseline") > 0, 100 * (F.col("rate") / F.col("baseline") - 1)), 2).alias("lift_pct"), F.round("covered", 4).alias("covered"), "cells", F.round(100 * F.col("n") / F.col("all"), 3).alias("share_pct"), *named,
    )
    none = lambda kind: F.lit(None).cast(kind)
    market = total.select(*stratum, F.lit("B0_eligible_market").alias("state"), F.col("all").alias("n"), F.round("all_rate", 5).alias("rate"), none("double").alias("baseline"), none("double").alias("difference_pp"), none("double").alias("lift_pct"), none("double").alias("covered"), F.lit(0).cast("long").alias("cells"), F.lit(100.0).alias("share_pct"), *named)
    return out.unionByName(market)


#: The least difference that counts as material, and the rows that make it worth reading.
MATERIAL_PP, READABLE_ROWS = 2.0, 200


def ladder_verdict(states: DataFrame, stratum: list[str]) -> DataFrame:
    """Per stratum: the state with the largest difference either way (of those with enough rows, or of all if none has), whether it is
    material, and whether compression with a crossing, and with the higher timeframe too, raises the rate beyond compression alone."""
    real = states.where(~F.col("state").startswith("B"))
    enough = F.when(F.col("n") >= READABLE_ROWS, 1).otherwise(0)
    best = F.max_by(F.struct("state", "difference_pp"), F.when(F.col("difference_pp").isNotNull(), F.struct(enough, F.abs("difference_pp"), "state")))
    of = lambda prefix: F.max(F.when(F.regexp_like("state", F.lit(f"^{prefix}_(up|down)$")), F.col("difference_pp")))
    out = real.groupBy(*stratum).agg(best.alias("best"), of("compression").alias("compression_pp"), of("compression_crossing").alias("crossing_pp"), of("compression_crossing_higher").alias("full_pp"))
    beats = lambda c: F.coalesce(F.col(c) > F.col("compression_pp") + 0.5, F.lit(False))
    return out.select(*stratum, F.col("best.state").alias("best"), F.col("best.difference_pp").alias("best_pp"), F.coalesce(F.abs("best.difference_pp") >= MATERIAL_PP, F.lit(False)).alias("material"), beats("crossing_pp").alias("crossing_helps"), beats("full_pp").alias("full_stack_helps"))


def independent_counts(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: all rows, those that each test excludes on its own, and those that none does."""
    every = [~F.coalesce(t, F.lit(True)) for t in tests.values()]
    clear = every[0]
    for t in every[1:]:
        clear = clear & t
    return rows.agg(F.count("*").alias("all_rows"), *(F.count_if(F.coalesce(t, F.lit(True))).alias(n) for n, t in tests.items()), F.count_if(clear).alias("eligible"))


def random_in_context(events: DataFrame, pool: DataFrame, cell: list[str], pool_t: str, total: int, seed: int) -> DataFrame:
    """Rows of the pool drawn without replacement, in each cell in proportion to the cell's share of the events (half to even)."""
    everything = Window.partitionBy()
    shares = events.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("want", F.bround(F.col("n") / F.sum("n").over(everything) * total).cast("long"))
    ranked = placed(pool, cell, pool_t, seed)
    return ranked.join(shares.drop("n"), cell).where(F.col("__r") <= F.col("want")).drop("__r", "__size", "want")


def first_reason(tests: dict[str, Column]) -> Column:
    """The name of the first test that holds, in their order; null if none does."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        out = F.when(test, name).otherwise(out)
    return out


def breakdown(events: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """Numbers and means by one column, as text so that breakdowns can stand under one another."""
    means = [F.round(F.avg(F.col(c).cast("double")), 6).alias(f"mean_{c}") for c in measures]
    return events.groupBy(F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"), *means).select(F.lit(by).alias("by"), "*")


#: Fixed value: rows of either population from which a comparison can be read.
LEAST_ROWS = 30


def _sides(events: DataFrame, controls: DataFrame, keys: list[str], cells: list[Column]) -> DataFrame:
    """keys, outcome and the cells' other fields as structs e and c: one aggregate for all outcomes of each population."""
    one = lambda df, side: df.groupBy(*keys).agg(F.array(*cells).alias("cells")).select(*keys, F.explode("cells").alias(side)).withColumn("outcome", F.col(f"{side}.outcome"))
    return one(events, "e").join(one(controls, "c"), [*keys, "outcome"], "left")


def compared_rates(events: DataFrame, controls: DataFrame, keys: list[str], outcomes: list[str], event: tuple[str, str, str] | None = None, either: bool = False) -> DataFrame:
    """keys, outcome: numbers and rates of both populations, difference in points of a hundred, lift in per cent, whether the comparison
    says nothing because an event's definition makes the outcome true, or a control's makes it false, and whether it can be read.
    outcomes: 0/1 or boolean columns; event: the keys that hold the event's direction, threshold and horizon (none: nothing is implied).
    Controls are rows without that move, or without it in either direction."""
    from tidemark.operators.validation import label_of

    def cell(c: str) -> Column:
        direction, threshold, horizon = label_of(c) or (None, None, None)
        parts = {"outcome": F.lit(c), "n": F.count(c), "rate": F.avg(F.col(c).cast("int")), "direction": F.lit(direction).cast("string"), "threshold": F.lit(threshold).cast("double"), "horizon": F.lit(horizon).cast("int")}
        return F.struct(*(x.alias(n) for n, x in parts.items()))

    out = _sides(events, controls, keys, [cell(c) for c in outcomes])
    rate, other = F.col("e.rate"), F.col("c.rate")
    least = F.least("e.n", F.coalesce("c.n", F.lit(0).cast("long")))
    by_event = by_control = F.lit(False)
    if event:
        direction, threshold, horizon = (F.col(k) for k in event)
        same = F.col("e.direction") == direction
        by_event = F.coalesce(same & (F.col("e.threshold") <= threshold) & (F.col("e.horizon") >= horizon), F.lit(False))
        by_control = F.coalesce((F.col("e.direction").isNotNull() if either else same) & (F.col("e.threshold") >= threshold) & (F.col("e.horizon") <= horizon), F.lit(False))
    made = {
        "event_n": F.col("e.n"), "control_n": F.coalesce("c.n", F.lit(0).cast("long")), "event_rate": F.round(rate, 5), "control_rate": F.round(other, 5), "difference_pp": F.round(100 * (rate - other), 3),
        "lift_pct": F.round(F.when(other > 0, 100 * (rate / other - 1)), 2), "event_implied": by_event, "control_implied": by_control, "least_n": least, "interpretable": (least >= LEAST_ROWS) & ~by_event & ~by_control,
    }
    return out.select(*keys, "outcome", *(x.alias(n) for n, x in made.items()))


def compared_magnitudes(events: DataFrame, controls: DataFrame, keys: list[str], outcomes: list[str]) -> DataFrame:
    """keys, outcome: numbers, means and medians of both populations and their differences, and whether the comparison can be read."""
    cells = [F.struct(F.lit(c).alias("outcome"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median")) for c in outcomes]
    out, least = _sides(events, controls, keys, cells), F.least("e.n", F.coalesce("c.n", F.lit(0).cast("long")))
    both = [F.round(F.col(f"{side}.{x}"), 3).alias(f"{name}_{x}") for side, name in (("e", "event"), ("c", "control")) for x in ("mean", "median")]
    gaps = [F.round(F.col(f"e.{x}") - F.col(f"c.{x}"), 3).alias(f"{x}_difference") for x in ("mean", "median")]
    return out.select(*keys, "outcome", F.col("e.n").alias("event_n"), F.coalesce("c.n", F.lit(0).cast("long")).alias("control_n"), *both, *gaps, least.alias("least_n"), (least >= LEAST_ROWS).alias("interpretable"))
