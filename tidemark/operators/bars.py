"""Bars: tumbling resampling, coverage, tails and as-of alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks as K


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def resample(ticks: DataFrame, keys: list[str], t: str, order: list[str], price: str, seconds: int, right: bool = False) -> DataFrame:
    """Open, high, low, close and count of `price` per bin of `seconds`. Bins are left-closed and carry their start as `t`, or, with
    `right`, right-closed and carry their end. Partial aggregates shuffle one row per bin and task."""
    bin_ = F.ceil(F.col(t) / seconds) if right else F.floor(F.col(t) / seconds)
    by = F.struct(*order)
    return ticks.where(F.col(price).isNotNull()).groupBy(*keys, (bin_ * seconds).cast("long").alias("bar")).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.count("*").alias("n"),
    ).withColumnRenamed("bar", "t")


def rebar(bars: DataFrame, keys: list[str], seconds: int, last: tuple[str, ...] = ()) -> DataFrame:
    """Bars of `seconds` from shorter ones (t, open, high, low, close), with the number of bars in each, the closing time c_t and the last
    values of the columns named in `last`."""
    start = (F.floor(F.col("t") / seconds) * seconds).cast("long")
    return bars.groupBy(*keys, start.alias("bar")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.count("*").alias("n_base"),
        *(F.max_by(c, "t").alias(c) for c in last),
    ).select(*keys, F.col("bar").alias("t"), (F.col("bar") + seconds).alias("c_t"), "open", "high", "low", "close", "n_base", *last)


def drop_open_tail(bars: DataFrame, source: DataFrame, t: str, seconds: int) -> DataFrame:
    """Bars that end no later than the source's last time; that time is one row."""
    last = source.agg(F.max(t).alias("last_time"))
    return bars.crossJoin(F.broadcast(last)).where(F.col("t") + seconds <= F.col("last_time")).drop("last_time")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], size: int = K.TIME) -> DataFrame:
    """Every left row with the payload of the latest right row at or before its time, null without one: one union and one window over
    blocks of time with carries, no range join."""
    nothing = F.lit(None).cast(right.select(F.struct(right_time, *payload)).schema[0].dataType)
    ours = left.select(*keys, F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), nothing.alias("__right"))
    theirs = right.select(*keys, F.col(right_time).alias("__time"), F.lit(0).alias("__side"), F.lit(None).cast(ours.schema["__left"].dataType).alias("__left"), F.struct(right_time, *payload).alias("__right"))
    found = K.carried(ours.unionByName(theirs).where("__time is not null or __side = 1"), keys, "__time", ["__time", "__side"], {"__found": F.col("__right")}, size)
    return found.where("__side = 1").select("__left.*", *(F.col(f"__found.{c}").alias(c) for c in [right_time, *payload] if c not in left.columns))
