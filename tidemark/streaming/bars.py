"""Structured Streaming: bars that appear once they are closed, and a quote book carried from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def instant(ts: str) -> Column:
    """A zone-less time as the instant with the same clock in UTC, which watermarks need."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"))


def closed_bars(ticks: DataFrame, keys: list[str], ts: str, order: list[str], price: str, seconds: int, delay: str) -> DataFrame:
    """Open, high, low, close and count per bin of `seconds`, in append mode: a bar comes out once, when the watermark (the newest time less
    `delay`) has passed its end, so that a forming bar is never seen. State is one row per open bar. Later ticks than that are dropped by
    the watermark and counted in the query's progress (numRowsDroppedByWatermark)."""
    by = F.struct(*order)
    bars = ticks.withColumn("__at", instant(ts)).withWatermark("__at", delay).groupBy(F.window("__at", f"{seconds} seconds").alias("__w"), *keys).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.count("*").alias("n"),
    )
    return bars.select(*keys, F.unix_seconds("__w.start").alias("t"), "open", "high", "low", "close", "n")


def closed_groups(ticks: DataFrame, keys: list[str], ts: str, columns: list[str], delay: str) -> DataFrame:
    """keys, ts, columns, n: how often a tick occurs that is equal in all of them, in append mode: a group comes out once the watermark has
    passed its time, so that a time whose ticks reach over batches is counted whole. State is a number a group, however many its ticks."""
    counted = ticks.withColumn("__at", instant(ts)).withWatermark("__at", delay).groupBy("__at", *keys, ts, *columns).agg(F.count("*").alias("n"))
    return counted.drop("__at")


def carried_quotes(ticks: DataFrame, key: str, t: str, seq: str, limit: int) -> DataFrame:
    """key, t, seq, bid_now, ask_now, stale, late of each tick, both sides carried forward over batches; state is five numbers per key.

    Ticks of one batch are taken in order of (t, seq). A tick older than the newest of the batches before is marked late and counted, and is
    neither dropped nor put in its place. stale: a side that has a quote is older than limit."""
    key_type = ticks.schema[key].dataType.simpleString()

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bid, ask, bid_t, ask_t, newest = state.get if state.exists else (None,) * 5
        rows = pd.concat(list(parts)).sort_values([t, seq], kind="stable")
        out = pd.DataFrame({key: rows[key], t: rows[t].astype("int64"), seq: rows[seq].astype("int64")})
        for side, value, since in (("bid", bid, bid_t), ("ask", ask, ask_t)):
            now, at = rows[side].astype("Int64"), rows[t].astype("Int64").where(rows[side].notna())
            out[f"{side}_now"] = now.ffill().fillna(value) if value is not None else now.ffill()
            out[f"{side}_t"] = at.ffill().fillna(since) if since is not None else at.ffill()
        out["stale"] = ((out[t] - out["bid_t"] > limit).fillna(False) | (out[t] - out["ask_t"] > limit).fillna(False)).astype(bool)
        out["late"] = out[t] < newest if newest is not None else False
        last = out.iloc[-1]
        held = tuple(None if pd.isna(x) else int(x) for x in (last["bid_now"], last["ask_now"], last["bid_t"], last["ask_t"]))
        state.update((*held, max(int(out[t].max()), newest if newest is not None else int(out[t].max()))))
        yield out[[key, t, seq, "bid_now", "ask_now", "stale", "late"]]

    schema = f"`{key}` {key_type}, `{t}` long, `{seq}` long, bid_now long, ask_now long, stale boolean, late boolean"
    rows = ticks.select(key, F.col(t).cast("long").alias(t), F.col(seq).cast("long").alias(seq), F.col("bid").cast("long").alias("bid"), F.col("ask").cast("long").alias("ask"))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "bid long, ask long, bid_t long, ask_t long, newest long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet files with a checkpoint beside them, and reads those files. A restart with the same
    path goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
