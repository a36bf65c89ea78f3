"""Registered queries of text sources, artefacts, streams and the tape's reports. See plans/queries.py for the tables they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blocks as K
from tidemark.operators import ticks as T
from tidemark.plans.queries import _BASE, _QUOTES, _SPREAD, _TAPE, HOUR, KEY, _bars, book, hourly, query, spreads, tape
from tidemark.sources import artefacts as A
from tidemark.sources import text as E
from tidemark.streaming import bars as M

# --- text -------------------------------------------------------------------------------------------------------------------


def _clock(seconds, pattern):
    return F.date_format(F.expr(f"timestampadd(SECOND, {seconds}, timestamp_ntz'1970-01-01 00:00:00')"), pattern)


@query(f"{_BASE} SELECT symbol, count(*) AS rows, min(t) AS first_t, max(t) AS last_t, CAST(sum(round(open)) AS BIGINT) AS opens, CAST(sum(close) AS BIGINT) AS closes, CAST(sum(n) AS BIGINT) AS ticks FROM bars GROUP BY symbol")
def bars_from_text(spark, sf_dir):
    """Hourly bars written as the export's tab-separated text, one folder per symbol, and read back."""
    path = A.scratch(spark, "bars")
    price = lambda c: F.format_string("%.5f", F.col(c) / 100000.0).alias(f"<{c.upper()}>")
    rows = hourly(spark, sf_dir)
    text = rows.select("symbol", _clock("t", "yyyy.MM.dd").alias("<DATE>"), _clock("t", "HH:mm:ss").alias("<TIME>"), *map(price, ("open", "high", "low", "close")), F.col("n").alias("<TICKVOL>"), F.lit(0).alias("<VOL>"), F.lit(12).alias("<SPREAD>"))
    text.write.partitionBy("symbol").csv(path, sep="\t", header=True)
    names = sorted(r.symbol for r in rows.select("symbol").distinct().collect())  # one row per instrument
    out = None
    for name in names:
        one = E.read_bars(spark, f"{path}/symbol={name}", HOUR).withColumn("symbol", F.lit(name))
        out = one if out is None else out.unionByName(one)
    t = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', open_time)")
    points = lambda c: F.sum(F.rint(F.col(c) / 0.00001).cast("long"))
    return out.groupBy("symbol").agg(F.count("*").alias("rows"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), points("open").alias("opens"), points("close").alias("closes"), F.sum(F.col("tick_volume").cast("long")).alias("ticks"))


@query(f"WITH {_TAPE} SELECT count(*) AS rows, count(*) FILTER (event_id % 97 = 0) AS malformed, count(*) FILTER (event_id % 97 <> 0 AND event_id % 89 = 0) AS bad_times, count(*) FILTER (event_id % 97 <> 0 AND symbol <> 'view') AS no_bid, count(*) FILTER (event_id % 97 <> 0 AND symbol <> 'click') AS no_ask, count(*) FILTER (event_id % 97 <> 0 AND symbol = 'error') AS flag_mismatches FROM tape")
def tick_text_quality(spark, sf_dir):
    """Ticks written as text with short rows and impossible dates among them, sniffed and read back."""
    path = A.scratch(spark, "ticks")
    side = lambda name: F.when(F.col("symbol") == name, F.format_string("%.5f", F.col("p") / 100000.0)).otherwise("")
    day = F.when(F.col("event_id") % 89 == 0, "2024.13.01").otherwise(_clock("s", "yyyy.MM.dd"))
    flags = F.when(F.col("symbol") == "view", 2).when(F.col("symbol") == "click", 4).when(F.col("symbol") == "error", 2).otherwise(0)
    line = F.concat_ws("\t", day, F.concat(_clock("s", "HH:mm:ss"), F.lit(".000")), side("view"), side("click"), F.lit(""), F.lit(""), flags.cast("string"))
    line = F.when(F.col("event_id") % 97 == 0, F.concat_ws("\t", day, F.lit("12:00:00.000"), F.lit("1"))).otherwise(line)
    rows = tape(spark, sf_dir).select("event_id", line.alias("value"))
    rows.select("value").mapInArrow(_headed("<" + ">\t<".join(E.TICK_COLUMNS) + ">"), "value string").write.text(path)
    first = next(iter(spark.read.text(path).inputFiles()))
    form = E.sniff(E.prefix_of(spark, first))
    return E.field_quality(E.read_ticks(spark, path, form, 0.00001)).drop("examples")


def _headed(header: str):
    """Puts a header before each partition's lines: every partition becomes a file."""

    def run(batches):
        import pyarrow as pa

        begun = False
        for batch in batches:
            if not begun:
                yield pa.RecordBatch.from_pydict({"value": [header]}, schema=batch.schema)
                begun = True
            yield batch

    return run


# --- artefacts --------------------------------------------------------------------------------------------------------------


@query(f"{_BASE} SELECT 'bars' AS \"table\", count(*) AS rows, count(DISTINCT t) AS keys, 0 AS lacking, 0 AS beyond FROM bars UNION ALL SELECT 'odd', count(*) FILTER (t // 3600 % 2 = 1), count(DISTINCT t) FILTER (t // 3600 % 2 = 1), count(DISTINCT t) FILTER (t // 3600 % 2 = 0), 0 FROM bars")
def same_keys(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return A.same_keys({"bars": rows, "odd": rows.where("t div 3600 % 2 = 1")}, "t")


@query(f"{_BASE} SELECT symbol, t, close FROM bars ORDER BY abs(t - 1705319999), t, symbol LIMIT 5")
def nearest_bars(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("symbol", "t", "close")
    return rows.orderBy(F.abs(F.col("t") - 1705319999), "t", "symbol").limit(5)


@query(f"WITH {_TAPE} SELECT symbol, event_id, s FROM tape WHERE s >= 1705276800 ORDER BY s, event_id LIMIT 100")
def ticks_from_time(spark, sf_dir):
    return E.from_time(tape(spark, sf_dir), "s", 1705276800, 100, ["event_id"]).select("symbol", "event_id", "s")


@query("WITH w AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 45) SELECT o.o_orderstatus, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o WHERE o.o_orderkey IN (SELECT l_orderkey FROM w) GROUP BY 1")
def pruned_semi_scan(spark, sf_dir):
    """Rows of one table whose keys occur in another: a semi join on the distinct keys, two columns of either scan."""
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate >= timestamp_ntz'1998-01-01' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.join(keys, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- reports of the tape ----------------------------------------------------------------------------------------------------


@query(f"WITH {_TAPE}, {_QUOTES}, w AS (SELECT s, CAST(s // 3600 % 24 AS INT) AS hour, abs(ask_now - bid_now) AS wide FROM book WHERE ask_now - bid_now IS NOT NULL) SELECT hour, CAST(s // 86400 AS BIGINT) AS day, count(*) AS n, min(wide) AS low, quantile_disc(wide, 0.5) AS median, quantile_disc(wide, 0.95) AS p95, max(wide) AS high FROM w GROUP BY GROUPING SETS ((), (1), (2))")
def spread_tables(spark, sf_dir):
    rows = spreads(spark, sf_dir).withColumn("wide", F.abs(F.col("ask_now") - F.col("bid_now"))).withColumn("day", F.floor(F.col("s") / 86400).cast("long"))
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by wide)").cast("long")
    return rows.groupingSets([[], ["hour"], ["day"]], "hour", "day").agg(F.count("*").alias("n"), F.min("wide").alias("low"), disc(0.5).alias("median"), disc(0.95).alias("p95"), F.max("wide").alias("high"))


@query(f"WITH {_TAPE}, {_QUOTES}, h AS (SELECT CAST(s // 3600 % 24 AS INT) AS hour, median(abs(ask_now - bid_now)) AS m FROM book WHERE ask_now - bid_now IS NOT NULL GROUP BY 1) SELECT arg_max(hour, (m, -hour)) AS widest, round(max(m), 4) AS widest_median, round(median(m), 4) AS typical, round(max(m) / median(m), 4) AS ratio, (arg_max(hour, (m, -hour)) + 17) % 24 AS new_york_hour FROM h")
def rollover_hour(spark, sf_dir):
    """The hour of the widest median spread, the earliest of equals; the tape's clock runs 7 hours ahead of New York."""
    hours = spreads(spark, sf_dir).groupBy("hour").agg(F.median(F.abs(F.col("ask_now") - F.col("bid_now"))).alias("m"))
    widest = F.max_by("hour", F.struct("m", -F.col("hour")))
    return hours.agg(widest.alias("widest"), F.round(F.max("m"), 4).alias("widest_median"), F.round(F.median("m"), 4).alias("typical"), F.round(F.max("m") / F.median("m"), 4).alias("ratio"), ((widest + 17) % 24).alias("new_york_hour"))


_TURNS = "t AS (SELECT make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INT) AS day FROM range(1990, 2007) r(y) UNION ALL SELECT make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INT) FROM range(1990, 2007) r(y))"


@query(f"WITH {_TURNS}, w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1) SELECT strftime(week, '%Y-%m-%d') AS week, n FROM w WHERE EXISTS (SELECT 1 FROM t WHERE t.day >= week AND t.day < week + 7)")
def clock_change_weeks(spark, sf_dir):
    """Weeks (from Monday) in which New York's clock changes: its offset at the week's end differs from that at its start."""
    weeks = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("w")).agg(F.count("*").alias("n"))
    offset = lambda x: F.from_utc_timestamp(x, "America/New_York").cast("timestamp_ntz") - x
    end = F.col("w") + F.expr("INTERVAL 7 DAYS")
    return weeks.where(offset(F.col("w")) != offset(end)).select(F.date_format("w", "yyyy-MM-dd").alias("week"), "n")


@query("""SELECT 'event_id' AS field, count(event_id) AS present, CAST(min(event_id) AS VARCHAR) AS low, CAST(max(event_id) AS VARCHAR) AS high FROM events
UNION ALL SELECT 'user_id', count(user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM events UNION ALL SELECT 'event_type', count(event_type), min(event_type), max(event_type) FROM events""")
def field_table(spark, sf_dir):
    """One pass: present values and range of each field."""
    names = ["event_id", "user_id", "event_type"]
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = rows.agg(*(F.struct(F.lit(c).alias("field"), F.count(c).alias("present"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(c) for c in names))
    return one.select(F.inline(F.array(*names)))


# --- streams ----------------------------------------------------------------------------------------------------------------


def stream_of(spark, sf_dir, columns: str):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).selectExpr("event_type AS symbol", "ts", "event_id", "cast(round(value * 100) as bigint) AS p").selectExpr(columns.split("|"))


@query(f"WITH {_TAPE}, {_bars()} SELECT symbol, t, open, high, low, close, n FROM bars WHERE c_t <= (SELECT max(epoch(ts)) - 600 FROM tape)")
def streaming_bars(spark, sf_dir):
    """Hourly bars as a stream: those that the watermark (10 minutes behind the newest tick) has passed."""
    ticks = stream_of(spark, sf_dir, "symbol|ts|event_id|p")
    return M.run_to_end(M.closed_bars(ticks, KEY, "ts", ["ts", "event_id"], "p", HOUR, "10 minutes"), A.scratch(spark, "stream-bars"))


@query(f"WITH {_TAPE}, quotes AS (SELECT s, event_id, CASE WHEN symbol = 'view' THEN p END AS bid, CASE WHEN symbol = 'click' THEN p END AS ask FROM tape WHERE symbol IN ('view', 'click')), book AS (SELECT *, last_value(bid IGNORE NULLS) OVER q AS bid_now, last_value(ask IGNORE NULLS) OVER q AS ask_now, last_value(CASE WHEN bid IS NOT NULL THEN s END IGNORE NULLS) OVER q AS bid_t, last_value(CASE WHEN ask IS NOT NULL THEN s END IGNORE NULLS) OVER q AS ask_t FROM quotes WINDOW q AS (ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT event_id, bid_now, ask_now, coalesce(s - bid_t > 600, false) OR coalesce(s - ask_t > 600, false) AS stale, false AS late FROM book")
def streaming_quote_book(spark, sf_dir):
    """The quote book as a stream with state."""
    side = "cast(case when symbol = '{}' then p end as bigint)"
    seconds = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    ticks = stream_of(spark, sf_dir, "symbol|ts|event_id|p").where("symbol in ('view', 'click')").selectExpr("'pair' AS symbol", f"{seconds} AS s", "event_id", f"{side.format('view')} AS bid", f"{side.format('click')} AS ask")
    return M.run_to_end(M.carried_quotes(ticks, "symbol", "s", "event_id", 600), A.scratch(spark, "stream-book")).drop("symbol", "s")


@query(f"WITH {_TAPE}, m AS (SELECT symbol, s // 60 AS minute, count(*) AS n FROM tape GROUP BY 1, 2) SELECT symbol, quantile_disc(n, 0.5) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS most FROM m GROUP BY symbol")
def minute_density(spark, sf_dir):
    counts = tape(spark, sf_dir).groupBy("symbol", F.floor(F.col("s") / 60).alias("minute")).agg(F.count("*").alias("n"))
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by n)").cast("long")
    return counts.groupBy("symbol").agg(disc(0.5).alias("median"), disc(0.95).alias("p95"), F.max("n").alias("most"))


@query(f"WITH {_TAPE}, g AS (SELECT symbol, s - lag(s) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS step FROM tape) SELECT symbol, count(*) FILTER (step < 0) AS backwards, {', '.join(f'count(*) FILTER (step >= {m * 60}) AS over_{m}' for m in (1, 5, 30, 120))} FROM g GROUP BY symbol")
def gap_counts(spark, sf_dir):
    rows = K.previous(tape(spark, sf_dir), ["symbol"], "s", ["ts", "event_id"], {"past": F.col("s")}).withColumn("step", F.col("s") - F.col("past"))
    return rows.groupBy("symbol").agg(F.count_if(F.col("step") < 0).alias("backwards"), *(F.count_if(F.col("step") >= m * 60).alias(f"over_{m}") for m in (1, 5, 30, 120)))


@query(f"WITH {_TAPE}, {_QUOTES} SELECT {_SPREAD} * 100 AS spread, count(*) AS n FROM book WHERE ask_now - bid_now IS NOT NULL GROUP BY 1 ORDER BY n DESC, spread LIMIT 10")
def commonest_spreads(spark, sf_dir):
    return spreads(spark, sf_dir).groupBy((F.col("bucket") * 100).alias("spread")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "spread").limit(10)


@query("SELECT CASE event_type WHEN 'view' THEN 'bid' WHEN 'click' THEN 'ask' ELSE 'bid+ask' END AS flags, count(*) AS n FROM events GROUP BY 1")
def text_of_flags(spark, sf_dir):
    """Decoded flags of ticks: view is a bid, click an ask, the others both."""
    flags = F.when(F.col("symbol") == "view", 2).when(F.col("symbol") == "click", 4).otherwise(6)
    return tape(spark, sf_dir).groupBy(E.flag_names(flags).alias("flags")).agg(F.count("*").alias("n"))



_FLAGS = "CASE WHEN p < 100 THEN NULL WHEN p > 15000 THEN 6 WHEN bid IS NOT NULL THEN 2 ELSE 4 END"
_TICKS = f"WITH {_TAPE}, {_QUOTES}, f AS (SELECT *, coalesce(bid, ask) AS p, bid_now IS NOT NULL AND ask_now IS NOT NULL AS quoted, abs(bid_now - lag(bid_now) OVER o) AS moved, s - lag(s) OVER o AS step, ask_now - bid_now AS spread, coalesce(s - bid_t > 600, false) OR coalesce(s - ask_t > 600, false) AS stale FROM book WINDOW o AS (ORDER BY ts, event_id)), k AS (SELECT *, {_FLAGS} AS flags FROM f)"
_METRICS = {
    "no_bid": "bid IS NULL", "no_ask": "ask IS NULL", "no_side": "bid IS NULL AND ask IS NULL", "bid_not_as_flagged": "(flags & 2 <> 0) <> (bid IS NOT NULL)", "ask_not_as_flagged": "(flags & 4 <> 0) <> (ask IS NOT NULL)",
    "no_flags": "flags IS NULL", "with_last": "false", "with_volume": "false", "bid_not_positive": "bid <= 0", "ask_not_positive": "ask <= 0", "quotes": "quoted", "no_quote": "NOT quoted", "stale_quotes": "quoted AND stale",
    "crossed": "spread < 0", "no_spread": "spread = 0", "bid_jumps": "moved >= 500", "bid_unchanged": "moved = 0",
}
_COUNTED = [f"SELECT '{n}' AS metric, count(*) FILTER ({x}) AS value, round(100 * count(*) FILTER ({x}) / count(*), 5) AS pct FROM k" for n, x in {"records": "true", **_METRICS}.items()]
_AGES = [f"SELECT 'oldest_{x}', max(s - {x}_t) FILTER (quoted), NULL FROM k" for x in ("bid", "ask")]


@query(f"{_TICKS} {' UNION ALL '.join([*_COUNTED, *_AGES])}")
def tick_quality_table(spark, sf_dir):
    value = F.coalesce("bid", "ask")
    flags = F.when(value < 100, F.lit(None)).when(value > 15000, 6).when(F.col("bid").isNotNull(), 2).otherwise(4)
    rows = book(spark, sf_dir).withColumns({"flags": flags, "last": F.lit(None).cast("long"), "volume": F.lit(None).cast("double")})
    return T.quality_table(rows, KEY, "s", "s", ["ts", "event_id"], 600)


_SCOPES = {"all": ("''", "true"), "fresh": ("''", "NOT stale"), "hour": ("strftime(ts, '%H')", "true"), "year": ("strftime(ts, '%Y')", "true"), "month": ("strftime(ts, '%Y-%m')", "true")}
_DISC = ", ".join(f"quantile_disc(spread, {q}) AS {n}" for n, q in (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))


@query(f"{_TICKS} {' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS scope, {part} AS part, count(*) AS n, min(spread) AS least, {_DISC}, max(spread) AS most, round(avg(spread), 4) AS mean FROM f WHERE spread IS NOT NULL AND {test} GROUP BY 2' for n, (part, test) in _SCOPES.items())}")
def spreads_by_calendar(spark, sf_dir):
    rows = book(spark, sf_dir).withColumn("spread", F.col("ask_now") - F.col("bid_now"))
    return T.spread_tables(rows, "s", "spread", ~T.stale("s", 600))


_DAYS = "d AS (SELECT s // 86400 AS day, count(*) AS n, min(s) AS first, max(s) AS last, max(greatest(coalesce(step, 0), 0)) AS longest_gap, quantile_disc(spread, 0.5) AS median, quantile_disc(spread, 0.95) AS p95, max(s) - min(s) AS span, count(step) AS steps FROM f GROUP BY 1)"


def covered_days(spark, sf_dir):
    return T.daily_coverage(book(spark, sf_dir), KEY, "s", "s", ["ts", "event_id"], 1)


@query(f"{_TICKS}, {_DAYS} SELECT day, n, first, last, CASE WHEN steps > 0 THEN longest_gap END AS longest_gap, median, p95, span FROM d")
def book_by_day(spark, sf_dir):
    return covered_days(spark, sf_dir).drop("symbol")


@query(f"{_TICKS}, {_DAYS}, c AS (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM d) SELECT day, 'missing_weekday' AS kind FROM c WHERE (day + 3) % 7 < 5 AND day NOT IN (SELECT day FROM d) UNION ALL SELECT day, 'weekend_ticks' FROM d WHERE (day + 3) % 7 >= 5")
def odd_days(spark, sf_dir):
    return T.odd_days(covered_days(spark, sf_dir), KEY).drop("symbol")


@query(f"WITH {_TAPE}, g AS (SELECT symbol, ts, p, count(*) AS n FROM tape WHERE epoch(ts) <= (SELECT max(epoch(ts)) - 600 FROM tape) GROUP BY ALL), u AS (SELECT symbol, ts, sum(n) AS ticks, sum(n - 1) AS again FROM g GROUP BY ALL) SELECT symbol, CAST(sum(ticks) AS BIGINT) AS ticks, CAST(sum(ticks - 1) AS BIGINT) AS same_time, CAST(sum(again) AS BIGINT) AS same_row FROM u GROUP BY symbol")
def streaming_duplicates(spark, sf_dir):
    """Ticks of one time, and equal ticks, beyond the first, in a stream: of times the watermark (10 minutes behind) has passed."""
    ticks = stream_of(spark, sf_dir, "symbol|ts|event_id|p")
    groups = M.run_to_end(M.closed_groups(ticks, KEY, "ts", ["p"], "10 minutes"), A.scratch(spark, "stream-groups"))
    times = groups.groupBy("symbol", "ts").agg(F.sum("n").alias("ticks"), F.sum(F.col("n") - 1).alias("again"))
    return times.groupBy("symbol").agg(F.sum("ticks").alias("ticks"), F.sum(F.col("ticks") - 1).alias("same_time"), F.sum("again").alias("same_row"))
