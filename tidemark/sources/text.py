"""Exports of bars and ticks as delimited text: sniffing of a file's format, typed scans, and what is wrong with the rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the two exports, and the bits of a tick's flags.
BAR_COLUMNS = ("DATE", "TIME", "OPEN", "HIGH", "LOW", "CLOSE", "TICKVOL", "VOL", "SPREAD")
TICK_COLUMNS = ("DATE", "TIME", "BID", "ASK", "LAST", "VOLUME", "FLAGS")
FLAGS = {2: "bid", 4: "ask", 8: "last", 16: "volume", 32: "buy", 64: "sell"}
#: Rows of one input split have numbers in one range of this width, in the order of the file.
PER_TASK = 1 << 33
_CORRUPT = "__malformed"
_DATE = r"^\d{4}\.(0[1-9]|1[0-2])\.(0[1-9]|[12]\d|3[01])$"


def prefix_of(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes of a file on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


@dataclass(frozen=True)
class TickFormat:
    encoding: str
    bom: bool
    line_end: str
    delimiter: str
    columns: tuple[str, ...]
    milliseconds: bool
    decimals: int
    row_bytes: float

    def rows_in(self, size: int) -> int:
        return round(size / self.row_bytes) if self.row_bytes else 0


def sniff(prefix: bytes) -> TickFormat:
    """The format of a tick file from its first bytes. Refuses null bytes, a header without known columns, rows whose number of fields
    differs from the header's, and dates that are not yyyy.MM.dd."""
    bom = prefix.startswith(b"\xef\xbb\xbf")
    body = prefix[3:] if bom else prefix
    if b"\0" in body:
        raise ValueError("null bytes: not a text file, or UTF-16")
    end = b"\r" if b"\r" in body and b"\n" not in body else b"\n"
    for encoding in ("ascii", "utf-8", "latin-1"):
        try:
            text = body[: body.rfind(end) + 1].decode(encoding) or body.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    line_end = "\r\n" if "\r\n" in text else end.decode()
    lines = [x for x in text.split(line_end) if x]
    if not lines:
        raise ValueError("empty file")
    delimiter = max("\t,;", key=lines[0].count)
    columns = tuple(_name(c) for c in lines[0].split(delimiter))
    if not set(columns) & set(TICK_COLUMNS):
        raise ValueError(f"no known column in the header: {columns}")
    rows = [x.split(delimiter) for x in lines[1:]]
    odd = [i for i, r in enumerate(rows) if len(r) != len(columns)]
    if rows and len(odd) > len(rows) // 2:
        raise ValueError(f"{len(odd)} of {len(rows)} rows have not {len(columns)} fields")
    rows = [dict(zip(columns, r, strict=True)) for i, r in enumerate(rows) if i not in set(odd)]
    if any(not re.match(_DATE, r.get("DATE", "")) for r in rows[:1]):
        raise ValueError("dates are not yyyy.MM.dd")
    decimals = max((len(r[c].partition(".")[2]) for r in rows for c in ("BID", "ASK") if r.get(c)), default=0)
    size = sum(len(x.encode(encoding)) + len(line_end) for x in lines[1:]) / max(len(lines) - 1, 1)
    return TickFormat(encoding, bom, line_end, delimiter, columns, any("." in r.get("TIME", "") for r in rows), decimals, size)


def _name(header: str) -> str:
    return header.strip().strip("\ufeff").strip("<>").upper()


def _number(c: str) -> Column:
    value = F.expr(f"try_cast(trim({c}) AS double)")
    return F.when(~F.isnan(value), value)


def _time(c: str, fraction: str) -> Column:
    """The zone-less time of 'yyyy.MM.dd HH:mm:ss' (with a fraction of that pattern), null for anything else; no session zone has a part."""
    stamp = F.col(c)
    return F.when(stamp.rlike(rf"^\d{{4}}\.\d\d\.\d\d \d\d:\d\d:\d\d{fraction}$"), F.concat(F.replace(F.substring(stamp, 1, 10), F.lit("."), F.lit("-")), F.substring(stamp, 11, 20)).try_cast("timestamp_ntz"))


def to_utc(native: Column) -> Column:
    """UTC of the export's clock, which runs 7 hours ahead of New York; null for local times that don't exist or come twice."""
    local = native - F.expr("INTERVAL 7 HOURS")
    zone = "America/New_York"
    utc = F.to_utc_timestamp(local, zone)
    back = lambda x: F.from_utc_timestamp(x, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    single = (back(utc) == local) & (back(utc - hour) != local) & (back(utc + hour) != local)
    return F.when(single, utc)


def read_bars(spark: SparkSession, path: str, seconds: int, stamped: str = "open") -> DataFrame:
    """Bars of a tab-separated export: open_time and close_time (no zone) with their UTC, prices, volumes, spread_points. A time that
    doesn't parse fails the job; other numbers that don't are null. `stamped` says which end of a bar the file's time is."""
    raw = spark.read.csv(path, sep="\t", header=True)
    raw = raw.toDF(*(_name(c) for c in raw.columns))
    lacking = [c for c in BAR_COLUMNS if c not in raw.columns and c not in ("TIME", "VOL")]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    stamp = F.concat_ws(" ", F.trim("DATE"), F.trim("TIME") if "TIME" in raw.columns else F.lit("00:00:00"))
    time = _time("__stamp", "")
    time = F.coalesce(time, F.raise_error(F.concat(F.lit("not a bar's time: "), F.col("__stamp"))).cast("timestamp_ntz"))
    length = F.expr(f"INTERVAL {seconds} SECONDS")
    rows = raw.withColumn("__stamp", stamp).withColumn("__time", time)
    opened = F.col("__time") if stamped == "open" else F.col("__time") - length
    rows = rows.withColumn("open_time", opened).withColumn("close_time", opened + length)
    volume = _number("VOL") if "VOL" in raw.columns else F.lit(0.0)
    return rows.select(
        "open_time", "close_time", to_utc(F.col("open_time")).alias("open_time_utc"), to_utc(F.col("close_time")).alias("close_time_utc"),
        *(_number(c).alias(c.lower()) for c in ("OPEN", "HIGH", "LOW", "CLOSE")), _number("TICKVOL").alias("tick_volume"), volume.alias("real_volume"), _number("SPREAD").alias("spread_points"),
    )


def read_sources(spark: SparkSession, sources: dict[str, tuple[str, int]]) -> DataFrame:
    """All timeframes in one table: {timeframe: (path, seconds)}; two of the same length are an error."""
    lengths = [n for _, n in sources.values()]
    if len(set(lengths)) < len(lengths):
        raise ValueError("two sources of one timeframe")
    frames = [read_bars(spark, path, n).withColumn("timeframe", F.lit(name)) for name, (path, n) in sources.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _lines(spark: SparkSession, path: str, form: TickFormat) -> DataFrame:
    """file, block, row, value: the lines of a tick file, numbered in its order within each split (good within one table, not as a key)."""
    reader = spark.read.option("lineSep", "\r") if form.line_end == "\r" else spark.read
    value = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if form.encoding == "latin-1" else F.col("value")
    return reader.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def samples(spark: SparkSession, path: str, form: TickFormat, n: int) -> DataFrame:
    """kind (begin, middle, end, busiest_hour), row, line: n raw lines from the file's ends, from its middle in time on, and from its
    busiest hour."""
    fields = F.split("value", form.delimiter, -1)
    at = lambda c: F.get(fields, F.lit(form.columns.index(c))) if c in form.columns else F.lit("00:00:00")
    rows = _lines(spark, path, form).withColumn("time", F.unix_seconds(F.try_to_timestamp(F.substring(F.concat_ws(" ", at("DATE"), at("TIME")), 1, 19), F.lit("yyyy.MM.dd HH:mm:ss"))))
    rows = rows.where((F.length("value") > 0) & (F.upper(F.btrim(F.get(fields, F.lit(0)), F.lit("<> \ufeff"))) != form.columns[0]))
    hours = rows.where("time is not null").groupBy(F.floor(F.col("time") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    facts = rows.agg(((F.min("time") + F.max("time")) / 2).alias("half")).crossJoin(hours.agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("busiest"))).first()  # one row
    kinds = {"begin": (F.lit(True), "row"), "middle": (F.col("time") >= F.lit(facts.half), "row"), "end": (F.lit(True), F.desc("row")), "busiest_hour": (F.floor(F.col("time") / 3600) == F.lit(facts.busiest), "row")}
    out = None
    for kind, (test, order) in kinds.items():
        one = rows.where(test).orderBy(order).limit(n).select(F.lit(kind).alias("kind"), "row", F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def read_ticks(spark: SparkSession, path: str, form: TickFormat, point: float) -> DataFrame:
    """Ticks in the file's order (file, block, row): epoch_ms, bid, ask and last in points, volume, flags, and `malformed`, the line of a
    row with another number of fields (its other columns are null). Times that don't parse are null; no row is dropped."""
    raw = _lines(spark, path, form)
    fields = F.split(F.regexp_replace("value", "^\\uFEFF", ""), form.delimiter, -1)
    raw = raw.withColumn("__fields", fields).where((F.length("value") > 0) & (F.upper(F.btrim(F.col("__fields")[0], F.lit("<> "))) != form.columns[0]))
    raw = raw.select("file", "block", "row", F.when(F.size("__fields") != len(form.columns), F.col("value")).alias(_CORRUPT), *(F.nullif(F.trim(F.get("__fields", F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(form.columns)))
    has = lambda c: F.col(c) if c in form.columns else F.lit(None).cast("string")
    fine = F.col(_CORRUPT).isNull()
    rows = raw.withColumn("__stamp", F.when(fine & has("DATE").rlike(_DATE), F.concat_ws(" ", has("DATE"), has("TIME"))))
    rows = rows.withColumn("__time", _time("__stamp", r"\.\d{3}" if form.milliseconds else ""))
    points = lambda c: F.when(fine, F.rint(F.expr(f"try_cast(`{c}` AS double)") / point).cast("long")) if c in form.columns else F.lit(None).cast("long")
    return rows.select(
        "file", "block", "row", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', __time)").alias("epoch_ms"),
        *(points(c).alias(c.lower()) for c in ("BID", "ASK", "LAST")), F.when(fine, has("VOLUME").try_cast("double")).alias("volume"), F.when(fine, has("FLAGS").try_cast("int")).alias("flags"),
        F.col(_CORRUPT).alias("malformed"),
    )


def field_quality(ticks: DataFrame, examples: int = 50) -> DataFrame:
    """One row: counts of rows, malformed rows, bad times, missing sides, and rows whose flags name a side that is missing, with the first
    malformed lines by order of the file as examples."""
    named = lambda bit, c: F.count_if((F.col("flags").bitwiseAND(bit) != 0) & F.col(c).isNull())
    fine = F.col("malformed").isNull()
    counts = ticks.agg(
        F.count("*").alias("rows"), F.count_if(~fine).alias("malformed"), F.count_if(fine & F.col("epoch_ms").isNull()).alias("bad_times"),
        F.count_if(fine & F.col("bid").isNull()).alias("no_bid"), F.count_if(fine & F.col("ask").isNull()).alias("no_ask"), (named(2, "bid") + named(4, "ask")).alias("flag_mismatches"),
    )
    first = ticks.where(~fine).orderBy("file", "block", "row").limit(examples).agg(F.collect_list("malformed").alias("examples"))
    return counts.crossJoin(first)


def flag_names(flags: Column) -> Column:
    """'bid+ask' for 6; 'none' for 0."""
    named = F.concat_ws("+", *(F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in FLAGS.items()))
    return F.when(flags.isNotNull(), F.when(named == "", "none").otherwise(named))


def from_time(ticks: DataFrame, t: str, start: int, n: int, order: list[str]) -> DataFrame:
    """The first n rows at or after a time: a filter that the scan takes, then a bounded top."""
    return ticks.where(F.col(t) >= start).orderBy(t, *order).limit(n)
