"""Text sources, artefacts, validation and streams on hand-made rows."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import ticks as T
from tidemark.operators import validation as V
from tidemark.sources import artefacts as A
from tidemark.sources import text as E
from tidemark.streaming import bars as M

HEADER = "<DATE>\t<TIME>\t<BID>\t<ASK>\t<LAST>\t<VOLUME>\t<FLAGS>"


def tick_file(folder, *rows, end="\r\n"):
    path = folder / "ticks.csv"
    path.write_bytes(end.join([HEADER, *rows, ""]).encode())
    return str(path)


def test_bars_of_an_export_have_times_points_and_utc(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2025.07.01\t12:00:00\t1.10000\t1.10050\t1.09900\tx\t50\t0\t12\n2025.12.01\t12:00:00\t1\t1\t1\t1\t1\t0\t1\n")
    rows = E.read_bars(spark, str(path), 300).orderBy("open_time").collect()
    assert [r.open_time_utc.hour for r in rows] == [9, 10]
    assert (rows[0].close_time - rows[0].open_time).total_seconds() == 300 and rows[0].close is None and rows[0].low == 1.099
    early = E.read_bars(spark, str(path), 300, stamped="close").orderBy("open_time").first()
    assert (early.open_time.minute, early.close_time.minute) == (55, 0)


def test_bars_with_a_bad_time_or_without_a_column_fail(spark, tmp_path):
    bad, short = tmp_path / "bad.csv", tmp_path / "short.csv"
    head = "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n"
    bad.write_text(head + "2025.13.01\t12:00:00\t1\t1\t1\t1\t1\t0\t1\n")
    short.write_text("<DATE>\t<OPEN>\n2025.01.01\t1\n")
    with pytest.raises(Exception, match="not a bar's time"):
        E.read_bars(spark, str(bad), 300).collect()
    with pytest.raises(ValueError, match="lacks"):
        E.read_bars(spark, str(short), 300)
    with pytest.raises(ValueError, match="one timeframe"):
        E.read_sources(spark, {"a": (str(bad), 300), "b": (str(bad), 300)})


def test_local_times_that_come_twice_or_never_have_no_utc(spark):
    rows = spark.sql("select * from values (timestamp_ntz'2025-11-02 08:30:00'), (timestamp_ntz'2025-03-09 09:30:00'), (timestamp_ntz'2025-03-09 08:30:00') as t(x)").select(E.to_utc(F.col("x")).alias("u")).collect()
    assert [r.u is None for r in rows] == [True, True, False]


def test_ticks_are_sniffed_and_malformed_rows_are_counted(spark, tmp_path):
    path = tick_file(tmp_path, "2022.01.03\t00:00:00.100\t1.13684\t1.13819\t\t\t6", "2022.01.03\t00:00:01.000\t\t0.99999\t\t\t4", "2022.01.03\t1\t2", "2022.13.03\t00:00:02.000\t1.1\t\t\t\t6")
    form = E.sniff(E.prefix_of(spark, path))
    assert (form.delimiter, form.line_end, form.milliseconds, form.decimals, form.encoding, form.columns) == ("\t", "\r\n", True, 5, "ascii", E.TICK_COLUMNS)
    ticks = E.read_ticks(spark, path, form, 0.00001).orderBy("file", "block", "row")
    assert [(r.bid, r.ask) for r in ticks.collect()][:2] == [(113684, 113819), (None, 99999)]
    one = E.field_quality(ticks).first()
    assert (one.rows, one.malformed, one.bad_times, one.no_bid, one.no_ask, one.flag_mismatches, len(one.examples)) == (4, 1, 1, 1, 1, 1, 1)
    assert ticks.select(F.collect_list(E.flag_names(F.col("flags"))).alias("f")).first().f == ["bid+ask", "ask", "bid+ask"]


@pytest.mark.parametrize("prefix", [b"", b"a\0b\n", b"x\ty\n1\t2\n", HEADER.encode() + b"\n2022-01-03\t1\t1\t1\t1\t1\t1\n", HEADER.encode() + b"\n1\t2\n3\t4\n"])
def test_other_files_are_refused(prefix):
    with pytest.raises(ValueError):
        E.sniff(prefix)


def test_sniffing_knows_marks_encodings_and_delimiters():
    form = E.sniff(b"\xef\xbb\xbfDATE;TIME;BID;ASK\n2022.01.03;00:00:00;1,5;\xc3\xa9\n")
    assert (form.bom, form.encoding, form.delimiter, form.milliseconds, form.rows_in(10 * 27)) == (True, "utf-8", ";", False, round(270 / form.row_bytes))
    assert E.sniff(b"DATE;BID\n2022.01.03;\xe9\n").encoding == "latin-1"


def test_artefacts_are_written_summed_and_described(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a|{i}", None if i else 1.5) for i in range(5)], "t long, s string, x double")
    made = A.write_table(df, str(tmp_path / "t"))
    assert made["rows"] == 5 and made["bytes"] > 0
    A.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 5
    (tmp_path / "f").write_bytes(b"abc")
    assert A.checksum(spark, str(tmp_path / "f"), 2) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    text = A.markdown(df.orderBy("t"), 2)
    assert "a\\|0 | 1.5 |" in text and "| 1 | a\\|1 |  |" in text and "first 2 rows" in text
    note = json.loads(A.manifest(spark, {"k": 1}, {"f": str(tmp_path / "f")}, {"t": made}, {"load": 0.1}, []))
    assert note["commit"] == A.commit_of(str(Path(A.__file__).parent)) and A.commit_of(str(tmp_path)) is None
    assert note["tables"]["t"]["rows"] == 5 and note["inputs"]["f"]["bytes"] == 3
    assert (A.readable(10), A.readable(1536), A.readable(3 << 40)) == ("10 B", "1.5 KB", "3.0 TB")


def test_search_and_nearest(spark):
    df = spark.createDataFrame([(0, "Ema slope", "ema"), (7, "Width", "ribbon"), (9, "ema x", "cross")], "t long, text string, family string")
    assert [r.t for r in A.search(df, "EMA", ["text"]).orderBy("t").collect()] == [0, 9]
    assert [r.t for r in A.search(df, "ema", ["text"], family="cross").collect()] == [9]
    assert [r.t for r in A.nearest_rows(df, "t", 8, 2).collect()] == [7, 9]


def test_contract_finds_lacking_and_foreign_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,), (3,)], "k long")
    assert [tuple(r) for r in A.same_keys({"a": a, "b": b}, "k").orderBy("table").collect()] == [("a", 2, 2, 0, 0), ("b", 3, 2, 1, 1)]


def test_labels_imply_and_exclude():
    assert V.label_of("expansion_up_20p_240m") == ("up", 20.0, 240) and V.label_of("expansion_first_20p_240m") is None
    assert V.implied(("up", 20, 60), "expansion_up_10p_240m") and not V.implied(("up", 20, 60), "expansion_down_10p_240m") and not V.implied(("up", 20, 60), "expansion_up_20p_15m")
    assert V.excluded(20, 240, "expansion_up_30p_60m") and not V.excluded(20, 240, "expansion_up_10p_60m")
    V.require_no_outcomes(["5m__score", "close"], "features")
    with pytest.raises(ValueError, match="fwd_pips_15m"):
        V.require_no_outcomes(["close", "5m__fwd_pips_15m"], "features")
    assert V.schema_differences(["a", "b", "b"], ["a", "c"]) == {"missing": ["c"], "extra": ["b"], "twice": ["b"]}


def test_causality_check_sees_a_leak(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([("a", t, float(t)) for t in range(10)], "k string, t long, x double")
    w = Window.partitionBy("k").orderBy("t")
    change = {"x": F.col("x") + 1}
    honest = V.causality(lambda df: df.select("k", "t", F.lag("x").over(w).alias("f")), rows, "t", 5, ["k"], "t", change).first()
    leaking = V.causality(lambda df: df.select("k", "t", F.lead("x").over(w).alias("f")), rows, "t", 5, ["k"], "t", change).first()
    assert honest.past_changed == 0 and honest.future_changed == 3 and leaking.past_changed == 1


def test_source_quality_knows_closures_and_gaps(spark):
    day = 86400
    rows = spark.createDataFrame([(4 * day, 3), (4 * day + 14400, 4), (5 * day, 1), (6 * day, 1)], "t long, n_base long")  # Monday, Tuesday, Wednesday
    shut = spark.createDataFrame([(5,)], "day long")
    assert [r.gap for r in V.source_quality(rows, 14400, 3600, shut).orderBy("t").collect()] == ["partial_gap", "none", "market_closed", "partial_gap"]


def test_order_and_entanglement_ignore_missing_averages(spark):
    row = spark.createDataFrame([(3.0, 2.0, None, 10.0), (None, None, None, 1.0), (1.0, 2.0, 3.0, None)], "a double, b double, c double, atr double")
    ma = [F.col(c) for c in "abc"]
    out = row.select(X.ordering_score(ma).alias("s"), X.entanglement(ma, F.col("atr"), 0.25).alias("e")).collect()
    assert [(r.s, r.e) for r in out] == [(1.0, 1.0), (None, None), (-1.0, None)]
    sides = X.states(F.col("c") > 0, F.col("a"), F.col("b"), 2.0)
    assert row.select(*(x.alias(n) for n, x in sides.items())).collect()[1].asDict() == dict.fromkeys(sides, False)


def test_streams_close_bars_and_carry_quotes_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k string, ts timestamp_ntz, seq long, p long, s long, bid long, ask long"
    tick = lambda s, seq, p, bid=None, ask=None: ("a", s, seq, p, bid, ask)
    for i, rows in enumerate([[tick(1, 0, 5, bid=10), tick(59, 1, 9)], [tick(60, 2, 1, ask=12), tick(130, 3, 3, bid=11)], [tick(100, 4, 7), tick(400, 5, 2, ask=15)]]):
        df = spark.createDataFrame(rows, "k string, s long, seq long, p long, bid long, ask long").withColumn("ts", F.expr("timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00')"))
        df.select("k", "ts", "seq", "p", "s", "bid", "ask").coalesce(1).write.parquet(str(source / f"b{i}"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    bars = M.run_to_end(M.closed_bars(read(), ["k"], "ts", ["ts", "seq"], "p", 60, "60 seconds"), str(tmp_path / "bars"))
    base = 1704067200
    assert sorted((r.t - base, r.open, r.high, r.low, r.close, r.n) for r in bars.collect()) == [(0, 5, 9, 5, 9, 2), (60, 1, 7, 1, 7, 2), (120, 3, 3, 3, 3, 1)]
    book = M.run_to_end(M.carried_quotes(read(), "k", "s", "seq", 120), str(tmp_path / "book")).orderBy("seq").collect()
    assert [(r.bid_now, r.ask_now, r.stale, r.late) for r in book] == [(10, None, False, False), (10, None, False, False), (10, 12, False, False), (11, 12, False, False), (11, 12, False, True), (11, 15, True, False)]


def test_groups_of_one_time_are_counted_whole_over_batches(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, 5), ("a", 1, 5), ("a", 9, 1)], [("a", 9, 1), ("a", 9, 2), ("a", 500, 3)], [("a", 900, 3)]]):
        df = spark.createDataFrame(rows, "k string, s long, p long").withColumn("ts", F.expr("timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00')"))
        df.select("k", "ts", "s", "p").coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    read = spark.readStream.schema("k string, ts timestamp_ntz, s long, p long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    groups = M.run_to_end(M.closed_groups(read, ["k"], "ts", ["s", "p"], "60 seconds"), str(tmp_path / "out"))
    assert sorted((r.s, r.p, r.n) for r in groups.collect()) == [(1, 5, 2), (9, 1, 2), (9, 2, 1), (500, 3, 1)]


def test_quality_coverage_and_spreads_of_a_hand_made_tape(spark):
    day, none = 86400, None
    rows = [  # Thursday 1970-01-01, Saturday, and Tuesday
        ("a", 0, 100, none, 2), ("a", 10, none, 103, 4), ("a", 10, 700, 701, 2), ("a", 2 * day, 700, none, none), ("a", 5 * day, none, none, 6), ("a", 5 * day + 5, none, 690, 4),
    ]
    ticks = spark.createDataFrame([(i, *r, none, none) for i, r in enumerate(rows)], "i long, k string, t long, bid long, ask long, flags int, last long, volume double")
    book = T.quote_book(ticks, ["k"], ["i"], "t", "bid", "ask", "i", 2)
    found = {r.metric: r.value for r in T.quality_table(book, ["k"], "t", "i", ["i"], 60, 2).collect()}
    expected = {"records": 6, "no_bid": 3, "no_ask": 3, "no_side": 1, "bid_not_as_flagged": 1, "ask_not_as_flagged": 2, "no_flags": 1, "quotes": 5, "no_quote": 1, "crossed": 1, "no_spread": 0, "bid_jumps": 1, "bid_unchanged": 4, "with_last": 0}
    assert {n: found[n] for n in expected} == expected and found["oldest_bid"] == 3 * day + 5 and found["stale_quotes"] == 3
    days = T.daily_coverage(book, ["k"], "t", "i", ["i"], 1, 2)
    assert [(r.day, r.n, r.first, r.last, r.span, r.longest_gap, r.median) for r in days.orderBy("day").collect()] == [(0, 3, 0, 10, 10, 10, 1), (2, 1, 2 * day, 2 * day, 0, 2 * day - 10, 1), (5, 2, 5 * day, 5 * day + 5, 5, 3 * day, -10)]
    assert sorted((r.day, r.kind) for r in T.odd_days(days, ["k"]).collect()) == [(1, "missing_weekday"), (2, "weekend_ticks"), (4, "missing_weekday")]
    tables = {(r.scope, r.part): (r.n, r.least, r.median, r.most, r["mean"]) for r in T.spread_tables(book.withColumn("spread", F.col("ask_now") - F.col("bid_now")), "t", "spread", ~T.stale("t", 60)).collect()}
    assert tables[("all", "")] == (5, -10, 1, 3, -0.8) and tables[("month", "1970-01")] == tables[("year", "1970")] == tables[("hour", "00")] == tables[("all", "")]
    assert tables[("fresh", "")] == (2, 1, 1, 3, 2.0)
