"""Command line: python -m tidemark STEP. Each step reads the tables of the one before in --outdir and writes its own there."""

from __future__ import annotations

import argparse
import json
import logging
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import bars as B
from tidemark.operators import blocks as K
from tidemark.operators import features as X
from tidemark.operators import matrix as M
from tidemark.operators import studies as S
from tidemark.operators import ticks as T
from tidemark.operators import validation as V
from tidemark.plans import study
from tidemark.sources import artefacts as A
from tidemark.sources import text

LOG = logging.getLogger("tidemark")


def artefact(spark: SparkSession, outdir: str, name: str, step: str) -> DataFrame:
    """A table that an earlier step wrote; says which step to run where there is none."""
    at, system = A._open(spark, f"{outdir}/{name}")
    if not system.exists(at):
        raise SystemExit(f"{outdir}/{name} is missing: run `python -m tidemark {step}` first")
    return spark.read.parquet(f"{outdir}/{name}")


def keep(df: DataFrame, outdir: str, name: str, tables: dict) -> DataFrame:
    tables[name] = A.write_table(df, f"{outdir}/{name}")
    LOG.info("%s: %s rows, %s", name, tables[name]["rows"], A.readable(tables[name]["bytes"]))
    return df.sparkSession.read.schema(df.schema).parquet(f"{outdir}/{name}")


def write_text(spark: SparkSession, path: str, value: str) -> None:
    at, system = A._open(spark, path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(value.encode()))
    finally:
        stream.close()


def features(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg, tables, began = config.load(args.config), {}, time.time()
    base = keep(study.base_bars(spark, cfg), args.outdir, "bars", tables)
    seconds = config.MINUTES[cfg.base_timeframe] * 60
    keep(V.integrity(base, study.KEYS, "t", seconds), args.outdir, "integrity", tables)
    keep(study.quality_report(base, cfg), args.outdir, "source_quality", tables)
    rows = A.materialize(study.aligned(base, cfg), "aligned")
    mapped = keep(study.alignment(rows, cfg), args.outdir, "alignment", tables)
    looked = keep(study.lookahead(mapped, cfg), args.outdir, "lookahead", tables)
    if not looked.where("violations > 0").isEmpty():
        raise SystemExit("a source bar closed after its decision: see the table lookahead")
    documented = study.dictionary(cfg)
    made = keep(M.matrix(rows, cfg, [*study.KEYS, "c_t"]), args.outdir, "features", tables)
    documented.check(made, [*study.KEYS, "c_t"])
    keep(documented.table(spark), args.outdir, "dictionary", tables)
    keep(study.outcomes(base, cfg), args.outdir, "outcomes", tables)
    if args.panel:
        long = reduce(DataFrame.unionByName, (study.panel(base, cfg, tf) for tf in cfg.active_timeframes))
        tables["panel"] = A.write_table(long, f"{args.outdir}/panel", ["timeframe"])
    differing = A.same_keys({n: spark.read.parquet(f"{args.outdir}/{n}") for n in ("features", "outcomes", "alignment")}, "c_t").where("lacking > 0 or beyond > 0")
    if not differing.isEmpty():
        raise SystemExit("features, outcomes and alignment are not of the same times")
    warnings = [] if mapped.where("feature_row_valid").head(1) else [f"no row is past the warm-up of {cfg.warmup_bars} bars"]
    if args.causality_rows:
        warnings += causality(base, cfg, args.causality_rows)
    write_manifest(spark, args, cfg, tables, {"features": time.time() - began}, warnings)


def causality(base: DataFrame, cfg: config.StudyConfig, rows: int) -> list[str]:
    """Builds the matrix of the first rows twice, the second time with later prices moved; features known before must not differ."""
    some = A.materialize(base.orderBy("c_t").limit(rows), "causality")
    cut = some.agg(F.percentile_approx("c_t", 0.6)).first()[0]
    moved = {c: F.col(c) + 500 + F.col("t") % 7 for c in ("open", "high", "low", "close")}
    found = V.causality(lambda df: study.feature_matrix(df, cfg), some, "c_t", cut, study.KEYS, "c_t", moved).first()
    if found.past_changed:
        raise SystemExit(f"{found.past_changed} rows of features change with later prices")
    return [] if found.future_changed else ["the causality check changed nothing: it says nothing"]


def write_manifest(spark: SparkSession, args: argparse.Namespace, cfg: config.StudyConfig, tables: dict, seconds: dict, warnings: list[str]) -> None:
    name = "manifest.json" if "features" in seconds else f"manifest_{next(iter(seconds))}.json"
    write_text(spark, f"{args.outdir}/{name}", A.manifest(spark, cfg.to_dict(), {"base": cfg.base_source.path}, tables, seconds, warnings))


def _labelled(spark: SparkSession, cfg: config.StudyConfig, outdir: str) -> DataFrame:
    table = lambda name: artefact(spark, outdir, name, "features")
    columns = sorted({cfg.volatility_column, cfg.compression_column})
    rows = table("features").select(*study.KEYS, "c_t", *(F.col(f"`{c}`") for c in columns)).join(table("outcomes"), [*study.KEYS, "c_t"])
    rows = rows.join(table("alignment").select(*study.KEYS, "c_t", "feature_row_valid", "source_quality_ok"), [*study.KEYS, "c_t"])
    return study.labelled(study.context(rows, cfg), cfg)


def events(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg, tables, began = config.load(args.config), {}, time.time()
    rows = keep(_labelled(spark, cfg, args.outdir), args.outdir, "labelled", tables)
    keep(study.exclusions(rows, study.STRATUM), args.outdir, "exclusions", tables)
    found = keep(study.episodes(rows, cfg), args.outdir, "events", tables)
    failed = keep(study.failed_compressions(rows, cfg), args.outdir, "failed_compressions", tables)
    pool = keep(study.control_pool(rows, found, cfg), args.outdir, "pool", tables)
    matched = keep(study.controls(pool, found, cfg), args.outdir, "controls", tables)
    reports = {
        "pool_counts": study.pool_counts(rows, pool), "overlap": study.overlap_report(rows, found), "event_counts": study.event_counts(found, failed, matched),
        "matches": study.match_report(found, matched), "balance": study.balance(rows, found, matched, cfg), "warnings": study.run_warnings(found, matched.where("control_type = 'matched'"), study.STRATUM, cfg.step2.controls_per_event),
    }
    made = {name: keep(table, args.outdir, name, tables) for name, table in reports.items()}
    write_text(spark, f"{args.outdir}/events.md", report("Events", made))
    write_manifest(spark, args, cfg, tables, {"events": time.time() - began}, [f"{r.warning}: {r.value}" for r in made["warnings"].limit(200).collect()])


def report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """Small tables under their names, in order of all their columns that can be ordered."""
    plain = lambda df: [c for c, kind in df.dtypes if not kind.startswith(("map", "array"))]
    return f"# {title}\n\n" + "\n".join(f"## {name.replace('_', ' ')}\n\n{A.markdown(df.orderBy(*plain(df)), most)}" for name, df in tables.items())


def compare(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg, tables, began, rows = config.load(args.config), {}, time.time(), artefact(spark, args.outdir, "labelled", "events")
    found, matched = artefact(spark, args.outdir, "events", "events"), artefact(spark, args.outdir, "controls", "events")
    made = {"comparisons": keep(study.comparisons(rows, found, matched, cfg.step3a.distribution_quantiles), args.outdir, "comparisons", tables)}
    for by in ("session", "horizon", "threshold", "compression_state"):
        made[f"by_{by}"] = keep(study.breakdown(found, by), args.outdir, f"by_{by}", tables)
    for name, table in zip(("outcome_rates", "outcome_magnitudes"), study.outcome_comparisons(artefact(spark, args.outdir, "outcomes", "features"), found, matched), strict=True):
        keep(table, args.outdir, name, tables)
    write_text(spark, f"{args.outdir}/comparisons.md", report("Episodes and controls", made))
    write_manifest(spark, args, cfg, tables, {"compare": time.time() - began}, [])


def checkpoint(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg, tables, began = config.load(args.config), {}, time.time()
    rows, base = artefact(spark, args.outdir, "labelled", "events"), artefact(spark, args.outdir, "bars", "features")
    states = keep(study.state_rates(artefact(spark, args.outdir, "features", "features"), rows, cfg), args.outdir, "states", tables)
    made = {"verdict": keep(S.ladder_verdict(states, study.STRATUM), args.outdir, "verdict", tables), "states": states}
    held, events_, pool = cfg.day2_checkpoint, artefact(spark, args.outdir, "events", "events"), rows.where("reason is null")
    keep(S.random_in_context(events_, pool.join(events_.select(*study.STRATUM, "c_t"), [*study.STRATUM, "c_t"], "left_anti"), study.cell(cfg), "c_t", held.random_context_controls, held.random_seed), args.outdir, "random_context", tables)
    for tf in held.crossover_timeframes or cfg.active_timeframes:
        crossed = A.materialize(study.crossings(base, cfg, tf, held.crossover_indicator_families), "crossings")
        for name, table in zip(("crossings", "crossing_pairs", "crossing_sessions"), X.crossing_report(crossed, study.KEYS, held.crossover_episode_gap_bars * config.MINUTES[tf] * 60), strict=True):
            made[f"{name}_{tf}"] = keep(table, args.outdir, f"{name}_{tf}", tables)
    write_text(spark, f"{args.outdir}/states.md", report("States", made, 400))
    write_manifest(spark, args, cfg, tables, {"checkpoint": time.time() - began}, [])


def ticks(spark: SparkSession, args: argparse.Namespace) -> None:
    tables, form = {}, text.sniff(text.prefix_of(spark, args.path))
    rows = text.read_ticks(spark, args.path, form, args.point)
    rows = keep(rows if args.max_rows is None else rows.orderBy("file", "block", "row").limit(args.max_rows), args.outdir, "ticks", tables)
    quality = keep(text.field_quality(rows), args.outdir, "field_quality", tables)
    fine = rows.where("epoch_ms is not null").withColumn("symbol", F.lit(args.symbol))
    keep(T.duplicates(fine, "epoch_ms", ["epoch_ms", "bid", "ask", "last", "volume", "flags"]), args.outdir, "duplicates", tables)
    carried = T.quote_book(fine, ["symbol"], ["row"], "epoch_ms", "bid", "ask", "row", text.PER_TASK)
    book = carried.where("bid_now is not null and ask_now is not null")
    counted = keep(T.quality_table(carried, ["symbol"], "epoch_ms", "row", ["row"], args.stale_side_ms, text.PER_TASK), args.outdir, "tick_quality", tables)
    timed = book.withColumns({"spread": F.col("ask_now") - F.col("bid_now"), "s": F.floor(F.col("epoch_ms") / 1000)})
    spreads = keep(T.spread_tables(timed, "s", "spread", ~T.stale("epoch_ms", args.stale_side_ms)), args.outdir, "spread_tables", tables)
    days = keep(T.daily_coverage(carried, ["symbol"], "epoch_ms", "row", ["row"], 1000, text.PER_TASK), args.outdir, "daily_coverage", tables)
    odd = keep(T.odd_days(days, ["symbol"]), args.outdir, "odd_days", tables)
    keep(book.withColumn("stale", T.stale("epoch_ms", args.stale_side_ms)).groupBy((F.col("ask_now") - F.col("bid_now")).alias("spread"), "stale").count(), args.outdir, "spreads", tables)
    keep(T.step_topk(fine.where("bid is not null"), ["symbol"], "row", ["row"], "bid", 200, text.PER_TASK), args.outdir, "jumps", tables)
    keep(T.step_topk(fine, ["symbol"], "row", ["row"], "epoch_ms", 200, text.PER_TASK), args.outdir, "gaps", tables)
    keep(text.samples(spark, args.path, form, args.sample_lines), args.outdir, "samples", tables)
    keep(T.weeks(fine.withColumn("s", F.floor(F.col("epoch_ms") / 1000)), "s"), args.outdir, "weeks", tables)
    made = verdicts(spark, args, fine, book, quality, tables)
    write_text(spark, f"{args.outdir}/ticks.md", report("Ticks", {"quality": quality.drop("examples"), "tick quality": counted, "spreads": spreads.orderBy("scope", "part"), "odd days": odd.orderBy("day"), **made}))
    write_text(spark, f"{args.outdir}/summary.json", json.dumps({"format": vars(form), "tables": tables}, indent=2, default=str))


def verdicts(spark: SparkSession, args: argparse.Namespace, fine: DataFrame, book: DataFrame, quality: DataFrame, tables: dict) -> dict[str, DataFrame]:
    """Bars rebuilt from the carried bid under two clocks against an export (if one is given), the verdict on the clock, and readiness."""
    kept, seconds = spark.read.parquet(f"{args.outdir}/weeks"), args.bar_seconds
    ticks = book.withColumn("s", F.floor(F.col("epoch_ms") / 1000).cast("long"))
    ends = fine.agg((F.min("epoch_ms") / 1000).alias("first"), (F.max("epoch_ms") / 1000).alias("last")).first()
    facts, out = spark.range(1).select(F.lit(None).cast("double").alias("exact_pct"), F.lit(100.0).alias("covered_pct"), F.lit(0.0).alias("tail_days"), F.lit(0).alias("missing_bars")), {}
    if args.bars:
        prices = [F.rint(F.col(c) / args.point).cast("long").alias(c) for c in ("open", "high", "low", "close")]
        bars = text.read_bars(spark, args.bars, seconds).select(F.lit(args.symbol).alias("symbol"), B.epoch_seconds("open_time").alias("t"), *prices)
        inside = bars.where((F.col("t") + seconds > ends["first"]) & (F.col("t") <= ends["last"]))
        one = lambda name, shift: T.compared(inside, T.rebuilt(ticks, ["symbol"], "s", ["row"], seconds, shift), ["symbol"]).select(F.lit(name).alias("clock"), "*")
        out["rebuilt"] = keep(one("A_native", 0).unionByName(one("B_one_hour", 3600)), args.outdir, "rebuilt", tables)
        tail = bars.agg(F.greatest(F.lit(0.0), (F.max("t") + seconds - F.lit(ends["last"])) / 86400).alias("tail_days"), F.count("*").alias("n"))
        native = out["rebuilt"].where("clock = 'A_native'")
        facts = native.crossJoin(tail).select("exact_pct", (100 * F.col("covered") / F.col("n")).alias("covered_pct"), "tail_days", (F.col("bars") - F.col("covered")).alias("missing_bars"))  # one row each
    out["clock"] = keep(T.clock_verdict(kept, T.turn_weeks(kept), facts.select("exact_pct")), args.outdir, "clock", tables)
    past = K.previous(fine, ["symbol"], "row", ["row"], {"__past": F.col("epoch_ms")}, text.PER_TASK)
    counted = past.agg(F.count_if(F.col("epoch_ms") < F.col("__past")).alias("out_of_order"))
    counted = counted.crossJoin(book.agg(F.count("*").alias("quotes"), F.count_if(F.col("ask_now") < F.col("bid_now")).alias("crossed"), F.count_if(T.stale("epoch_ms", args.stale_side_ms)).alias("stale")))
    counted = counted.crossJoin(spark.read.parquet(f"{args.outdir}/duplicates").select(F.col("same_row").alias("duplicates"))).crossJoin(quality.select(F.col("flag_mismatches").alias("mismatches")))
    counted = counted.crossJoin(facts).crossJoin(out["clock"].select(F.col("verdict").alias("clock")))  # all of one row
    out["readiness"] = keep(T.readiness(counted), args.outdir, "readiness", tables)
    return out


def explore(spark: SparkSession, args: argparse.Namespace) -> None:
    table = lambda name: artefact(spark, args.outdir, name, "features")
    if args.what == "summary":
        shown = table("dictionary").groupBy("timeframe", "family").count().orderBy("timeframe", "family")
    elif args.what == "dict":
        shown = A.search(table("dictionary"), args.text, ["name", "description"])
    elif args.what == "columns":
        shown = spark.createDataFrame([(c, t) for c, t in table(args.table).dtypes if args.text in c], "column string, type string")
    elif args.what == "outcomes":
        done = [c for c in table("outcomes").columns if c.startswith("expansion_first_") and args.text in c]
        shown = table("outcomes").unpivot(["c_t"], done, "outcome", "first").groupBy("outcome", "first").count().orderBy("outcome", "first")
    elif args.what == "row":
        shown = A.nearest_rows(table(args.table), "c_t", args.at).select(*[c for c in table(args.table).columns if args.text in c or c == "c_t"])
    else:
        words = [w for w in args.text.split(",") if w]
        chosen = [c for c in table(args.table).columns if not words or c in ("symbol", "c_t", "feature_row_valid") or any(w in c for w in words)]
        A.write_report(table(args.table).select(*(F.col(f"`{c}`") for c in chosen)).orderBy(F.xxhash64(F.lit(args.seed), "c_t"), "c_t").limit(args.rows), f"{args.outdir}/sample_{args.table}")
        return
    print(A.markdown(shown, args.rows))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    steps = out.add_subparsers(dest="step", required=True)
    for step in (features, events, compare, checkpoint, ticks, explore):
        one = steps.add_parser(step.__name__)
        one.set_defaults(run=step)
        one.add_argument("--outdir", required=True)
        one.add_argument("--log-level", default="INFO")
        if step in (features, events, compare, checkpoint):
            one.add_argument("--config", required=True)
    steps.choices["features"].add_argument("--causality-rows", type=int, default=0)
    steps.choices["features"].add_argument("--panel", action="store_true", help="the long table of every bar and average, by timeframe")
    tick, look = steps.choices["ticks"], steps.choices["explore"]
    tick.add_argument("path")
    tick.add_argument("--symbol", default="EURUSD")
    tick.add_argument("--point", type=float, default=0.00001)
    tick.add_argument("--stale-side-ms", type=int, default=60_000)
    tick.add_argument("--max-rows", type=int)
    tick.add_argument("--bars", help="an export of bars that the ticks should rebuild")
    tick.add_argument("--bar-seconds", type=int, default=300)
    tick.add_argument("--sample-lines", type=int, default=200)
    look.add_argument("what", choices=("summary", "dict", "columns", "outcomes", "row", "export-sample"))
    look.add_argument("--text", default="")
    look.add_argument("--table", default="features")
    look.add_argument("--at", type=int, default=0)
    look.add_argument("--rows", type=int, default=40)
    look.add_argument("--seed", type=int, default=1)
    return out


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(given)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    args.run(spark or SparkSession.builder.appName("tidemark").getOrCreate(), args)


if __name__ == "__main__":
    main()
