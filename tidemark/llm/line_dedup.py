"""Line deduplication by a suffix array over line sequences, with DataFrame functions only.

A suffix is a document's lines from some line on. Lines get ids (128 bits of hash). Prefix doubling sorts the suffixes by their first
1, 2, 3, ... `min_lines` lines and from there by twice as many each round: the rank for 2m lines at i follows from the ranks for m lines
at i and at i + m. A round's order is numbered without a global sort: keys fall into ranges of about equal size (a rank is a place, so
places say where to cut), a running sum numbers the groups of each range, and ranges start where the ranges before them end. The
suffixes of one rank are a longest-common-prefix interval: they share m lines, and their neighbours in the array don't. Suffixes alone
in theirs repeat no further and drop out, so rounds end when the longest repeated run is passed.

Each interval reveals a repeated run; its first suffix in document order stays, and the others' m lines are later copies. A maximal
run of more than m lines is the union of the intervals at its lines (those of the next round need 2m), so runs of any length come out
whole. Deleted are runs of `min_lines` lines or more and, with `min_words`, shorter ones of that many words or more.

Defined results: lines end at line feeds; documents stand in order of doc_id, rows without one last, and of their text's hash among
rows with one id, so equal rows are one document and keep or lose the same lines; a null text has no lines and stays null; a text
whose lines all go becomes empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import apart, forget, materialize
from tidemark.llm.mixing import word_count

MIN_LINES, MIN_WORDS = 3, 50
#: About so many suffixes fall into one range of a round's order.
RANGE_ROWS = 1_000_000
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("__h", F.xxhash64("text"))


def _lines(docs: DataFrame, min_words: int | None) -> DataFrame:
    """d, h, i, a, b (the line's id), and its words as head and words if they are asked for."""
    lines = docs.where("text is not null").select(F.col("__d").alias("d"), F.col("__h").alias("h"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    counts = [] if min_words is None else [word_count(F.col("line")).alias(c) for c in ("head", "words")]  # of the first line, of all
    lines = lines.select("d", "h", "i", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), *counts)
    twice = docs.where("text is not null").groupBy("__d", "__h").agg(F.count("*").alias("n")).where("n > 1")
    return lines if twice.isEmpty() else lines.distinct()


def _ranked(suffixes: DataFrame, key: list[str], place: Column, ranges: int) -> DataFrame:
    """The suffixes whose key others have too, with `rank` (suffixes of such keys before theirs in order of key), `n` (how many share it)
    and `first` (the first of them in document order). place: where in [0, 1) a key falls, rising with it."""
    groups = suffixes.groupBy(*key).agg(F.min(F.struct("d", "h", "i")).alias("first"), F.count("*").alias("n"), F.min(place).alias("place")).where("n > 1")
    range_ = F.least(F.floor(F.col("place") * ranges), F.lit(ranges - 1)).cast("long")
    groups = groups.select(*key, "first", "n", range_.alias("range"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = groups.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    numbered = groups.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, "range")
    numbered = numbered.select(*key, "first", "n", (F.col("start") + F.col("inside")).alias("rank"))
    return materialize(suffixes.drop("place").join(numbered, key).drop(*key), "suffixes")


def intervals(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> Iterator[tuple[int, DataFrame]]:
    """Round by round, the number of lines m and the suffixes (d, h, i) that share their first m lines with others: `rank` is their place
    in the suffix array, `n` the size of their interval and `first` its first suffix. docs: __d, __h, text."""
    lines = materialize(_lines(docs, min_words), "lines")
    ranges = lambda rows: max(1, -(-rows // RANGE_ROWS))
    half = F.lit(float(1 << 63))
    held, m = _ranked(lines, ["a", "b"], (F.col("a") / half + 1) / 2, ranges(lines.count())), 1
    forget(lines)
    while total := held.count():
        yield m, held
        step = m if m >= min_lines else min(m, min_lines - m) if min_words is None else 1
        counted = min_words is not None and m < min_lines
        after = held.select("d", "h", (F.col("i") - step).alias("i"), F.col("rank").alias("two"), *([F.col("words").alias("rest")] if counted else []))
        sums = ["head", (F.col("head") + F.col("rest")).alias("words")] if counted else []
        # where a key falls: a group's suffixes take up n places from its rank on, which the ranks that follow divide
        place = ((F.col("rank") + F.col("n") * (F.col("two") / total)) / total).alias("place")
        pairs = materialize(held.join(after, ["d", "h", "i"]).select("d", "h", "i", F.col("rank").alias("one"), "two", place, *sums), "pairs")
        held, m = _ranked(pairs, ["one", "two"], F.col("place"), ranges(total)), m + step
        forget(pairs)


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """d, h, i, n: n lines from line i on that an earlier suffix has too, and that are long enough to go. docs: __d, __h, text."""
    found = [docs.select(F.col("__d").alias("d"), F.col("__h").alias("h"), F.lit(0).alias("i"), F.lit(0).alias("n")).limit(0)]
    for m, suffixes in intervals(docs, min_lines, min_words):
        if m >= min_lines or min_words is not None:
            long_enough = F.lit(True) if m >= min_lines else F.col("words") >= min_words
            found.append(suffixes.where(long_enough & (F.struct("d", "h", "i") != F.col("first"))).select("d", "h", "i", F.lit(m).alias("n")))
    return reduce(DataFrame.unionByName, found)


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """d, h, runs: the maximal runs of lines to delete, as an array of structs first, last in order."""
    windows = later_copies(docs, min_lines, min_words).withColumn("end", F.col("i") + F.col("n"))
    order = Window.partitionBy("d", "h").orderBy("i", "n")
    new = F.coalesce(F.col("i") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = windows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    runs = islands.groupBy("d", "h", "island").agg(F.min("i").alias("first"), (F.max("end") - 1).alias("last"))
    return runs.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """docs with text freed of later copies of repeated runs, and the columns __n_lines and __runs (those of docs with these names give
    way). docs has doc_id and text."""
    docs, back = apart(docs.drop("__n_lines", "__runs"), ["doc_id", "text"])
    keyed = _keyed(docs)
    runs = materialize(repeated_runs(keyed.select("__d", "__h", "text"), min_lines, min_words), "runs").select(F.col("d").alias("__rd"), F.col("h").alias("__rh"), F.col("runs").alias("__runs")).hint("merge")  # the same plan at every size
    joined = keyed.join(runs, (F.col("__d") == F.col("__rd")) & (F.col("__h") == F.col("__rh")), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.exists("__runs", lambda r: (r["first"] <= i) & (i <= r["last"]))), "\n")
    text = F.when(F.col("__runs").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = joined.withColumn("__n_lines", count.cast("long")).withColumn("text", text)
    return back(out, "__n_lines", "__runs")


def without_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """docs with the cleaned text; n_chars, if there, becomes its length."""
    docs, back = apart(docs, ["doc_id", "text", "n_chars"])
    out = line_dedup(docs, min_lines, min_words)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return back(out)
