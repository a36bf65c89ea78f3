"""SimHash near-duplicates through vantage-point trees.

Fingerprints: 64 bits from the XXH64 hashes of three-word shingles. A top tree of vantage points, fitted on a bounded sample, deals
distinct fingerprints to shards; a fingerprint whose ball of the given radius crosses a boundary also queries the shards beyond it.
Shards that hold too many fingerprints get trees of their own, from samples of their own, until all are small enough (a ball of
fingerprints too dense to part stays whole). Each shard searches with a vantage-point tree, prunes by the triangle inequality, and
returns a spanning forest of its links, never all pairs. Components follow by minimum labels with pointer jumping. Samples decide how
even the shards are, not what is found.

Defined results: null or blank texts have fingerprint zero and are linked like any other; rows are documents of their own, so rows that
share an id but not a text are linked only through their fingerprints; a row with a null id gets the component of its fingerprint's
class (null if the class has no id at all); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import apart, arrow_map, byte_column, materialize, signed

#: Fingerprints that the top tree is fitted on, and the most shards that it or one round of further trees makes of a shard.
SAMPLE, FANOUT = 20_000, 1_024
#: A shard of more fingerprints than SPLIT times SHARD_ROWS is dealt again, by a tree fitted on at most RESAMPLE of them.
SHARD_ROWS, SPLIT, RESAMPLE = 40_000, 4, 2_048
LEAF = 96
_BLOCK = 1 << 16


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    joined, last = b" ".join(words), min(words_in_shingle, len(words)) - 1
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[s : e - 1], 42) for s, e in zip(starts[at : at + _BLOCK], ends[at + last : at + last + _BLOCK], strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h, bits of docs (doc_id, h, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column("doc_id").cast(pa.int64()), "h": batch.column("h"), "bits": [signed(fingerprint(t or b"")) for t in byte_column(batch, "text")]}

    return arrow_map(docs, rows, "doc_id long, h long, bits long", pa.schema([(c, pa.int64()) for c in ("doc_id", "h", "bits")]))


def distance(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point).astype(np.int16)


def top_tree(sample: np.ndarray, shards: int) -> list:
    """Nested nodes [vantage, median distance, inner, outer]; a leaf is the number of a shard."""
    numbers, rng = iter(range(1 << 30)), np.random.default_rng(7)

    def grow(points: np.ndarray, parts: int):
        if parts < 2 or len(points) < 8:
            return next(numbers)
        tries = [(p, distance(points, p)) for p in rng.choice(points, min(8, len(points)), replace=False)]
        vantage, away = max(tries, key=lambda x: x[1].std())
        radius = int(np.median(away))
        inner = away <= radius
        if inner.all():
            radius -= 1
            inner = away <= radius
        if not inner.any() or inner.all():
            return next(numbers)
        near = min(parts - 1, max(1, round(parts * inner.mean())))
        return [int(vantage), radius, grow(points[inner], near), grow(points[~inner], parts - near)]

    return grow(sample, shards)


def deal(tree, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, shard and whether it lives there, for each fingerprint's own shard and for those beyond it that its ball reaches."""
    out = []

    def down(node, index: np.ndarray, home: np.ndarray) -> None:
        if not len(index):
            return
        if not isinstance(node, list):
            out.append((index, np.full(len(index), node), home))
            return
        vantage, limit, inner, outer = node
        away = distance(values[index], np.uint64(vantage))
        into, beyond = away <= limit + radius, away > limit - radius
        down(inner, index[into], (home & (away <= limit))[into])
        down(outer, index[beyond], (home & (away > limit))[beyond])

    down(tree, np.arange(len(values)), np.ones(len(values), bool))
    index, shard, home = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0, bool),)
    own = np.empty(len(values), shard.dtype)
    own[index[home]] = shard[home]
    keep = home | (shard > own[index])  # each pair of shards is searched from one side
    return index[keep], shard[keep], home[keep]


def shard_links(values: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (position, root), of the links between any value and the values that live here."""
    parent, rng = np.arange(len(values)), np.random.default_rng(11)

    def roots(index: np.ndarray) -> np.ndarray:
        at = parent[index]
        while not np.array_equal(up := parent[at], at):
            at = up
        return at

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = roots(a), roots(b)
            open_ = a != b
            low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(parent, high, low)
            a, b = low, high

    def compare(stored: np.ndarray, queries: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(stored)))
        for at in range(0, len(queries), step):
            block = queries[at : at + step]
            q, s = np.nonzero(np.bitwise_count(values[block][:, None] ^ values[stored][None, :]) <= radius)
            a, b = block[q], stored[s]
            other = a != b
            unite(a[other], b[other])

    stack = [(np.flatnonzero(home), np.arange(len(values)))]
    while stack:
        stored, queries = stack.pop()
        if not len(stored) or not len(queries):
            continue
        vantage = values[stored[rng.integers(len(stored))]]
        away = distance(values[stored], vantage)
        limit = int(np.median(away))
        inner = away <= limit
        if len(stored) <= LEAF or inner.all():
            compare(stored, queries)
            continue
        asked = distance(values[queries], vantage)
        stack.append((stored[inner], queries[asked <= limit + radius]))
        stack.append((stored[~inner], queries[asked > limit - radius]))
    top = roots(np.arange(len(values)))
    moved = np.flatnonzero(top != np.arange(len(values)))
    return moved, top[moved]


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges a-b, by minimum labels and pointer jumping."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = label.join(around, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = label.select(F.col("node").alias("best"), F.col("label").alias("top"))
        new = materialize(nearer.join(jump, "best").select("node", F.least("best", "top").alias("label"), (F.least("best", "top") < F.col("label")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        label = new.select("node", "label")


def dealt(values: DataFrame, trees: dict[int, list], radius: int, fresh: int) -> DataFrame:
    """shard, bits, home of values (shard, bits) after each shard's tree; shards are numbered anew, shard * fresh + leaf."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own, bits = batch.column("shard").to_numpy(), batch.column("bits").to_numpy()
            for number in np.unique(own):
                some = bits[own == number]
                index, leaf, home = deal(trees[int(number)], some.view(np.uint64), radius)
                yield {"shard": number * fresh + leaf, "bits": some[index], "home": home}

    return arrow_map(values.select("shard", "bits"), rows, "shard long, bits long, home boolean", pa.schema([("shard", pa.int64()), ("bits", pa.int64()), ("home", pa.bool_())]))


def sharded(classes: DataFrame, radius: int, shard_rows: int) -> list[DataFrame]:
    """Tables of shard, bits, home, whose shards are all small enough (or can't be parted); shards of different tables are apart.

    Each round reads the sizes of its shards, at most FANOUT for each one that it parted, and samples of at most RESAMPLE each."""
    total = classes.count()
    sample = [r.bits for r in classes.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE).collect()]
    trees = {0: top_tree(np.array(sample, np.int64).view(np.uint64), min(FANOUT, -(-total // shard_rows)))}
    here, done = dealt(classes.select(F.lit(0).cast("long").alias("shard"), "bits"), trees, radius, 0), []
    before = {0: total}
    while True:
        if max(before.values(), default=0) <= SPLIT * shard_rows:  # too few rows for any shard to be too large
            return [*done, here]
        here = materialize(here, "shards")
        sizes = {r.shard: r.n for r in here.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        large = {s: n for s, n in sizes.items() if n > SPLIT * shard_rows and n < 0.9 * before[s // FANOUT]}
        if not large:
            return [*done, here]
        again = here.where(F.col("shard").isin(list(large)))
        done.append(here.where(~F.col("shard").isin(list(large))))
        parts = F.create_map(*(F.lit(x) for s, n in large.items() for x in (int(s), -(-n // RESAMPLE))))
        picked = again.where(F.pmod(F.xxhash64(F.lit(3), "bits"), parts[F.col("shard")]) == 0).select("shard", "bits").toArrow()
        shard, bits = picked.column("shard").to_numpy(), picked.column("bits").to_numpy().view(np.uint64)
        trees = {s: top_tree(bits[shard == s], min(FANOUT, -(-n // shard_rows))) for s, n in large.items()}
        here, before = dealt(again, trees, radius, FANOUT), large


def near_dedup(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, h (hash of the text), bits (the fingerprint as a signed long), component_id, component (a fingerprint that names it) for
    every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    prints = materialize(fingerprints(docs), "simhash")
    classes = materialize(prints.groupBy("bits").agg(F.min("doc_id").alias("rep")), "classes")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        bits = group["bits"].to_numpy()
        a, b = shard_links(bits.view(np.uint64), group["home"].to_numpy(), radius)
        return pd.DataFrame({"a": bits[a], "b": bits[b]})

    tables, tasks = sharded(classes, radius, shard_rows), 4 * max(1, -(-classes.count() // shard_rows))  # so that few shards share a task
    found = [table.repartition(tasks, "shard").groupBy("shard").applyInPandas(search, "a long, b long") for table in tables]
    links = materialize(reduce(DataFrame.unionByName, found), "links")
    linked = materialize(components_of(links, classes), "components")  # read from a table, the join can split a key of many rows
    return prints.join(linked, "bits").select("doc_id", "h", "bits", "component_id", "component")


def components_of(links: DataFrame, classes: DataFrame) -> DataFrame:
    """bits, component_id, component (the least of its bits) of every class. links: pairs a, b of bits."""
    found = components(links)
    least = found.join(classes, F.col("node") == F.col("bits")).groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = found.join(least, "component").select("node", "component_id", "component")
    return classes.join(joined, F.col("bits") == F.col("node"), "left").select("bits", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "bits").alias("component"))


def hex_bits(column) -> F.Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id (null last), then of the least text hash. Where that very
    row is there several times, it comes once."""
    docs, back = apart(docs, ["doc_id", "text"])
    equal = near_dedup(docs, radius).groupBy("component", "doc_id", "h").agg(F.count("*").alias("n"))
    first = equal.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "n")).alias("x"))
    kept = materialize(first.select(F.col("x.doc_id").alias("__kept_id"), F.col("x.h").alias("__kept_h"), F.col("x.n").alias("__rows")), "kept")
    hashed = docs.withColumn("__h", F.xxhash64("text"))
    rows = hashed.join(kept.select("__kept_id", "__kept_h").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__h") == F.col("__kept_h")), "left_semi")
    if not kept.where("__rows > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "__h"])
    return back(rows)
