"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the word 8-grams in any window of `length` consecutive words the one of least hash (the last of equals)
is its anchor, so equal windows have equal anchors at equal places. Anchors that stand alone in the corpus take part no further. The
others are extended both ways, as far as a window that holds them can reach. Occurrences whose extensions agree in full are a class;
every one but the first of its class is a repeat with all its windows. The first ones of an anchor's classes agree only in part (at the
ends of a repeat, or by a chance seed), and there the extension decides window by window: each window of theirs is compared with its
first occurrence. Repeated windows that overlap or touch are joined: the maximal repeats of at least `length` words.

Word sequences are equal where two independent 64-bit hashes of them are, for extensions, windows and repeats within a document alike.
Groups are never listed: an anchor's occurrences meet in aggregates (classes, their first places) and in a join with those, which Spark
can split where it is skewed. Within a document repeats are found without a shuffle, so a text of one repeated word adds few rows.

Defined results: a null text has no words; documents stand in order of doc_id, rows without an id last, and of their text's hash among
rows of one id, so equal rows are one document and lose the same words; fewer than `length` words are never removed; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, forget, materialize

LENGTH, GRAM = 20, 8
_LAST = (1 << 63) - 1
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIXES = ((np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)))
_EDGE = np.uint64(0x2545F4914F6CDD1D)
_BYTES_AT_ONCE = 1 << 19


def _mixed(x: np.ndarray, which: int) -> np.ndarray:
    one, two = _MIXES[which]
    x = (x ^ (x >> np.uint64(30))) * one
    x = (x ^ (x >> np.uint64(27))) * two
    return x ^ (x >> np.uint64(31))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of words and of word sequences, for many texts at once. Sums of values times powers of an odd base, modulo 2^64, are
    cut out of running sums and shifted back by powers of the base's inverse; every level is mixed before the next."""

    def __init__(self) -> None:
        self.tables: dict[tuple[int, bool], np.ndarray] = {}

    def powers(self, which: int, n: int, back: bool = False) -> np.ndarray:
        held = self.tables.get((which, back))
        if held is None or len(held) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            held = self.tables[which, back] = _powers(_inverse(_BASES[which]) if back else _BASES[which], size)
        return held[:n]

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Mixed hash of values[start:end] for every pair."""
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(which, len(values)), out=sums[1:])
        shifted = (sums[end] - sums[start]) * self.powers(which, len(values) + 1, back=True)[start]
        return _mixed(shifted + (end - start).astype(np.uint64) * _EDGE, which)


class Words:
    """The words of a batch of texts in a row, with their documents and hashes."""

    def __init__(self, texts: list[bytes], hasher: Hasher, which: tuple[int, ...] = (0, 1)) -> None:
        data = np.frombuffer(b" ".join([*texts, b""]) if texts else b" ", np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, begins)  # first word of each text, and the number of all words
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hasher, self.words = hasher, {}
        for w in which:
            self.words[w] = hasher.spans(data.astype(np.uint64) + np.uint64(1), self.start, self.end, w)

    def sequences(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return self.hasher.spans(self.words[which], start, end, which)

    def windows(self, length: int) -> np.ndarray:
        """The words at which a window begins."""
        n = len(self.doc)
        if n < length:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: n - length + 1] == self.doc[length - 1 :])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value among each value and the width - 1 after it, the last of equals."""
    at, reach = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] <= values[a], b, a)

    while 2 * reach <= width:
        at = better(at[:-reach], at[reach:]) if len(at) > reach else at[:0]
        reach *= 2
    if reach < width:
        shift = width - reach
        at = better(at[:-shift], at[shift:]) if len(at) > shift else at[:0]
    return at


def alike(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows together, earlier ones first, and which rows of that order begin a group. Sorted by a mixture of the
    columns; rows are equal only if all columns are, and should the mixture fail to part some, by the columns themselves."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = _mixed(key ^ c.astype(np.uint64), 0)
    order = np.argsort(key, kind="stable")
    same = lambda c: c[order][1:] == c[order][:-1]
    equal = np.logical_and.reduce([same(c) for c in columns])
    if (same(key) & ~equal).any():
        order = np.lexsort(columns[::-1])
        equal = np.logical_and.reduce([same(c) for c in columns])
    return order, np.concatenate([np.ones(min(1, len(order)), bool), ~equal])


def anchors(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window's first word and anchor (its first word), and the hash of the gram at each word."""
    windows, n = words.windows(length), len(words.doc)
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64)
    begin = np.arange(n - gram + 1)
    grams = words.sequences(begin, begin + gram, 0)
    return windows, least(grams, length - gram + 1)[windows], grams


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _BYTES_AT_ONCE together."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= _BYTES_AT_ONCE:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _packed(docs: DataFrame) -> DataFrame:
    """d, h, named, text: the text as UTF-8 compressed by zstd, which is what later joins move."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield {c: batch.column(c) for c in ("d", "h", "named")} | {"text": [press.compress(t) for t in batch.column("text").to_pylist()]}

    return arrow_map(docs, rows, "d long, h long, named boolean, text binary", pa.schema([("d", pa.int64()), ("h", pa.int64()), ("named", pa.bool_()), ("text", pa.binary())]))


def _unpack(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(t) for t in column.to_pylist()]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of integer lists in a row, and where each list begins and ends."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *sizes])


def seeds(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """anchor, one, two, d, h, at: each document's first anchors of each kind (hash of the gram, two hashes of its extension). docs: d, h,
    text (binary)."""
    reach = length - gram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = Hasher()
        for batch in batches:
            texts, d, h = batch.column("text").to_pylist(), batch.column("d").to_numpy(), batch.column("h").to_numpy()
            for a, b in _chunks(texts):
                words = Words(texts[a:b], hasher)
                _, chosen, grams = anchors(words, length, gram)
                at = np.unique(chosen)
                if not len(at):
                    continue
                doc = words.doc[at]
                left, right = np.maximum(at - reach, words.first[doc]), np.minimum(at + gram + reach, words.first[doc + 1])
                one, two = (_mixed(words.sequences(left, right, which) + (at - left).astype(np.uint64), which) for which in (0, 1))
                order, first = alike(doc, grams[at], one, two)
                once = np.sort(order[first])
                signed = {name: x[once].view(np.int64) for name, x in (("anchor", grams[at]), ("one", one), ("two", two))}
                yield signed | {"d": d[a:b][doc[once]], "h": h[a:b][doc[once]], "at": (at[once] - words.first[doc[once]]).astype(np.int32)}

    longs = [(c, pa.int64()) for c in ("anchor", "one", "two", "d", "h")]
    return arrow_map(docs, rows, "anchor long, one long, two long, d long, h long, at int", pa.schema([*longs, ("at", pa.int32())]))


def repeats(packed: DataFrame, plain: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """d, h, windows: the first words of the repeated windows that another document has first. Repeats within a document come later."""
    place = F.struct("d", "h", "at")
    found = materialize(seeds(plain, length, gram), "seeds")
    several = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("one").alias("low"), F.max("one").alias("high"), F.min("two").alias("low2"), F.max("two").alias("high2")).where("n > 1")
    several = materialize(several.select("anchor", ((F.col("low") < F.col("high")) | (F.col("low2") < F.col("high2"))).alias("open")), "anchors")
    live = materialize(found.join(several, "anchor").drop("anchor"), "live")  # read from a table, a join can split a key of many rows
    classes = materialize(live.groupBy("one", "two").agg(F.min(place).alias("first")), "classes")
    whole = place != F.col("first")
    marks = live.join(classes, ["one", "two"]).where(whole | F.col("open")).groupBy("d", "h").agg(F.collect_set(2 * F.col("at") + whole.cast("int")).alias("marks"))
    marks = materialize(marks, "marks")
    forget(found, several, live, classes)
    work = packed.join(marks, ["d", "h"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = Hasher()
        for batch in batches:
            d, h, texts = batch.column("d").to_numpy(), batch.column("h").to_numpy(), _unpack(batch.column("text"))
            marked, limits = _lists(batch.column("marks"))
            for a, b in _chunks(texts):
                words = Words(texts[a:b], hasher)
                windows, chosen, _ = anchors(words, length, gram)
                state = np.zeros(len(words.doc) + 1, np.int8)  # of each word's anchor: 1 to compare, 2 repeated whatever the window
                codes = marked[limits[a] : limits[b]]
                state[np.repeat(words.first[: b - a], np.diff(limits[a : b + 1])) + codes // 2] = 1 + codes % 2
                kind = state[chosen]
                for value, whole in ((2, True), (1, False)):
                    at = windows[kind == value]
                    doc = words.doc[at]
                    one, two = (np.zeros(len(at), np.uint64) if whole else words.sequences(at, at + length, which) for which in (0, 1))
                    if not whole:  # the first of equal windows in a document speaks for it
                        order, first = alike(doc, one, two)
                        once = np.sort(order[first])
                        at, doc, one, two = at[once], doc[once], one[once], two[once]
                    yield {"one": one.view(np.int64), "two": two.view(np.int64), "d": d[a:b][doc], "h": h[a:b][doc], "at": (at - words.first[doc]).astype(np.int32), "whole": np.full(len(at), whole)}

    longs = [(c, pa.int64()) for c in ("one", "two", "d", "h")]
    compared = arrow_map(work, rows, "one long, two long, d long, h long, at int, whole boolean", pa.schema([*longs, ("at", pa.int32()), ("whole", pa.bool_())]))
    compared = materialize(compared, "windows")
    open_ = compared.where("not whole").drop("whole")
    firsts = open_.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    firsts = materialize(firsts, "firsts")
    later = open_.join(firsts, ["one", "two"]).where(place != F.col("first")).select("d", "h", "at")
    return materialize(compared.where("whole").select("d", "h", "at").unionByName(later).groupBy("d", "h").agg(F.collect_set("at").alias("windows")), "repeats")


def covered(words: Words, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words the windows that begin at starts cover."""
    steps = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps)[:-1] > 0


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (the maximal repeats that go: structs of their first word and the first one after), kept (the words
    that stay, joined by one space), kept_sha256 for every row of docs."""
    d = F.col(id_col).cast("long")
    keyed = docs.select(F.coalesce(d, F.lit(_LAST)).alias("d"), F.xxhash64(text_col).alias("h"), d.isNotNull().alias("named"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    packed = _packed(keyed)
    found = repeats(packed, keyed, length, gram)
    work = packed.join(found, ["d", "h"], "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = Hasher()
        for batch in batches:
            d, named, texts = batch.column("d").to_pylist(), batch.column("named").to_pylist(), _unpack(batch.column("text"))
            given, limits = _lists(batch.column("windows"))
            for a, b in _chunks(texts):
                words = Words(texts[a:b], hasher)
                windows = words.windows(length)
                one, two = (words.sequences(windows, windows + length, which) for which in (0, 1))
                repeated = np.zeros(len(words.doc) + 1, bool)
                repeated[np.repeat(words.first[: b - a], np.diff(limits[a : b + 1])) + given[limits[a] : limits[b]]] = True
                order, first = alike(words.doc[windows], one, two)
                group = np.empty(len(windows), np.int64)
                group[order] = np.cumsum(first) - 1
                leader = order[first]
                gone = repeated[windows[leader]][group] | (leader[group] != np.arange(len(windows)))  # equal windows of a document share their fate
                removed = covered(words, windows[gone], length)
                out: dict[str, list] = {"n_words": [], "n_removed": [], "spans": [], "kept": [], "kept_sha256": []}
                for i, text in enumerate(texts[a:b]):
                    own = removed[words.first[i] : words.first[i + 1]]
                    pieces = text.split()
                    lost = int(own.sum())
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8))).tolist() if lost else []
                    kept = b" ".join(pieces if not lost else [w for w, r in zip(pieces, own.tolist(), strict=True) if not r])
                    out["n_words"].append(len(pieces))
                    out["n_removed"].append(lost)
                    out["spans"].append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                    out["kept"].append(kept.decode("utf-8", "replace"))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                yield {"doc_id": [x if own else None for x, own in zip(d[a:b], named[a:b], strict=True)]} | out

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string()), ("kept_sha256", pa.string())])
    return arrow_map(work, rows, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string, kept_sha256 string", schema)
