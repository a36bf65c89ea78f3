"""Best-fit packing of token sequences.

Texts are tokenized once. What packing needs of them is the number of pieces of each length, a table of at most `capacity` rows;
packing is planned on it with bin patterns (a multiset of lengths and how many bins look like it), so that the plan's size doesn't
follow the input. A best-fit start is improved by swap-based local search among underfull bins: documents move, or are exchanged
one for one or two for one, wherever that raises the sum of squared fills, until bins become empty or nothing improves. Pieces are
then numbered within their length by seeded buckets and take the plan's places by binary search.

Defined results: a null or empty text has one piece, of the end token alone; rows that share an id, or have none, are packed each for
itself, equal rows too; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, materialize

CAPACITY, END = 1024, 2
BUCKET_ROWS = 8_192


class ByteTokenizer:
    """Token ids of the tokenizer file, as little-endian unsigned 32-bit bytes.

    Byte-level BPE merges in order of rank, which is the order of ids, so that the file's vocabulary as ranks gives the same ids, four
    times as fast. Texts that may hold a special token are left to the file's own tokenizer."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.marks = tuple({t[:2] for t in special})
        # fixed values: byte-level BPE writes the printable Latin-1 characters as themselves, and the other bytes as those from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.marks):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) to doc_id, piece, start, length, ids_crc32, `number` (running in each task), and the ids themselves if asked for."""
    stop = np.array([end], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder, context = ByteTokenizer(tokenizer), TaskContext.get()
        number = itertools.count((context.partitionId() if context else 0) << 40)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "number", "ids")}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = coder.encode(text or "") + stop
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        view = ids[4 * a : 4 * b]
                        values = (doc_id, piece, a, b - a, zlib.crc32(view), next(number), np.frombuffer(view, "<i4").tolist() if keep_ids else None)
                        for column, value in zip(out.values(), values, strict=True):
                            column.append(value)
                yield out

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("number", pa.int64()), ("ids", pa.list_(pa.int32()))])
    made = arrow_map(docs, rows, "doc_id long, piece int, start long, length long, ids_crc32 long, number long, ids array<int>", schema)
    return made if keep_ids else made.drop("ids")


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Patterns (descending lengths) and their numbers: each bin takes the largest length that still fits, again and again."""
    left, sizes, plan = dict(counts), sorted(n for n, c in counts.items() if c), Counter()
    while sizes:
        room, pattern = capacity, Counter()
        limit = len(sizes)
        while limit:
            limit = bisect.bisect_right(sizes, room, 0, limit)
            if not limit:
                break
            length = sizes[limit - 1]
            copies = min(room // length, left[length])
            pattern[length] = copies
            room -= copies * length
            limit -= 1
        times = min(left[length] // copies for length, copies in pattern.items())
        plan[tuple(sorted(pattern.elements(), reverse=True))] += times
        for length, copies in pattern.items():
            left[length] -= times * copies
            if not left[length]:
                sizes.pop(bisect.bisect_left(sizes, length))
    return plan


def _exchange(a: tuple, b: tuple, room: int) -> tuple[tuple, tuple] | None:
    """The best move, one-for-one or two-for-one exchange that fills a (at least as full as b) further, within its room."""
    best: tuple[int, tuple, tuple] | None = None

    def offer(gain: int, out: tuple, into: tuple) -> None:
        nonlocal best
        if 0 < gain <= room and (best is None or gain > best[0]):
            best = gain, out, into

    singles_a, singles_b = sorted(set(a)), sorted(set(b))
    for y in singles_b:
        offer(y, (), (y,))
        for x in singles_a:
            offer(y - x, (x,), (y,))
    ones = Counter(b)
    pairs_b = {x + y: (x, y) for i, x in enumerate(singles_b) for y in singles_b[i:] if x != y or ones[x] > 1}
    ones = Counter(a)
    pairs_a = {x + y: (x, y) for i, x in enumerate(singles_a) for y in singles_a[i:] if x != y or ones[x] > 1}
    for total, two in pairs_b.items():
        for x in singles_a:
            offer(total - x, (x,), two)
    for total, two in pairs_a.items():
        for y in singles_b:
            offer(y - total, two, (y,))
    if best is None:
        return None
    taken, given = Counter(a) - Counter(best[1]) + Counter(best[2]), Counter(b) - Counter(best[2]) + Counter(best[1])
    return tuple(sorted(taken.elements(), reverse=True)), tuple(sorted(given.elements(), reverse=True))


def local_search(plan: Counter, capacity: int) -> Counter:
    """Raises the squared fill of underfull bins until no exchange between two patterns does; whole groups of equal bins move together."""
    plan, stuck = Counter(plan), set()
    while True:
        under = sorted((p for p in plan if p and sum(p) < capacity), key=lambda p: (-sum(p), p))
        step = None
        for i in range(len(under) - 1, -1, -1):  # empty the least filled first
            for a in under[:i] + ([under[i]] if plan[under[i]] > 1 else []):
                if (a, under[i]) in stuck:
                    continue
                if change := _exchange(a, under[i], capacity - sum(a)):
                    step = a, under[i], change
                    break
                stuck.add((a, under[i]))
            if step:
                break
        if not step:
            return Counter({p: n for p, n in plan.items() if p and n})
        a, b, (fuller, emptier) = step
        times = plan[a] // 2 if a == b else min(plan[a], plan[b])
        for pattern, sign in ((a, -1), (b, -1), (fuller, 1), (emptier, 1)):
            plan[pattern] += sign * times
        plan = Counter({p: n for p, n in plan.items() if p and n})


class Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, plan: Counter) -> None:
        first, used, spans = 0, Counter(), {}
        for pattern, times in sorted(plan.items(), reverse=True):
            offset = 0
            for length, copies in sorted(Counter(pattern).items(), reverse=True):
                spans.setdefault(length, []).append((used[length], copies, first, offset))
                used[length] += copies * times
                offset += copies * length
            first += times
        self.sequences = first
        self.spans = {length: np.array(rows, np.int64).T for length, rows in spans.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            start, copies, first, shift = self.spans[size]
            span = np.searchsorted(start, rank[at], "right") - 1
            into = rank[at] - start[span]
            sequence[at] = first[span] + into // copies[span]
            offset[at] = shift[span] + into % copies[span] * size
        return sequence, offset


def ranked(cut: DataFrame) -> DataFrame:
    """Numbers the rows of each length from 0: by buckets of bounded size, whose numbers start where the buckets before them end. Buckets
    follow the stored running number, so that neither a frequent length nor rows alike make one large."""
    buckets = max(1, -(-cut.count() // BUCKET_ROWS))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("number")) - 1
    numbered = dealt.withColumn("inside", inside)
    return numbered.join(starts, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("first") + F.col("inside")).drop("l", "b", "first", "inside", "bucket")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = materialize(pieces(docs, tokenizer, capacity, end), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = Places(local_search(best_fit(counts, capacity), capacity))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield {c: batch.column(c) for c in columns} | {"sequence_id": sequence, "offset": offset}

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))])
    return arrow_map(ranked(cut).select(*columns, "rank"), rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", schema)
