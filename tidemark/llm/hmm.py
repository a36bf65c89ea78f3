"""Hidden Markov language model.

A token (a lower-cased word, or the end of a document) belongs to a class: the most frequent words have one each, others share one by
their last bytes, and the end has its own. Latent states follow each other and emit classes; a class emits its words in proportion to
their counts plus one. Baum-Welch passes over the class sequences of all training documents aggregate expected counts over partitions;
the tables they fit have a fixed size. The scaled forward recursion over the whole document gives its exact likelihood under the model.

Documents are never cut: a long one is worked on in pieces side by side, each piece's transfer matrix (the product of its steps) carries
the forward message over it and the backward message back, and with its own two messages a piece gives the counts, or the likelihood,
that the whole recursion would.

Word counts grow with the corpus and never meet in one place. Each task numbers the words of its documents in blocks of bounded size
and counts them; counts of words are summed by a shuffle, and each block gets back the sums of those of its words that other blocks
have too. Words are compared by 64-bit hashes.

Defined results: null and blank texts have the end token alone; rows with a null id train and are not held out; every row is scored and
trains for itself, also rows that share an id and equal ones; without training rows all counts are zero; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, crc_bucket, materialize
from tidemark.llm.substring_dedup import Hasher, Words, _chunks, _mixed

PARTS, HELD_OUT = 7, 2
STATES, PASSES = 6, 5
#: Tokens of a piece, of the grid of pieces that is worked on at once, and of the documents that are held at once (at least one).
PIECE, GRID, HELD = 512, 1 << 17, 1 << 19
FREQUENT, SUFFIXES = 4096, 4096
END = FREQUENT + SUFFIXES
CLASSES = END + 1
BLOCK_BYTES = 12_000_000
_SUFFIX_BYTES = 3
#: Pseudo-counts, spread as the classes are, that each state's emissions get, and each transition.
SMOOTH_EMIT, SMOOTH_MOVE = 500.0, 10.0


def tokens(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, suffix numbers, and the number of words of each text."""
    hashes, suffixes, counts = [], [], []
    for a, b in _chunks(texts):
        low = [t.lower() for t in texts[a:b]]  # bytes: only A-Z change
        words = Words(low, hasher, (0,))
        data = np.frombuffer(b"\0" * _SUFFIX_BYTES + b" ".join([*low, b""]), np.uint8).astype(np.uint64)
        code = np.zeros(len(words.start), np.uint64)
        for i in range(1, _SUFFIX_BYTES + 1):
            inside = words.end - i >= words.start
            code = code * np.uint64(257) + np.where(inside, data[words.end - i + _SUFFIX_BYTES] + np.uint64(1), np.uint64(0))
        hashes.append(words.words[0])
        suffixes.append((_mixed(code, 1) % np.uint64(SUFFIXES)).astype(np.int32))
        counts.append(np.diff(words.first))
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(suffixes), np.concatenate(counts)


def _concatenated(parts: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def blocks_of(docs: DataFrame) -> DataFrame:
    """A row per document (block, doc_id, held_out, n_words, and places: its words as numbers within the block) and one per block, with
    the hash, suffix number and training count of each word. docs: doc_id, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher, press, context = Hasher(), zstandard.ZstdCompressor(level=1), TaskContext.get()
        block, held, volume = (context.partitionId() if context else 0) << 32, [], 0

        def made() -> dict:
            hashes, suffixes, counts = tokens([text for _, _, text in held], hasher)
            distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            train = np.array([not out for _, out, _ in held])
            own = np.bincount(place[np.repeat(train, counts)], minlength=len(distinct))
            ends, place, hashes = np.cumsum(counts), place.astype("<u4"), None
            places = [press.compress(place[a:b].tobytes()) for a, b in zip(ends - counts, ends, strict=True)]
            of_block = [press.compress(x.tobytes()) for x in (distinct.astype("<u8"), suffixes[first].astype("<u2"), own.astype("<i8"))]
            return {
                "block": [block] * (len(held) + 1), "doc_id": [x for x, _, _ in held] + [None], "held_out": [x for _, x, _ in held] + [None], "n_words": [*counts.tolist(), None], "places": [*places, None],
            } | {name: [None] * len(held) + [x] for name, x in zip(("words", "suffixes", "counts"), of_block, strict=True)}

        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                    held.append(row)
                    volume += len(row[2])
                    if volume >= BLOCK_BYTES:
                        yield made()
                        block, held, volume = block + 1, [], 0
        if held:
            yield made()

    held_out = F.coalesce(crc_bucket(F.col("doc_id"), PARTS) == HELD_OUT, F.lit(False))
    binary = [(c, pa.binary()) for c in ("places", "words", "suffixes", "counts")]
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), *binary])
    keyed = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return materialize(arrow_map(keyed, rows, "block long, doc_id long, held_out boolean, n_words long, places binary, words binary, suffixes binary, counts binary", schema), "blocks")


def word_rows(blocks: DataFrame) -> DataFrame:
    """block, i, word, n: the words of each block by their numbers, and their training counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True):
                word, n = np.frombuffer(expand.decompress(words), "<i8"), np.frombuffer(expand.decompress(counts), "<i8")
                for at in range(0, len(word), 1 << 16):
                    part = word[at : at + (1 << 16)]
                    yield {"block": np.full(len(part), block), "i": np.arange(at, at + len(part), dtype=np.int32), "word": part, "n": n[at : at + (1 << 16)]}

    schema = pa.schema([("block", pa.int64()), ("i", pa.int32()), ("word", pa.int64()), ("n", pa.int64())])
    return arrow_map(blocks.where("words is not null").select("block", "words", "counts"), rows, "block long, i int, word long, n long", schema)


def sequences(blocks: DataFrame) -> DataFrame:
    """A row per document (doc_id, held_out, n_words, n_known, log_counts, classes) and one per block with the counts and the number of
    words of its classes (train_docs, class_tokens, class_words)."""
    words = word_rows(blocks)
    totals = words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("held"), F.min("block").alias("lead"))
    totals = materialize(totals, "counts")  # read from a table, the join below can split a word of many rows
    top = totals.orderBy(F.desc("c"), "word").limit(FREQUENT).select("word").collect()  # FREQUENT rows at most
    frequent = blocks.sparkSession.createDataFrame([(r.word, k) for k, r in enumerate(top)], "word long, own int")
    known = totals.join(F.broadcast(frequent), "word", "left").where("held > 1 or own is not null")  # FREQUENT rows broadcast
    shared = words.drop("n").join(known.drop("held"), "word").select("block", "i", F.col("c").cast("long").alias("c"), (F.col("block") == F.col("lead")).alias("lead"), F.coalesce("own", F.lit(-1)).alias("own"))
    names = ["doc_id", "held_out", "n_words", "n_known", "log_counts", "classes", "train_docs", "class_tokens", "class_words"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def number(table: pa.Table, given: pa.Table) -> pa.Table:
        expand, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        of_block = table.column("suffixes").is_valid()
        docs, own_row = table.filter(table.column("suffixes").is_null()), table.filter(of_block).to_pylist()[0]
        suffix, own = (np.frombuffer(expand.decompress(own_row[c]), kind) for c, kind in (("suffixes", "<u2"), ("counts", "<i8")))
        total, leads = own.astype(np.int64), np.ones(len(own), bool)
        at, number = given.column("i").to_numpy(), given.column("own").to_numpy()
        total[at], leads[at] = given.column("c").to_numpy(), given.column("lead").to_numpy(zero_copy_only=False)
        kind = FREQUENT + suffix.astype(np.int64)
        kind[at[number >= 0]] = number[number >= 0]
        logs, known, of_word = np.log10(total + 1.0), total > 0, kind.astype("<u2")
        rows: dict[str, list] = {c: docs.column(c).to_pylist() for c in ("doc_id", "held_out", "n_words")} | {"n_known": [], "log_counts": [], "classes": []}
        for data in docs.column("places").to_pylist():
            place = np.frombuffer(expand.decompress(data), "<u4")
            rows["n_known"].append(int(known[place].sum()))
            rows["log_counts"].append(float(logs[place].sum()))
            rows["classes"].append(press.compress(of_word[place].tobytes()))
        blank = [None] * len(docs)
        rows = {k: [*v, None] for k, v in rows.items()}
        rows["train_docs"] = [*blank, len(docs) - sum(rows["held_out"][:-1])]
        rows["class_tokens"] = [*blank, np.bincount(kind, weights=own, minlength=END).astype(np.int64).tolist()]
        rows["class_words"] = [*blank, np.bincount(kind[leads & known], minlength=END).tolist()]
        return pa.Table.from_pydict(rows, schema=schema)

    made = blocks.drop("words").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(number, "doc_id long, held_out boolean, n_words long, n_known long, log_counts double, classes binary, train_docs long, class_tokens array<long>, class_words array<long>")
    return materialize(made, "sequences")


class Pieces:
    """Sequences (flat[offset : offset + length]) as pieces of at most `size` tokens, in order of sequence and place."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, size: int) -> None:
        counts = -(-lengths // size)
        self.flat, self.sequence = flat, np.repeat(np.arange(len(lengths)), counts)
        self.nth = np.arange(len(self.sequence)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.offset = (np.cumsum(lengths) - lengths)[self.sequence] + self.nth * size
        self.length = np.minimum(size, lengths[self.sequence] - self.nth * size)

    def grids(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of those chosen, longest first; their tokens as [time, piece]; and how many of them reach each time."""
        order, at = chosen[np.argsort(-self.length[chosen], kind="stable")], 0
        while at < len(order):
            steps = self.length[order[at]]
            part = order[at : at + max(1, GRID // steps)]
            time, length = np.arange(steps)[:, None], self.length[part]
            yield part, self.flat[np.where(time < length, self.offset[part] + time, 0)], np.searchsorted(-length, -np.arange(1, steps + 1), "right")
            at += len(part)

    def rounds(self) -> list[np.ndarray]:
        """The second pieces of all sequences that have one, the third ones, and so on."""
        later = np.flatnonzero(self.nth)
        later = later[np.argsort(self.nth[later], kind="stable")]
        return np.split(later, np.flatnonzero(np.diff(self.nth[later])) + 1) if len(later) else []


class Model:
    """Start, transition and emission tables."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, shares: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
        """Sticky states whose emissions are the classes' shares, disturbed."""
        emit = shares[:, None] * np.random.default_rng(seed).gamma(1.0, 1.0, (len(shares), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def first_messages(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """The forward message behind each sequence's first piece, and its log10 likelihood up to there."""
        first = np.flatnonzero(pieces.nth == 0)
        message, logs = np.empty((len(first), len(self.start))), np.zeros(len(first))
        for part, seen, active in pieces.grids(first):
            alpha, total = np.tile(self.start, (len(part), 1)), np.zeros(len(part))
            for t, k in enumerate(active):
                now = (alpha[:k] @ self.move if t else alpha) * self.emit[seen[t, :k]]
                scale = now.sum(axis=1)
                total[:k] += np.log10(scale)
                alpha[:k] = now / scale[:, None]
            message[pieces.sequence[part]], logs[pieces.sequence[part]] = alpha, total
        return message, logs

    def transfers(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """For every piece but the first of a sequence, the product of its steps, scaled, and log10 of the scale."""
        states = len(self.start)
        product, logs = np.zeros((len(pieces.nth), states, states)), np.zeros(len(pieces.nth))
        for part, seen, active in pieces.grids(np.flatnonzero(pieces.nth)):
            held, total = np.tile(np.eye(states), (len(part), 1, 1)), np.zeros(len(part))
            for t, k in enumerate(active):
                now = (held[:k].reshape(-1, states) @ self.move).reshape(k, states, states) * self.emit[seen[t, :k]][:, None, :]
                scale = now.sum(axis=(1, 2))
                total[:k] += np.log10(scale)
                held[:k] = now / scale[:, None, None]
            product[part], logs[part] = held, total
        return product, logs

    def log10_likelihood(self, flat: np.ndarray, lengths: np.ndarray, size: int = PIECE) -> np.ndarray:
        """Scaled forward recursion over sequences that follow each other in flat; exact."""
        pieces = Pieces(flat, lengths, size)
        message, out = self.first_messages(pieces)
        product, logs = self.transfers(pieces)
        for at in pieces.rounds():
            own = pieces.sequence[at]
            now = np.einsum("ns,nst->nt", message[own], product[at])
            scale = now.sum(axis=1)
            message[own] = now / scale[:, None]
            out[own] += np.log10(scale) + logs[at]
        return out

    def expected(self, flat: np.ndarray, lengths: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of whole sequences that follow each other in flat."""
        pieces, states = Pieces(flat, lengths, size), len(self.start)
        message, _ = self.first_messages(pieces)
        product, _ = self.transfers(pieces)
        before, behind = np.zeros((len(pieces.nth), states)), np.ones((len(pieces.nth), states))
        rounds = pieces.rounds()
        for at in rounds:  # forward messages before each piece
            own = pieces.sequence[at]
            before[at] = message[own]
            now = np.einsum("ns,nst->nt", message[own], product[at])
            message[own] = now / now.sum(axis=1)[:, None]
        for at in reversed(rounds):  # backward messages behind each piece
            now = np.einsum("nst,nt->ns", product[at], behind[at])
            behind[at - 1] = now / now.sum(axis=1)[:, None]
        starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((len(self.emit), states))
        for part, seen, active in pieces.grids(np.arange(len(pieces.nth))):
            steps, n = seen.shape
            emitted, begins = self.emit[seen], pieces.nth[part] == 0
            alpha, scale = np.zeros((steps, n, states)), np.ones((steps, n))
            prior = np.where(begins[:, None], self.start, before[part] @ self.move)
            for t, k in enumerate(active):
                now = alpha[t, :k]
                np.multiply(alpha[t - 1, :k] @ self.move if t else prior, emitted[t, :k], out=now)
                scale[t, :k] = now.sum(axis=1)
                now /= scale[t, :k, None]
            beta = behind[part]
            beta /= (alpha[pieces.length[part] - 1, np.arange(n)] * beta).sum(axis=1)[:, None]
            for t in range(steps - 1, -1, -1):
                k = active[t]
                ahead = emitted[t, :k] * beta[:k] / scale[t, :k, None]
                moves += (alpha[t - 1, :k].T if t else before[part].T) @ ahead  # nothing stands before a sequence
                alpha[t, :k] *= beta[:k]
                if t:
                    beta[:k] = ahead @ self.move.T
            for i in range(states):
                emissions[:, i] += np.bincount(seen.ravel(), weights=alpha[:, :, i].ravel(), minlength=len(self.emit))
            starts += alpha[0][begins].sum(axis=0)
        return starts, moves * self.move, emissions


def _whole(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Class sequences of a column, their ends included, about HELD tokens at a time: which rows, the classes in a row, the lengths."""
    expand, held, volume, at = zstandard.ZstdDecompressor(), [], 0, 0
    for i, data in enumerate(column.to_pylist()):
        held.append(np.append(np.frombuffer(expand.decompress(data), "<u2"), np.uint16(END)))
        volume += len(held[-1])
        if volume >= HELD or i == len(column) - 1:
            yield slice(at, i + 1), np.concatenate(held), np.array([len(x) for x in held])
            held, volume, at = [], 0, i + 1


def baum_welch(documents: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One pass over all training documents; counts are summed over partitions class by class."""
    states = len(model.start)
    columns = [f"s{i}" for i in range(states)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((CLASSES + states + 1, states))
        for batch in batches:
            for _, flat, lengths in _whole(batch.column("classes")):
                starts, moves, emissions = model.expected(flat, lengths)
                total[:CLASSES] += emissions
                total[CLASSES : CLASSES + states] += moves
                total[-1] += starts
        rows_ = np.flatnonzero(total.any(axis=1))
        yield {"row": rows_.astype(np.int32)} | {c: total[rows_, i] for i, c in enumerate(columns)}

    counted = arrow_map(documents.select("classes"), rows, "row int, " + ", ".join(f"{c} double" for c in columns), pa.schema([("row", pa.int32()), *((c, pa.float64()) for c in columns)]))
    summed = counted.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).collect()  # CLASSES + STATES + 1 rows at most
    total = np.zeros((CLASSES + states + 1, states))
    for r in summed:
        total[r["row"]] = r[1:]
    emit = total[:CLASSES] + SMOOTH_EMIT * shares[:, None]
    move = total[CLASSES : CLASSES + states] + SMOOTH_MOVE / states
    start = total[-1] + 1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def fit(made: DataFrame, passes: int = PASSES) -> tuple[Model, np.ndarray, int, int, int]:
    """The model, log10 of the number by which each class divides its words' counts plus one, training tokens, distinct ones and
    documents. made: of sequences()."""
    summary = made.where("train_docs is not null")
    train_docs = summary.agg(F.sum("train_docs")).first()[0] or 0
    cells = F.posexplode(F.arrays_zip("class_tokens", "class_words")).alias("k", "x")
    per_class = summary.select(cells).groupBy("k").agg(F.sum("x.class_tokens").alias("n"), F.sum("x.class_words").alias("v")).collect()  # END rows
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        n[r.k], v[r.k] = r.n, r.v
    n[END], v[END] = train_docs, train_docs > 0
    shares = (n + 1) / (n + 1).sum()
    inside = np.log10(n + v + 1)  # a word of a class has probability (c + 1) / (n + v + 1)
    inside[:FREQUENT], inside[END] = np.log10(np.maximum(n[:FREQUENT] + 1, 1)), np.log10(n[END] + 1)  # classes of one word
    model = Model.initial(shares)
    training = made.where("train_docs is null and not held_out")
    for _ in range(passes if train_docs else 0):
        model = baum_welch(training, model, shares)
    return model, inside, int(n.sum()), int(v.sum()), train_docs


def score_documents(docs: DataFrame, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    made = sequences(blocks_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    model, inside, everything, distinct, train_docs = fit(made, passes)
    base, end_count = float(np.log10(everything + distinct + 1)), float(np.log10(train_docs + 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for at, flat, lengths in _whole(whole.column("classes")):
                batch = whole.slice(at.start, at.stop - at.start)
                logs = batch.column("log_counts").to_numpy() + end_count
                within = np.add.reduceat(inside[flat], np.cumsum(lengths) - lengths)
                yield {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": lengths,
                    "n_known": batch.column("n_known").to_numpy() + int(train_docs > 0), "train_tokens": np.full(len(lengths), everything),
                    "base_score": logs - lengths * base,
                    "score": model.log10_likelihood(flat, lengths) + logs - within,
                }

    longs = [(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")]
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *longs, ("base_score", pa.float64()), ("score", pa.float64())])
    documents = made.where("train_docs is null").drop("train_docs", "class_tokens", "class_words")
    return arrow_map(documents, rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", schema)
