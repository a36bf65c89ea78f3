"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length one, so that the largest cosine is the least distance. Each shard of the table keeps one sorted array
per random projection. A query opens a window round its own projection in every array and widens all windows together (virtual
rehashing: the window of a level holds that of the level before). A vector that lies in the windows of enough arrays is verified
with its exact cosine in double precision. A query ends in a shard once its k-th best verified distance is within the level's
radius; windows that cover everything verify everything, so k neighbours are found wherever there are k.

Shards follow a hash of the row and have a bounded size; a large group of equal vectors is spread over all of them. A shard's index is
built once by the task that holds it, and the queries stream past it in batches. Where shards are fewer than tasks, each is held by
several tasks with a share of the queries; that number follows the cluster's cores, not the input.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
vectors of another length are no candidates of each other; equal rows (id and vector) count once. Where an id has several vectors, each
is a candidate, and each is a query of its own with ranks from 1; none is a candidate of a query with that id. Vectors are scaled by
powers of two first, so that neither huge nor tiny components overflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Rows of a shard, and the least queries worth an index of their own.
SHARD_ROWS, LEAST_QUERIES = 16_384, 256
#: Radii start at FIRST times the median distance and grow by GROWTH; a vector within the radius lies in a window with probability erf(HALF_WIDTH / sqrt 2).
PROJECTIONS, THRESHOLD, HALF_WIDTH, GROWTH, FIRST = 80, 0.57, 1.0, 1.2, 0.5


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component into [0.5, 1): cosines stay as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    made = scaled(vectors)
    return made / np.sqrt((made * made).sum(axis=1, keepdims=True))


class SortedProjections:
    """The index of one shard: per projection the sorted values, and each vector's place in that order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 17) -> None:
        self.ids, self.vectors, self.unit = ids, scaled(vectors), unit(vectors)
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        projected = (self.unit @ self.axes).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.place = np.empty(order.shape, np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)
        self.need = int(np.ceil(THRESHOLD * PROJECTIONS))
        spread = self.unit[:512] - self.unit[-512:][::-1]
        self.first = FIRST * max(float(np.median(np.sqrt((spread * spread).sum(axis=1)))), 1e-3)

    def windows(self, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds [low, high) of every query's window in each sorted array."""
        width = HALF_WIDTH * radius
        low = np.array([np.searchsorted(row, c - width) for row, c in zip(self.sorted, centres.T, strict=True)]).T
        high = np.array([np.searchsorted(row, c + width, "right") for row, c in zip(self.sorted, centres.T, strict=True)]).T
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector, the number of arrays in whose window it lies."""
        kind = self.place.dtype.type
        inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]  # wraps below low
        inside[high - low > np.iinfo(kind).max] = True
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query (a unit vector) the positions of the nearest found, a few more than k for ties."""
        centres, n = queries @ self.axes, len(self.ids)
        open_, radius = list(range(len(queries))), self.first
        done = [self.ids == q for q in query_ids]
        found: list[list[np.ndarray]] = [[] for _ in open_]
        scores = [np.zeros(0) for _ in open_]
        while open_:
            low, high = self.windows(centres[open_], radius)
            left = []
            for q, a, b in zip(open_, low, high, strict=True):
                fresh = np.flatnonzero((self.collisions(a, b) >= self.need) & ~done[q])
                if len(fresh):
                    done[q][fresh] = True
                    found[q].append(fresh)
                    scores[q] = np.concatenate([scores[q], self.unit[fresh] @ queries[q]])
                near = len(scores[q]) >= k and 2 - 2 * np.partition(scores[q], -k)[-k] <= radius**2
                if not near and not ((a == 0).all() and (b == n).all()):
                    left.append(q)
            open_, radius = left, radius * GROWTH
        out = []
        for parts, score in zip(found, scores, strict=True):
            at = np.concatenate(parts) if parts else np.zeros(0, int)
            limit = np.partition(score, -k)[-k] - 1e-9 if len(score) > k else -np.inf
            at = at[score >= limit]  # ties whole: they are ordered by exact cosine and vec_id
            out.append(at)
        return out


def exact(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision of scaled vectors, each from its own two vectors alone."""
    if not len(others):
        return np.zeros(0)
    norms = np.sqrt((query * query).sum()) * np.sqrt((others * others).sum(axis=1))
    return np.clip((others * query).sum(axis=1) / norms, -1, 1)


def _matrix(flat: pa.Array) -> np.ndarray:
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, embedding (doubles), dim of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch cut wherever one of the columns changes, with their values."""
    values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    turn = np.zeros(max(0, len(batch) - 1), bool)
    for v in values:
        turn |= v[1:] != v[:-1]
    edges = [0, *(np.flatnonzero(turn) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield tuple(v[a].item() for v in values), batch.slice(a, b - a)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row that is_query (a condition on vec_id) holds for."""
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "embedding"]).withColumn("row", F.xxhash64("vec_id", "embedding"))
    rows = materialize(rows, "vectors")
    total, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards = max(1, -(-total // shard_rows))
    copies = max(1, min(-(-rows.sparkSession.sparkContext.defaultParallelism // shards), asked // LEAST_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.col("row"), F.lit(n)).cast("int")
    stored = rows.select("dim", dealt(shards).alias("shard"), each(copies).alias("copy"), F.lit(False).alias("asks"), "vec_id", "row", "embedding")
    queries = rows.where(is_query).select("dim", each(shards).alias("shard"), dealt(copies).alias("copy"), F.lit(True).alias("asks"), "vec_id", "row", "embedding")
    kinds = [("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
    schema = pa.schema(kinds)

    def search(index: SortedProjections, batch: pa.RecordBatch) -> pa.RecordBatch:
        originals, out = scaled(_matrix(batch.column("embedding"))), ([], [], [], [])
        query_ids, numbers = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
        for query_id, number, original, at in zip(query_ids, numbers, originals, index.search(query_ids, unit(originals), k), strict=True):
            scores = exact(original, index.vectors[at])
            best = np.lexsort((index.ids[at], -scores))[:k]
            for column, value in zip(out, (np.full(len(best), query_id), np.full(len(best), number), index.ids[at][best], scores[best]), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, (_, t) in zip(out, kinds, strict=True)], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each shard the stored vectors come first, then the queries."""
        key, parts, index = None, [], None
        for batch in batches:
            for (*place, asks), run in _runs(batch, ["dim", "shard", "copy", "asks"]):
                if place != key:
                    key, parts, index = place, [], None
                if not asks:
                    parts.append((run.column("vec_id").to_numpy(), _matrix(run.column("embedding"))))
                elif parts or index:
                    if index is None:
                        index, parts = SortedProjections(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])), []
                    yield search(index, run)

    # a partition for each shard and copy (vectors of another length share them), so that none is coalesced with another
    order = ["dim", "shard", "copy", "asks"]
    together = stored.unionByName(queries).repartitionById(shards * copies, F.col("shard") * copies + F.col("copy")).sortWithinPartitions(*order)
    found = together.mapInArrow(stream, "query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
