"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a polynomial in a fixed base modulo a prime, for two primes. Chunks are hashed apart and combined by
length-shifted arithmetic: H(AB) = H(A) * base^len(B) + H(B). Texts of equal fingerprint and length are then compared with the
first of their group, chunk by chunk; where one differs (a collision), the whole group is split by the texts' SHA-256.

Defined results: a null text counts as empty; rows are documents of their own, so an id may repeat with other texts, each of which is in
its own group; rows with the same id and an equal text stay or go together; a null id is the largest, so such a row stays only in a
group without any id; the empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, byte_column, materialize

CHUNK = 1 << 16
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_000_003_919, 1_500_450_271)
_SPACE = frozenset(b" \t\n\v\f\r")
#: About so many texts are compared with one copy of the group's first text.
PER_SALT = 128
KEY = ["fp1", "fp2", "n_bytes"]
_LAST = (1 << 63) - 1


def normalise(text: bytes) -> bytes:
    """Every run of ASCII white space becomes one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + b" ".join(words) + (b" " if text[-1] in _SPACE else b"")


class Polynomial:
    """Fingerprints of chunks and their composition."""

    def __init__(self) -> None:
        self.powers = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            power, x = np.empty(CHUNK, np.int64), 1
            for i in range(CHUNK - 1, -1, -1):
                power[i], x = x, x * base % prime
            self.powers.append(power)

    def chunk(self, data: bytes) -> tuple[int, int]:
        """At most CHUNK bytes: each sum stays below 2^16 * 2^31 * 2^9 = 2^56."""
        values = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        return tuple(int(values @ power[CHUNK - len(values) :]) % prime for power, prime in zip(self.powers, PRIMES, strict=True))

    @staticmethod
    def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        return tuple((a * pow(base, right_length, prime) + b) % prime for a, b, base, prime in zip(left, right, BASES, PRIMES, strict=True))

    def text(self, data: bytes) -> tuple[int, int]:
        view, value = memoryview(data), (0, 0)
        for start in range(0, len(data), CHUNK):
            part = view[start : start + CHUNK]
            value = self.combine(value, self.chunk(part), len(part))
        return value


def same_text(a: bytes, b: bytes) -> bool:
    """Streams both texts chunk by chunk."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) to doc_id, h, both fingerprints, length in bytes and sha256 of the normalised text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        poly = Polynomial()
        for batch in batches:
            out: dict[str, list] = {"fp1": [], "fp2": [], "n_bytes": [], "sha": []}
            for text in byte_column(batch, "text"):
                data = normalise(text or b"")
                one, two = poly.text(data)
                out["fp1"].append(one)
                out["fp2"].append(two)
                out["n_bytes"].append(len(data))
                out["sha"].append(hashlib.sha256(data).hexdigest())
            yield {"doc_id": batch.column("doc_id").cast(pa.int64()), "h": batch.column("h")} | out

    longs = [(name, pa.int64()) for name in ("doc_id", "h", *KEY)]
    return arrow_map(docs, rows, "doc_id long, h long, fp1 long, fp2 long, n_bytes long, sha string", pa.schema([*longs, ("sha", pa.string())]))


def collisions(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The fingerprints (KEY) of groups that hold a text unlike that of their first row. docs: doc_id, h, text; members: doc_id, h, KEY,
    first (the group's first row as a struct of doc_id and h), n, of groups of two rows or more.

    Equal rows (of one id and hash) are compared once. A group's first text meets the others in bundles of at most PER_SALT."""
    whose = lambda c: F.coalesce(F.col(c), F.lit(_LAST))
    asked = members.select(whose("doc_id").alias("a"), F.col("h").alias("b"), *KEY, F.struct("doc_id", "h").eqNullSafe(F.col("first")).alias("first"), "n").distinct()
    held = docs.groupBy(whose("doc_id").alias("d"), "h").agg(F.first("text").alias("text"))  # one row per id and text before the shuffle
    salts = F.ceil(F.col("n") / PER_SALT).cast("int")
    salt = F.when(F.col("first"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("a", "b"), salts).cast("int")))
    texts = asked.join(held, (F.col("a") == F.col("d")) & (F.col("b") == F.col("h"))).select(*KEY, "first", F.explode(salt).alias("salt"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        group, held = None, b""
        for batch in batches:
            odd: list[tuple] = []
            keys = zip(*(batch.column(c).to_pylist() for c in (*KEY, "salt")), strict=True)
            for key, text in zip(keys, byte_column(batch, "text"), strict=True):
                data = normalise(text or b"")
                if key != group:
                    group, held = key, data
                elif not same_text(held, data):
                    odd.append(key[:-1])
            yield {c: [k[i] for k in odd] for i, c in enumerate(KEY)}

    ordered = texts.repartition(*KEY, "salt").sortWithinPartitions(*KEY, "salt", F.desc("first"))
    return arrow_map(ordered, rows, "fp1 long, fp2 long, n_bytes long", pa.schema([(c, pa.int64()) for c in KEY]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    prints = materialize(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    groups = prints.groupBy(*KEY).agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select(*KEY, "n", F.struct("least.doc_id", "least.h").alias("first"), F.col("least.doc_id").alias("keep_id"))
    groups = materialize(groups, "groups")  # read from a table, the join can split a key of many rows
    joined = materialize(prints.join(groups, KEY, "left"), "joined")
    odd = materialize(collisions(docs, joined.where("n > 1").select("doc_id", "h", *KEY, "first", "n")).distinct(), "collisions")
    if not odd.isEmpty():  # texts that differ though their fingerprints agree
        apart = prints.join(odd, KEY, "left_semi")
        again = apart.groupBy(*KEY, "sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        rest = joined.join(odd, KEY, "left_anti").select(*prints.columns, "keep_id", "n")
        joined = rest.unionByName(apart.join(materialize(again, "split"), [*KEY, "sha"]).select(*prints.columns, "keep_id", "n"))
    single = F.col("n").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
