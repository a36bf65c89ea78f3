"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Every source's target (in words) is apportioned in blocks of equal size (BLOCK_WORDS; less where sources are small, so that a block is
at most a BLOCK_WORDS-th of the least positive target, and a word at least): seats go to the source with the highest quotient
target / (2 * seats + 1), found in closed form around the common divisor and settled by the last quotients. The same rule then deals
each source's seats to its shards, which follow a seeded hash of the document and its text and have a bounded size, in words and rows. In a shard documents stand
one after another in seeded order; the shard's quota takes that row of blocks as often as it goes round in full, and its first
blocks once more.

Defined results: a null text has size 0, takes nothing and stays in the result; the null source is a source of its own, last in
order; rows that share an id but not a text are documents of their own; sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, apart, materialize

WEIGHTS, TOTAL, CEILING = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SEED = 64, 42
#: Words and rows of a shard, about.
SHARD_WORDS, SHARD_ROWS = 2_000_000, 20_000
#: Rows of the table of sources up to which it is broadcast; beyond, the join shuffles.
MOST_BROADCAST = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *carried: str, weights: tuple = WEIGHTS, total: float = TOTAL, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target and the columns carried along. sizes: source, source_size, a row each.

    Capped shares w * t with the largest common t: sources are capped in order of cap / weight, so t follows from running sums."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", ceiling * F.col("source_size").cast("double"))
    ascending = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumn("caps", F.coalesce(F.sum("cap").over(ascending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("w").over(ascending.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (total * F.sum(F.col("source_size").cast("double")).over(everything) - F.col("caps")) / F.col("open")
    rows = rows.withColumn("level", level)
    t = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything)  # levels rise up to the first open source and fall after it
    return rows.select("source", "source_size", *carried, F.when(t.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * t)).alias("target"))


def sainte_lague(rows: DataFrame, within: list[str], share: str, seats: Column, ties: list) -> DataFrame:
    """rows with `quota`: `seats` (one number for each `within`) dealt by highest quotients share / (2 * quota + 1).

    The divisor total / seats gives every row round(share / divisor). If some seats are then missing, the rows offer their next
    quotients, all that reach the m-th highest of the first ones, and the m highest win; a surplus goes back by the least quotients."""
    group, columns = Window.partitionBy(*within), rows.columns
    divisor = F.try_divide(F.sum(share).over(group), seats)
    based = rows.withColumn("base", F.when(F.coalesce(divisor, F.lit(0.0)) > 0, F.floor(F.col(share) / divisor + 0.5)).otherwise(F.lit(0)).cast("long"))
    based = based.withColumn("missing", (seats - F.sum("base").over(group)).cast("long"))
    based = based.withColumn("next", F.col(share) / (2 * F.col("base") + 1)).withColumn("last", F.when(F.col("base") > 0, F.col(share) / (2 * F.col("base") - 1)))
    based = based.withColumn("up", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("next"), *ties)))
    based = based.withColumn("down", F.row_number().over(Window.partitionBy(*within).orderBy(F.col("last").asc_nulls_last(), *ties)))
    reach = F.when(F.col("missing") > 0, F.max(F.when(F.col("up") == F.col("missing"), F.col("next"))).over(group)).when(F.col("missing") < 0, F.max(F.when(F.col("down") == -F.col("missing"), F.col("last"))).over(group))
    based = based.withColumn("reach", reach)
    quotient = lambda k: F.col(share) / (2 * (F.col("base") + F.when(F.col("missing") > 0, k).otherwise(-k - 1)) + 1)
    most = F.when(F.col("missing") > 0, F.floor((F.col(share) / F.col("reach") - 1) / 2) - F.col("base") + 1).otherwise(F.col("base") - F.ceil((F.col(share) / F.col("reach") - 1) / 2))
    offers = F.when(F.coalesce(F.col("reach"), F.lit(0.0)) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(most, F.abs("missing"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    offered = based.select(*columns, "base", "missing", F.explode_outer(offers).alias("k"))
    offered = offered.withColumn("worth", F.when(F.col("missing") > 0, quotient(F.col("k"))).otherwise(F.when(F.col("base") > F.col("k"), -quotient(F.col("k")))))
    offered = offered.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc_nulls_last("worth"), *ties)))
    won = F.sum(F.when(F.col("k").isNotNull() & (F.col("worth").isNotNull()) & (F.col("place") <= F.abs("missing")), F.signum("missing")).otherwise(0))
    return offered.groupBy(*columns, "base").agg(won.alias("won")).select(*columns, (F.col("base") + F.col("won")).cast("long").alias("quota"))


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_hash for every row of docs. block: the most words of a block."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ties, everything = [F.col("source").asc_nulls_last()], Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    wanted = targets(sizes, "n_rows").withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / block))).cast("long"))
    seats = F.round(F.sum("target").over(everything) / F.col("block")).cast("long")
    wanted = sainte_lague(wanted.withColumn("seats", seats), [], "target", F.col("seats"), ties).withColumnRenamed("quota", "source_quota").drop("seats")
    wanted = materialize(wanted.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_rows") / SHARD_ROWS)).cast("int")).drop("n_rows"), "targets")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    wanted = wanted.withColumnRenamed("source", "s")
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    dealt = rows.join(wanted, same("source", "s")).drop("s")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("shards")).cast("int"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    shards = sainte_lague(shards.withColumn("share", F.col("shard_size").cast("double")), ["source"], "share", F.col("source_quota"), [F.col("shard")])
    shards = shards.select(F.col("source").alias("s"), F.col("shard").alias("k"), "shard_size", "quota", "block")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "doc_id"), "doc_id", "text_hash")
    placed = dealt.drop("block").withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.join(shards, same("source", "s") & (F.col("shard") == F.col("k")))
    words = F.least(F.col("quota") * F.col("block"), CEILING * F.col("shard_size"))
    rounds = F.coalesce(F.floor(F.try_divide(words, F.col("shard_size"))), F.lit(0))
    over = words - rounds * F.col("shard_size")
    again = F.greatest(F.lit(0), F.least(F.col("size"), over - (F.col("end") - F.col("size"))))
    return placed.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + again).cast("long").alias("taken"), "text_hash")


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents: a row for each full time that one is taken, and one with its first words where a block ends inside it.

    Columns are those of docs; n_chars, if there, becomes the length of the text that is left."""
    docs, back = apart(docs, ["doc_id", "text", "source", "n_chars"])
    keys = mix(docs, seed).where("taken > 0").select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    keys = keys.groupBy("__doc", "__source", "__hash", "__size").agg(F.sum("__taken").alias("__taken"), F.count("*").alias("__same"))
    held = docs.dropDuplicates(["doc_id", "source", "text"]) if not keys.where("__same > 1").isEmpty() else docs
    joined = held.join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__hash")))
    full, rest = F.floor(F.col("__taken") / F.col("__size")).cast("int"), (F.col("__taken") % F.col("__size")).cast("int")
    turns = F.sequence(F.lit(1), full + F.when(rest > 0, 1).otherwise(0))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), rest), " ")
    text = F.when(F.col("__turn") <= full, F.col("text")).otherwise(part)
    out = joined.withColumn("__turn", F.explode(turns)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)
