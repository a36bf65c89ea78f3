"""Long series in blocks, so that one symbol's rows spread over many tasks.

Window functions over a whole series put it into one task. Here a series is cut into blocks of its order; what a block needs of the ones
before it is a row of carried values, and what a bounded frame reaches beyond a block are copies of the rows at its edges. Only the
carries, a row for each block, are ever taken through a window over a whole series."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Width of a block in units of time (of whole seconds mostly), and rows of a block of numbered rows.
TIME, ROWS = 1 << 16, 1 << 16
BLOCK, OWN = "__block", "__own"


def block_of(t: Column, size: int) -> Column:
    return F.floor(t / F.lit(size)).cast("long")


def _with_carries(rows: DataFrame, ends: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """rows with the block's carries; null keys are keys like any other."""
    renamed = ends.select(*(F.col(k).alias(f"__e{i}") for i, k in enumerate([*keys, BLOCK])), *names)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__e{i}")) for i, k in enumerate([*keys, BLOCK])))
    return rows.join(renamed, same, "left").drop(*(f"__e{i}" for i in range(len(keys) + 1)))


def carried(rows: DataFrame, keys: list[str], t: str, order: list[str], values: dict[str, Column], size: int = TIME, before: bool = False) -> DataFrame:
    """Adds for each name the last value that is not null up to the row (or before it), in order of `order`, which begins with or follows t."""
    names = list(values)
    rows = rows.withColumns({BLOCK: block_of(F.col(t), size), **{f"__v{i}": c for i, c in enumerate(values.values())}})
    by = F.struct(*order)
    ends = rows.groupBy(*keys, BLOCK).agg(*(F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), by)).alias(f"__c{i}") for i in range(len(names))))
    past = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"__c{i}": F.last(f"__c{i}", ignorenulls=True).over(past) for i in range(len(names))})
    own = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    rows = rows.withColumns({f"__l{i}": F.last(f"__v{i}", ignorenulls=True).over(own) for i in range(len(names))})
    rows = _with_carries(rows, ends, keys, [f"__c{i}" for i in range(len(names))])
    rows = rows.withColumns({n: F.coalesce(f"__l{i}", f"__c{i}") for i, n in enumerate(names)})
    return rows.drop(BLOCK, *(f"__{x}{i}" for i in range(len(names)) for x in "vlc"))


def previous(rows: DataFrame, keys: list[str], t: str, order: list[str], values: dict[str, Column], size: int = TIME) -> DataFrame:
    """Adds the values of the row before, null ones too."""
    out = carried(rows, keys, t, order, {"__before": F.struct(*(c.alias(n) for n, c in values.items()))}, size, before=True)
    return out.select(*(c for c in out.columns if c != "__before"), *(F.col("__before")[n].alias(n) for n in values))


def running(rows: DataFrame, keys: list[str], t: str, order: list[str], values: dict[str, Column], size: int = TIME) -> DataFrame:
    """Adds running sums up to the row."""
    names = list(values)
    rows = rows.withColumns({BLOCK: block_of(F.col(t), size), **{f"__v{i}": c for i, c in enumerate(values.values())}})
    past = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, BLOCK).agg(*(F.sum(f"__v{i}").alias(f"__c{i}") for i in range(len(names))))
    ends = ends.withColumns({f"__c{i}": F.sum(f"__c{i}").over(past) for i in range(len(names))})
    own = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"__l{i}": F.sum(f"__v{i}").over(own) for i in range(len(names))})
    rows = _with_carries(rows, ends, keys, [f"__c{i}" for i in range(len(names))])
    rows = rows.withColumns({n: F.coalesce(f"__l{i}", F.lit(0)) + F.coalesce(f"__c{i}", F.lit(0)) for i, n in enumerate(names)})
    return rows.drop(BLOCK, *(f"__{x}{i}" for i in range(len(names)) for x in "vlc"))


def numbered(rows: DataFrame, keys: list[str], t: str, size: int = TIME, name: str = "__n") -> DataFrame:
    """Adds the place of each row in its series, from 0."""
    return running(rows, keys, t, [t], {name: F.lit(1).cast("long")}, size).withColumn(name, F.col(name) - 1)


def overlapped(rows: DataFrame, keys: list[str], t: str, back: int, ahead: int, size: int) -> tuple[DataFrame, WindowSpec]:
    """Rows once for each block whose own rows see them within [t - back, t + ahead] (of theirs), marked as own or not, and the window
    over a block. Blocks are at least four times as wide as what overlaps."""
    size = max(size, 4 * (back + ahead))
    blocks = F.sequence(block_of(F.col(t) - ahead, size), block_of(F.col(t) + back, size))
    out = rows.withColumn(BLOCK, F.explode(blocks)).withColumn(OWN, F.col(BLOCK) == block_of(F.col(t), size))
    return out, Window.partitionBy(*keys, BLOCK).orderBy(t)


def trailing(rows: DataFrame, keys: list[str], t: str, depth: int, make: Callable[[DataFrame, WindowSpec], DataFrame], size: int = ROWS) -> DataFrame:
    """make(rows, window) over blocks of a series, for frames that reach at most `depth` rows back. Rows have their place as __n."""
    out, w = overlapped(numbered(rows, keys, t), keys, "__n", depth, 0, size)
    return make(out, Window.partitionBy(*keys, BLOCK).orderBy(t)).where(OWN).drop(BLOCK, OWN, "__n")


def ahead(rows: DataFrame, keys: list[str], t: str, horizon: int, make: Callable[[DataFrame, WindowSpec], DataFrame], size: int = TIME) -> DataFrame:
    """make(rows, window) over blocks of a series, for frames that reach at most `horizon` units of time ahead."""
    out, w = overlapped(rows, keys, t, 0, horizon, size)
    return make(out, w).where(OWN).drop(BLOCK, OWN)
