"""Ordered computations over one very long key.

A window partitioned by run puts the whole run into one task. The helpers here cut the order axis
into fixed chunks, work inside ``(keys, chunk)`` and carry only one summary row per chunk upwards,
twice. The largest task sees ``CHUNK`` rows on the first two levels and ``1 / CHUNK**2`` of the key
on the last (a trillion frames leave some 60,000 rows there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def _carry(summary: DataFrame, keys: list[str], names: dict[str, str], chunk: int, levels: int) -> DataFrame:
    """Exclusive running merge over chunk summaries: what came before each chunk."""
    if levels == 0:
        w = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        return summary.select(*keys, "_c", *[_MERGE[k](n).over(w).alias(f"_{n}") for n, k in names.items()])
    up = F.expr(f"_c div {chunk}")
    local = Window.partitionBy(*keys, "_p").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    inside = summary.withColumn("_p", up).select(
        *keys, "_c", "_p", *[_MERGE[k](n).over(local).alias(f"_in_{n}") for n, k in names.items()]
    )
    above = (
        summary.withColumn("_p", up)
        .groupBy(*keys, "_p")
        .agg(*[_MERGE[k](n).alias(n) for n, k in names.items()])
        .withColumnRenamed("_p", "_c")
    )
    before = _carry(above, keys, names, chunk, levels - 1).withColumnRenamed("_c", "_p")
    joined = inside.join(before, [*keys, "_p"])
    return joined.select(
        *keys, "_c", *[_combine(k, F.col(f"_{n}"), F.col(f"_in_{n}")).alias(f"_{n}") for n, k in names.items()]
    )


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(left + right)
    return (F.greatest if kind == "max" else F.least)(left, right)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add inclusive running values ``{name: (sum|max|min, expression)}`` along integer ``order``.

    Rows of one ``(keys, order div chunk)`` cell form the unit of work, so ``order`` should be a
    dense number (a frame, a line, an identifier), unique within the keys.
    """
    kinds = {name: kind for name, (kind, _) in specs.items()}
    base = df.withColumns({f"_v_{n}": e for n, (_, e) in specs.items()}).withColumn(
        "_c", F.expr(f"{order} div {chunk}")
    )
    w = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({f"_l_{n}": _MERGE[k](f"_v_{n}").over(w) for n, k in kinds.items()})
    summary = base.groupBy(*keys, "_c").agg(*[_MERGE[k](f"_v_{n}").alias(n) for n, k in kinds.items()])
    before = _carry(summary, keys, kinds, chunk, levels=1)
    out = local.join(before, [*keys, "_c"])
    return out.select(
        *df.columns, *[_combine(k, F.col(f"_{n}"), F.col(f"_l_{n}")).alias(n) for n, k in kinds.items()]
    )


def ordinal(df: DataFrame, keys: list[str], order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """0-based position of each row within its keys, along a unique integer ``order``."""
    counted = running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, chunk)
    return counted.withColumn(name, F.col(name) - 1)


def _merge_touching(segments: DataFrame, keys: list[str], part: list[str]) -> DataFrame:
    """Join segments that touch (next start = previous end + 1) inside each ``keys + part`` cell."""
    w = Window.partitionBy(*keys, *part).orderBy("start")
    opens = (F.col("start") != F.lag("stop").over(w) + 1).cast("int")
    marked = segments.withColumn("_open", F.coalesce(opens, F.lit(1)))
    grouped = marked.withColumn("_g", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, *part, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def runs_of(points: DataFrame, keys: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of consecutive integers: one row ``(keys, start, stop)`` per run, both ends included.

    Runs are found inside chunks. Only those that touch a chunk border go on to the next, coarser
    level, at most two per chunk; the others are final.
    """
    level = points.select(*keys, F.col(order).alias("start"), F.col(order).alias("stop"))
    done = []
    for span in (chunk, chunk * chunk):
        cell = F.expr(f"start div {span}L")
        merged = _merge_touching(level.withColumn("_c", cell), keys, ["_c"])
        # Null-safe, so that no "is not null" is derived and pushed below the shuffle in one branch
        # only: the branches then share one exchange.
        first, last = F.col("_c") * span, (F.col("_c") + 1) * span - 1
        at_border = F.col("start").eqNullSafe(first) | F.col("stop").eqNullSafe(last)
        done.append(merged.where(~at_border).select(*keys, "start", "stop"))
        level = merged.where(at_border).select(*keys, "start", "stop")
    runs = _merge_touching(level, keys, []).select(*keys, "start", "stop")
    for part in done:
        runs = runs.unionByName(part)
    return runs


def explode_range(df: DataFrame, low: str, high: str, name: str, block: int = CHUNK) -> DataFrame:
    """One row per integer in [low, high], expanded in blocks so that no long array is ever built."""
    blocks = df.where(F.col(low) <= F.col(high)).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({high} - {low}) div {block}")))
    )
    first = F.col(low) + F.col("_b") * block
    last = F.least(F.col(high), first + (block - 1))
    return blocks.withColumn(name, F.explode(F.sequence(first, last))).drop("_b")
