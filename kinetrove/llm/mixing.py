"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Sources in code-point order (null last) get the weights in turn. Together they are to give ``share`` times all words;
no source gives more than ``cap`` times its own, and what one cannot give the others take over by weight. Within a
source every document is expected ``target / source_size`` times. Documents are put in the order of their size, so
that all sizes are drawn alike, the expected copies are summed up along that order from one random offset, and a
document is taken once for every whole number that its own share crosses. Sources of more than ``STRATUM`` rows are
cut into strata of about that many by a hash of the doc_id, each in the order of size, one after another: neighbouring
rows then weigh about the same however large the source is, and no task gets the longest documents of all.

The running sum is ``rate x rank``, so only ranks within the source are needed: rows are dealt by ranges of (source,
size, doc_id, hash), which splits a source of any size, are written once with their place, and one small row per
task and source carries the counts on. The offset comes from the source's name, the order from the rows: reruns and
other numbers of partitions give the same mix.

A null text has size 0; sources with no words get target 0 and no copy. A null source is a source of its own. Rows
that are equal are sampled one by one. An empty table gives no rows. Other columns, whatever their names, go along.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrove.llm.common import stage

#: Rows of a source that are put in the order of their size together.
STRATUM = 16384
#: Offsets are multiples of 2**-OFFSET_BITS, so that sums of whole rates stay exact.
OFFSET_BITS = 20


def targets(totals: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Sources that reach their cap are those with the smallest cap per weight. With the first k of them full, the
    rest is shared at level_k = (total - their caps) / other weights, which grows with k as long as the next one is
    full too and falls afterwards: the level that holds is the largest.
    """
    everything = Window.partitionBy()  # one row per source, not per document
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = (
        totals.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("_most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_order", F.row_number().over(Window.orderBy(F.col("_most") / F.col("_weight"), F.col("source").asc_nulls_last())))
    )
    before = Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    return (
        listed.withColumn("_level", level)
        .withColumn("target", F.least("_most", F.max("_level").over(everything) * F.col("_weight")))
        .drop("_weight", "_most", "_order", "_level")
    )


def mix(docs: DataFrame, size: Callable[[Column], Column], *, seed: str = "mix", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc STRUCT of all columns, size, source_size, target, copies, taken), one row per row of ``docs``.

    ``size`` gives the words of a document from that struct.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"))
    # Large sources only, at most one for STRATUM rows; written, so that its size is known when the join is planned.
    large = keyed.groupBy("_none", "_source").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= STRATUM)
    large = stage(large.select("_none", "_source", F.floor(F.col("_rows") / STRATUM).alias("_cuts")), "mix-large")
    digits = F.substring(F.md5(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8)
    stratum = F.conv(digits, 16, 10).cast("long") % (F.coalesce("_cuts", F.lit(0)) + 1)
    columns = [F.col("doc").getField(c) for c in docs.columns]
    rows = keyed.join(large, ["_none", "_source"], "left").select(
        "doc", size(F.col("doc")).cast("long").alias("size"), "_none", "_source", stratum.alias("_stratum"), F.col("doc.doc_id").alias("_id"), F.xxhash64(*columns).alias("_tie"),
    )
    order = ["_none", "_source", "_stratum", "size", F.col("_id").asc_nulls_last(), "_tie"]
    placed = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "size", "_none", "_source", F.monotonically_increasing_id().alias("_at")),
        "mix-order",
    )
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")
    placed = placed.select("doc", "size", "_none", "_source", part, place)
    runs = placed.groupBy("_none", "_source", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("_size"))
    runs = stage(runs, "mix-runs")
    totals = runs.groupBy("_none", "_source").agg(F.sum("_size").alias("source_size")).withColumn("source", F.when(~F.col("_none"), F.col("_source")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_source")).cast("binary")), 1, OFFSET_BITS // 4), 16, 10).cast("double") / (1 << OFFSET_BITS)
    rates = targets(totals, weights=weights, share=share, cap=cap).select(
        "_none", "_source", "source_size", "target", offset.alias("_offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"),
    )
    earlier = Window.partitionBy("_none", "_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known when the join is planned: one row per task and source.
    plan = stage(
        runs.select("_none", "_source", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")).join(rates, ["_none", "_source"]),
        "mix-plan",
    )
    rank = F.col("_place") + F.col("_shift")  # ranks before this row
    copies = F.floor(F.col("_rate") * (rank + 1) + F.col("_offset")) - F.floor(F.col("_rate") * rank + F.col("_offset"))
    return placed.join(plan, ["_none", "_source", "_part"]).select(
        "doc", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
