"""Electronic-state logs: populations and frames split by state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.plans.staging import attach


def valid_states(states: DataFrame, n_states: int, trajectory_errors: DataFrame | None = None) -> DataFrame:
    """Drop every run that holds a malformed or out-of-range state, or one of ``trajectory_errors`` (run_id)."""
    s = F.col("state")
    bad = states.where(s.isNull() | (s < 0) | (s > n_states)).select("run_id")
    if trajectory_errors is not None:
        bad = bad.unionByName(trajectory_errors.select("run_id"))
    # One row per bad run; the states of a run are spread over tasks where there are many such runs.
    marked = attach(states, bad.distinct().withColumn("_bad", F.lit(True)), ["run_id"], "left", spread="row_idx")
    return marked.where(F.col("_bad").isNull()).drop("_bad")


def state_population(states: DataFrame, n_states: int, pseudo_count: int = 1) -> DataFrame:
    """Average frames per state 1 .. n over valid runs and the share among those states, in percent.

    Each count starts at ``pseudo_count`` and is divided by the number of valid runs.
    """
    ids = list(range(1, n_states + 1))
    per_run = states.groupBy("run_id").agg(
        *[F.count_if(F.col("state") == s).alias(f"s{s}") for s in ids]
    )
    # One row: n sums and the number of runs.
    total = per_run.agg(F.count(F.lit(1)).alias("runs"), *[F.sum(f"s{s}").alias(f"s{s}") for s in ids])
    rows = F.array(*[
        F.struct(F.lit(s).alias("state"), (F.coalesce(F.col(f"s{s}"), F.lit(0)) + pseudo_count).alias("n")) for s in ids
    ])
    everything = sum(F.coalesce(F.col(f"s{s}"), F.lit(0)) + pseudo_count for s in ids)
    runs = F.greatest(F.col("runs"), F.lit(1))
    return total.select(F.explode(rows).alias("e"), runs.alias("runs"), everything.alias("all")).select(
        "e.state", (F.col("e.n") / F.col("runs")).alias("average"),
        F.when(F.col("all") > 0, F.col("e.n") * 100.0 / F.col("all")).otherwise(0.0).alias("percent"),
    )


def frames_by_state(frames: DataFrame, states: DataFrame) -> DataFrame:
    """Frames with the state of the k-th log row, by position; frames past the log are "unknown"."""
    log = states.select("run_id", F.col("row_idx").alias("frame_id"), F.col("state").cast("string").alias("state"))
    return frames.join(log, ["run_id", "frame_id"], "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
