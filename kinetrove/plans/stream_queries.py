"""Queries over growing trajectories: the given tables come in drops."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrove.operators import residence, topology
from kinetrove.plans import tables as T
from kinetrove.plans.queries import CONNECT, _occ, _round, query
from kinetrove.plans.staging import scratch, stage
from kinetrove.sinks import render
from kinetrove.operators import frames
from kinetrove.sources import frame_index, frame_store
from kinetrove.streaming import moments
from kinetrove.streaming import residence as online

DROPS = 4


def _drop(n: int):
    """The drop of a frame: equal shares of the run, one after another."""
    return F.floor(F.col("frame_id") * DROPS / n).cast("int")


@query
def residence_events_online(spark, sf):
    """Residence events from a stream of occupancy files; the last drop also tells that the run has ended."""
    n = T.read(spark, sf, "embeddings").count()
    occ = _occ(spark, sf).select("run_id", F.col("object_id").cast("long").alias("object_id"), "frame_id", "h")
    ends = occ.select("run_id", "object_id").distinct().select("run_id", "object_id", F.lit(n).cast("long").alias("frame_id"), F.lit(None).cast("int").alias("h"))
    folder, out = scratch(spark, "occupancy-drops"), scratch(spark, "online-events")
    for drop in range(DROPS):
        rows = occ.where(_drop(n) == drop)
        (rows.unionByName(ends) if drop == DROPS - 1 else rows).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(occ.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    events = online.residence_event_stream(stream, tolerance=0, delay=n)
    started = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "online-state")).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(online.EVENTS).parquet(out).where("kind = 'event'").drop("kind")


@query
def residence_events_appended(spark, sf):
    """Residence events of a run that grows drop by drop, with a tolerance; old frames are not read again."""
    n = T.read(spark, sf, "embeddings").count()
    occ, borders, found = _occ(spark, sf), residence.border_states(spark), None
    for drop in range(DROPS):
        final, after = residence.append_events(occ.where(_drop(n) == drop), borders, tolerance=2)
        final, borders = stage(final, "final-events"), stage(after, "border-states")
        found = final if found is None else found.unionByName(final)
    return found.unionByName(residence.open_events(borders))


@query
def frames_by_offset(spark, sf):
    """Every tenth frame of XYZ files, one file a run, read by its place in the file."""
    path = scratch(spark, "run-files")
    text = render.render_xyz(T.traj_runs(spark, sf))
    text.repartition("run_id").sortWithinPartitions("run_id", "frame_id").select("run_id", "text").write.partitionBy("run_id").text(path)
    index = stage(frame_index.index_frames(spark, f"{path}/*/*", run_pattern="run_id=([^/]+)/"), "frame-index")
    atoms = frame_index.read_frames(index, index.where("frame_id % 10 = 3"))
    return _round(atoms, 7, "x", "y", "z")


@query
def stored_frames(spark, sf):
    """A stride over a stored ensemble that was appended to drop by drop; folders without a pick are not read."""
    runs, path = T.traj_runs(spark, sf).drop("vec_id"), scratch(spark, "frame-store")
    for part in range(2):
        frame_store.append(runs.where(F.col("frame_id") % 32 < 16 if part == 0 else F.col("frame_id") % 32 >= 16), path, size=16)
    kept = frame_store.select(spark, path, start=5, stop=10**12, skip=35, size=16)
    return _round(frames.unpack_frames(kept), 6, "x", "y", "z")


@query
def bond_moments_of_drops(spark, sf):
    """Bond statistics from moments that were stored drop by drop."""
    f, path = T.traj_frames(spark, sf), scratch(spark, "bond-moments")
    n = T.read(spark, sf, "embeddings").count()
    bonds = topology.bonds(f, CONNECT)
    for drop in range(DROPS):
        moments.write_drop(f.where(_drop(n) == drop), drop, bonds, "bond", path)
    return _round(moments.statistics(moments.read_moments(spark, path), "bond"), 6, "mean", "variance", "std_dev")
