"""Occupancy of a region, gap filling, residence events, survival and residence times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.functions.constants import MASSES
from kinetrove.operators.rdf import shell_targets
from kinetrove.plans.prefix import CHUNK, explode_range, runs_of

OBJECT_KEY = ["run_id", "object_id"]


def occupancy(
    frames: DataFrame,
    reference: Sequence[int],
    observed: Sequence[Sequence[int]],
    cutoff: float,
    reference_mode: str = "single_atom",
    observed_mode: str = "atom_list_individual",
    masses: str = "residence",
) -> DataFrame:
    """h = 1 where an observed object lies within ``cutoff`` of the moving reference point.

    ``reference_mode``: single_atom, geometric_center or center_of_mass over ``reference`` labels.
    ``observed``: one list of labels per object; object ids are the label itself for single atoms,
    the 1-based group number otherwise. Everything happens inside the frame row.
    """
    if cutoff <= 0:
        raise ValueError("cutoff must be positive")
    pos = F.col("pos")
    if "center_of_mass" == reference_mode or "group_list_com" == observed_mode:
        frames = frames.withColumn("_mass", F.transform("elements", lambda e: G.lookup(MASSES[masses], e)))
    else:
        frames = frames.withColumn("_mass", F.lit(None).cast("array<double>"))

    def weigh(label):
        return G.required(F.element_at("_mass", label), F.element_at("elements", label))

    if reference_mode == "single_atom":
        if len(reference) != 1:
            raise ValueError("single_atom needs exactly one reference label")
        ref = G.atom(pos, reference[0])
    elif reference_mode in ("geometric_center", "center_of_mass"):
        ref = G.weighted_center(pos, list(reference), weigh if reference_mode == "center_of_mass" else None)
    else:
        raise ValueError(f"unknown reference mode {reference_mode!r}")
    singles = observed_mode in ("single_atom", "atom_list_individual")
    if singles:
        labels = F.array(*[F.lit(G.labels(group)[0]) for group in observed])
        rows = frames.select("run_id", "frame_id", "pos", ref.alias("ref"), F.explode(labels).alias("object_id"))
        point = G.atom(pos, F.col("object_id"))
    elif observed_mode in ("group_list_geometric", "group_list_com"):
        groups = F.array(*[F.array(*[F.lit(i) for i in G.labels(group)]) for group in observed])
        rows = frames.select(
            "run_id", "frame_id", "pos", "_mass", "elements", ref.alias("ref"), F.posexplode(groups).alias("_g", "ids")
        ).withColumn("object_id", F.col("_g") + 1)
        point = G.weighted_center(pos, F.col("ids"), weigh if observed_mode == "group_list_com" else None)
    else:
        raise ValueError(f"unknown observed mode {observed_mode!r}")
    placed = rows.select("run_id", "object_id", "frame_id", "ref", point.alias("p"))
    inside = G.distance(F.col("ref"), F.col("p")) <= float(cutoff)
    return placed.select(*OBJECT_KEY, "frame_id", inside.cast("int").alias("h"))


def shell_occupancy(
    frames: DataFrame, center: int, element: str, outer: float, inner: float = 0.0, exclude: Sequence[int] = ()
) -> DataFrame:
    """h of every atom of an element for the shell inner <= d <= outer around an atom."""
    t = shell_targets(frames, center, element, exclude)
    d = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return t.select(
        "run_id", F.col("atom_id").alias("object_id"), "frame_id",
        d.between(float(inner), float(outer)).cast("int").alias("h"),
    )


def fill_gaps(occ: DataFrame, tolerance: int, chunk: int = CHUNK) -> DataFrame:
    """Turn runs of zeros of length <= tolerance with a one on both sides into ones.

    Only ones at most ``tolerance`` frames away matter, so frames are cut into chunks and ones near
    a border are also sent to the neighbouring chunk: one shuffle, no task holds a whole run.
    """
    if tolerance <= 0:
        return occ
    span = max(chunk, 4 * tolerance)
    f, own = F.col("frame_id"), F.expr(f"frame_id div {span}")
    one = F.col("h") == 1
    cells = F.array(
        F.struct(own.alias("c"), F.lit(True).alias("own")),
        F.struct(F.when(one & (f - own * span < tolerance + 1), own - 1).alias("c"), F.lit(False).alias("own")),
        F.struct(F.when(one & ((own + 1) * span - f <= tolerance + 1), own + 1).alias("c"), F.lit(False).alias("own")),
    )
    rows = occ.withColumn("_e", F.explode(cells)).where(F.col("_e.c").isNotNull())
    rows = rows.select(*occ.columns, F.col("_e.c").alias("_c"), F.col("_e.own").alias("_own"))
    base = Window.partitionBy(*OBJECT_KEY, "_c")
    upto = base.orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    down = base.orderBy(F.col("frame_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(one, f)
    gap = F.col("_next") - F.col("_prev") - 1
    filled = F.when((F.col("h") == 0) & (gap <= tolerance), 1).otherwise(F.col("h"))
    return (
        rows.withColumn("_prev", F.max(hit).over(upto))
        .withColumn("_next", F.min(hit).over(down))
        .where("_own")
        .withColumn("h", filled)
        .select(*occ.columns)
    )


def residence_events(occ: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of ones: start_frame and n_frames per event, those cut by the ends included."""
    runs = runs_of(occ.where(F.col("h") == 1), OBJECT_KEY, "frame_id", chunk)
    return runs.select(
        *OBJECT_KEY, F.col("start").alias("start_frame"), (F.col("stop") - F.col("start") + 1).alias("n_frames")
    )


def border_states(spark: SparkSession) -> DataFrame:
    """The empty table of border states that the first frames are appended to."""
    return spark.createDataFrame([], "run_id string, object_id int, next_frame long, start_frame long, stop_frame long")


def append_events(occ: DataFrame, borders: DataFrame, tolerance: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events that are final now, new border states) after further frames of growing runs.

    ``borders``: per (run_id, object_id) the next frame and the event that was still open (NULL if none). Old frames are
    not read again. The new frames of a run must go on at its border; any cut gives the events of the whole run.
    """
    seen = occ.groupBy(*OBJECT_KEY).agg(F.min("frame_id").alias("_from"), (F.max("frame_id") + 1).alias("_to"))
    both = seen.join(borders, OBJECT_KEY, "full")
    gap = F.concat(F.lit("frames do not go on at the border of run "), F.col("run_id"))
    upto = F.when(F.col("_from") != F.coalesce("next_frame", F.lit(0)), F.raise_error(gap).cast("bigint")).otherwise(F.coalesce("_to", "next_frame"))
    both = both.withColumn("_upto", upto)
    found = residence_events(fill_gaps(occ, tolerance)).withColumn("stop_frame", F.col("start_frame") + F.col("n_frames") - 1)
    news = found.select(*OBJECT_KEY, "start_frame", "stop_frame").join(
        both.select(*OBJECT_KEY, "_upto", F.col("start_frame").alias("_open"), F.col("stop_frame").alias("_last")), OBJECT_KEY
    )
    # Events lie further apart than the tolerance, so only the first one can go on an open one.
    goes_on = F.coalesce(F.col("start_frame") - F.col("_last") - 1 <= tolerance, F.lit(False))
    news = news.select(*OBJECT_KEY, "_upto", F.when(goes_on, F.col("_open")).otherwise(F.col("start_frame")).alias("start_frame"), "stop_frame")
    old = both.where("start_frame IS NOT NULL").select(*OBJECT_KEY, "_upto", "start_frame", "stop_frame")
    merged = old.unionByName(news).groupBy(*OBJECT_KEY, "_upto", "start_frame").agg(F.max("stop_frame").alias("stop_frame"))
    still_open = F.col("_upto") - 1 - F.col("stop_frame") <= tolerance
    final = merged.where(~still_open).select(*OBJECT_KEY, "start_frame", (F.col("stop_frame") - F.col("start_frame") + 1).alias("n_frames"))
    after = both.select(*OBJECT_KEY, F.col("_upto").alias("next_frame")).join(merged.where(still_open).drop("_upto"), OBJECT_KEY, "left")
    return final, after


def open_events(borders: DataFrame) -> DataFrame:
    """The events that end with their runs."""
    return borders.where("start_frame IS NOT NULL").select(*OBJECT_KEY, "start_frame", (F.col("stop_frame") - F.col("start_frame") + 1).alias("n_frames"))


def survival(events: DataFrame, dt: float = 1.0) -> DataFrame:
    """S(lag) = fraction of events of at least ``lag`` frames, lag = 0 .. longest.

    Events are counted per duration first. There are at most about sqrt(2 * object-frames) distinct
    durations, the bound on the window below; S is constant between two of them.
    """
    counts = events.groupBy("run_id", "n_frames").agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy("run_id").orderBy("n_frames")
    down = Window.partitionBy("run_id").orderBy(F.col("n_frames").desc())
    whole = Window.partitionBy("run_id")
    steps = counts.select(
        "run_id",
        F.coalesce(F.lag("n_frames").over(up) + 1, F.lit(0).cast("bigint")).alias("low"),
        F.col("n_frames").alias("high"),
        (F.sum("k").over(down.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("k").over(whole)).alias("value"),
    )
    lags = explode_range(steps, "low", "high", "lag")
    return lags.select("run_id", "lag", (F.col("lag") * F.lit(float(dt))).alias("t"), "value")


def shell_totals(occ: DataFrame, dt: float = 1.0, sampling: int = 1) -> DataFrame:
    """Occupied objects per frame; the first frame counts as number 1 on the time axis."""
    return (
        occ.groupBy("run_id", "frame_id")
        .agg(F.sum("h").alias("coordination"))
        .select("run_id", "frame_id", G.time_ps(F.col("frame_id"), dt, sampling, 1).alias("time_ps"), "coordination")
    )


def shell_residence(occ: DataFrame, dt: float = 1.0, sampling: int = 1) -> DataFrame:
    """Per object that ever enters: frames inside, entries from outside, total and mean residence time.

    Both counts follow from the residence events: an entry is an event that does not start with the
    trajectory. ``first_order`` numbers the objects by first occupied frame, then by label.
    """
    events = residence_events(occ)
    per = events.groupBy(*OBJECT_KEY).agg(
        F.sum("n_frames").alias("rt_frames"),
        F.sum((F.col("start_frame") > 0).cast("bigint")).alias("exchanges"),
        F.min("start_frame").alias("first_frame"),
    )
    step = dt * sampling * G.ATOMIC_TIME_FS / 1000.0
    total = F.col("rt_frames") * F.lit(step)
    # One row per object: bounded by the atoms of a frame.
    order = Window.partitionBy("run_id").orderBy("first_frame", "object_id")
    return per.select(
        *OBJECT_KEY, "rt_frames", "exchanges", total.alias("total_rt"),
        F.when(F.col("exchanges") > 0, total / F.col("exchanges")).otherwise(total).alias("mrt"),
        F.row_number().over(order).alias("first_order"),
    )
