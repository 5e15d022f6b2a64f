"""Centres, radii, kinetic energies, aimed velocities and box measures of many snapshots.

Groups of atoms are lists of labels; all work happens inside the frame row, so nothing is shuffled.
``group_centers`` also takes long atoms with a membership table ``groups(group_id, atom_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.functions import constants as K
from kinetrove.functions import geometry as G
from kinetrove.operators.frames import FRAME_KEY
from kinetrove.plans.staging import BROADCAST_BYTES, stage, stored_bytes

Groups = Sequence[Sequence[int]]


def _weighed(frames: DataFrame, masses: str) -> DataFrame:
    """Add ``_mass``, the mass of every atom of the frame, looked up once; NULL for unknown elements."""
    return frames.withColumn("_mass", F.transform("elements", lambda e: G.lookup(K.MASSES[masses], e)))


def _weight(label) -> Column:
    """Mass of an atom; an unknown element is an error as soon as its mass is needed."""
    return G.required(F.element_at("_mass", label), F.element_at("elements", label))


def group_centers(df: DataFrame, groups: Groups | DataFrame, masses: str | None = None) -> DataFrame:
    """Mean position (``masses=None``) or centre of mass per frame and group: group_id, x, y, z."""
    if isinstance(groups, DataFrame):
        return _long_centers(df, groups, masses)
    df = _weighed(df, masses) if masses else df
    centers = F.array(*[G.weighted_center(F.col("pos"), list(g), _weight if masses else None) for g in groups])
    rows = df.select(*FRAME_KEY, F.posexplode(centers).alias("_g", "_c"))
    return rows.select(*FRAME_KEY, (F.col("_g") + 1).alias("group_id"), *[F.col("_c")[c].alias(c) for c in G.AXES])


def _long_centers(atoms: DataFrame, groups: DataFrame, masses: str | None) -> DataFrame:
    groups = stage(groups)
    if stored_bytes(groups) <= BROADCAST_BYTES:
        groups = F.broadcast(groups)
    m = G.required(G.lookup(K.MASSES[masses], F.col("element")), F.col("element")) if masses else F.lit(1.0)
    members = atoms.join(groups, ["atom_id"]).withColumn("_m", m)
    sums = members.groupBy(*FRAME_KEY, "group_id").agg(
        F.sum("_m").alias("_m"),
        *[F.sum(F.col("_m") * F.col(c)).alias(f"_{c}") for c in G.AXES],
        *[F.avg(c).alias(f"_a{c}") for c in G.AXES],
    )
    return sums.select(
        *FRAME_KEY, "group_id",
        *[F.when(F.col("_m") > 0, F.col(f"_{c}") / F.col("_m")).otherwise(F.col(f"_a{c}")).alias(c) for c in G.AXES],
    )


def geometric_center(df: DataFrame, groups: Groups | DataFrame) -> DataFrame:
    return group_centers(df, groups)


def center_of_mass(df: DataFrame, groups: Groups | DataFrame, masses: str = "general") -> DataFrame:
    return group_centers(df, groups, masses)


def bounding_radius(
    frames: DataFrame, groups: Groups, radii: dict[str, float] | None = None, masses: str = "general"
) -> DataFrame:
    """Largest distance of a group's atoms from its centre of mass, plus the atom's radius if given."""
    pos = F.col("pos")
    entries = F.array(*[
        F.struct(F.array(*[F.lit(i) for i in G.labels(g)]).alias("ids"), G.weighted_center(pos, list(g), _weight).alias("c"))
        for g in groups
    ])
    rows = _weighed(frames, masses).select(*FRAME_KEY, "pos", "elements", F.posexplode(entries).alias("_g", "_e"))

    def reach(i):
        d = G.distance(F.col("_e")["c"], F.element_at(pos, i))
        if radii is None:
            return d
        return d + G.lookup(radii, F.element_at(F.col("elements"), i), K.DEFAULT_VDW_RADIUS)

    return rows.select(
        *FRAME_KEY, (F.col("_g") + 1).alias("group_id"),
        F.array_max(F.transform(F.col("_e")["ids"], reach)).alias("radius"),
    )


def _molar_kj(mass_kg: Column, v2_au: Column) -> Column:
    speed2 = v2_au * F.lit(K.AU_VELOCITY_M_PER_S**2)
    return F.lit(0.5) * mass_kg * speed2 / 1000.0


def atom_kinetic_energy(frames: DataFrame, group: Sequence[int], masses: str = "general") -> DataFrame:
    """Kinetic energy of every atom of a group; velocities in atomic units."""
    ids = F.array(*[F.lit(i) for i in G.labels(group)])
    rows = frames.select(*FRAME_KEY, "pos", "elements", F.explode(ids).alias("atom_id")).select(
        *FRAME_KEY, "atom_id", F.element_at("elements", F.col("atom_id")).alias("element"),
        F.element_at("pos", F.col("atom_id")).alias("p"),
    )
    v = [F.col("p")[f"v{c}"] for c in G.AXES]
    mass = G.required(G.lookup(K.MASSES[masses], F.col("element")), F.col("element"))
    kj = _molar_kj(mass / 1000.0, G.dot(v, v))
    return rows.select(*FRAME_KEY, "atom_id", "element", kj.alias("kj_mol")).withColumn(
        "kcal_mol", F.col("kj_mol") * K.KJ_TO_KCAL
    )


def kinetic_energy(frames: DataFrame, group: Sequence[int], masses: str = "general") -> DataFrame:
    """Molar mass of a group and the kinetic energy of its centre of mass."""
    kg = reduce(Column.__add__, [_weight(F.lit(i)) for i in G.labels(group)]) / 1000.0
    com = _weighed(frames, masses).select(
        *FRAME_KEY, kg.alias("molar_mass_kg"),
        G.weighted_center(F.col("pos"), list(group), _weight, ("vx", "vy", "vz")).alias("v"),
    )
    v = [F.col("v")[c] for c in ("vx", "vy", "vz")]
    return com.select(*FRAME_KEY, "molar_mass_kg", _molar_kj(F.col("molar_mass_kg"), G.dot(v, v)).alias("kj_mol")).withColumn(
        "kcal_mol", F.col("kj_mol") * K.KJ_TO_KCAL
    )


def aim_velocity(
    frames: DataFrame,
    group: Sequence[int],
    target: Sequence[float],
    v0: float,
    keep_internal: bool = True,
    zero_others: bool = False,
    masses: str = "general",
) -> DataFrame:
    """Send a group's centre of mass towards ``target`` at speed ``v0`` in every snapshot.

    Group atoms keep their motion relative to the centre of mass, or move as one body without
    ``keep_internal``; other atoms keep their velocity or stop. Returns long atoms. A centre of mass
    that already lies on the target gives NULL velocities.
    """
    fields = ("x", "y", "z", "vx", "vy", "vz")
    com = _weighed(frames, masses).select(
        *FRAME_KEY, "elements", "pos", G.weighted_center(F.col("pos"), list(group), _weight, fields).alias("m")
    )
    d = [F.lit(float(t)) - F.col("m")[c] for t, c in zip(target, G.AXES)]
    length = F.sqrt(G.dot(d, d))
    push = [F.when(length > 0, x / length * F.lit(float(v0))).alias(f"u{c}") for x, c in zip(d, G.AXES)]
    rows = com.select(*FRAME_KEY, "elements", "m", *push, F.posexplode("pos").alias("_i", "p"))
    mine = (F.col("_i") + 1).isin(list(group))

    def speed(c):
        old = F.col("p")[f"v{c}"]
        own = old - F.col("m")[f"v{c}"] + F.col(f"u{c}") if keep_internal else F.col(f"u{c}")
        return F.when(mine, own).otherwise(F.lit(0.0) if zero_others else old).alias(f"v{c}")

    return rows.select(
        *FRAME_KEY, (F.col("_i") + 1).alias("atom_id"), F.col("elements")[F.col("_i")].alias("element"),
        *[F.col("p")[c].alias(c) for c in G.AXES], *[speed(c) for c in G.AXES],
    )


def inside_box(
    frames: DataFrame,
    groups: Groups,
    cell: Sequence[float],
    padding: float = 0.0,
    slab: tuple[float, float] | None = None,
) -> DataFrame:
    """True where every atom of a group keeps ``padding`` from the walls.

    ``slab=(z_min, z_max)`` limits z; its faces inside the cell are not padded.
    """
    pad = max(0.0, float(padding)) if slab is None else float(padding)
    low, high = [pad] * 3, [float(length) - pad for length in cell]
    if slab is not None:
        low[2] = slab[0] + (pad if slab[0] == 0.0 else 0.0)
        high[2] = slab[1] - (pad if slab[1] == float(cell[2]) else 0.0)
    ids = F.array(*[F.array(*[F.lit(i) for i in G.labels(g)]) for g in groups])
    rows = frames.select(*FRAME_KEY, "pos", F.posexplode(ids).alias("_g", "ids"))

    def fits(i):
        p = F.element_at(F.col("pos"), i)
        return reduce(Column.__and__, [p[c].between(lo, hi) for c, lo, hi in zip(G.AXES, low, high)])

    return rows.select(*FRAME_KEY, (F.col("_g") + 1).alias("group_id"), F.forall("ids", fits).alias("inside"))


def density(
    frames: DataFrame, cell: Sequence[float], masses: str = "general", slab: tuple[float, float] | None = None
) -> DataFrame:
    """Mass density in g/cm^3 of every frame, or of the atoms and volume of one z slab."""
    a, b, c = (float(v) for v in cell)
    height = c if slab is None else slab[1] - slab[0]
    volume = a * b * height * 1e-24
    rows = _weighed(frames, masses).select(*FRAME_KEY, F.arrays_zip("_mass", "pos", "elements").alias("_z"))
    kept = F.col("_z") if slab is None else F.filter("_z", lambda e: e["pos"]["z"].between(*map(float, slab)))
    mass = F.aggregate(kept, F.lit(0.0), lambda acc, e: acc + G.required(e["_mass"], e["elements"]))
    grams = F.col("mass") * F.lit(K.AMU_GRAMS)
    return rows.select(*FRAME_KEY, mass.alias("mass")).withColumn(
        "density", grams / F.lit(volume) if volume > 0 else F.lit(0.0)
    )


def target_molecules(specs: DataFrame, rounding: str = "floor") -> DataFrame:
    """Molecules needed to reach a density: columns a, b, c, density, solute_mass, molecule_mass.

    ``rounding``: "floor" for one solvent, "round" (half to even) for a mixture's mean mass.
    """
    grams = F.col("density") * (F.col("a") * F.col("b") * F.col("c") * F.lit(1e-24))
    free = grams / F.lit(K.AMU_GRAMS) - F.col("solute_mass")
    count = F.when(F.col("molecule_mass") > 0, free / F.col("molecule_mass"))
    whole = {"floor": F.floor, "round": F.rint}[rounding](count)
    return specs.withColumn("n_molecules", F.greatest(F.lit(0).cast("bigint"), whole.cast("bigint")))


def force_magnitude(atoms: DataFrame, cols: Sequence[str] = ("fx", "fy", "fz")) -> DataFrame:
    """Euclidean norm of three force columns."""
    x, y, z = (F.col(c) for c in cols)
    return atoms.withColumn("force", F.hypot(F.hypot(x, y), z))
