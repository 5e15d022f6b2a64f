"""Column expressions over 3-vectors held as STRUCT<x,y,z>.

Everything here is a plain built-in expression, so it stays inside whole-stage code generation.
Degenerate geometry yields NULL, never an exception (ANSI division is guarded by ``when``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.functions.constants import ATOMIC_TIME_FS

AXES = ("x", "y", "z")
#: groups up to this size are unrolled into a flat expression; longer ones use a lambda
UNROLL_LIMIT = 64


def vec(x, y, z) -> Column:
    return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))


def atom(pos: Column, label) -> Column:
    """Position of a 1-based atom label. A label beyond the frame is an error (ANSI index check)."""
    if isinstance(label, int):
        if label < 1:
            raise ValueError("atom labels start at 1")
        return pos.getItem(label - 1)
    return F.element_at(pos, label)


def sub(a, b) -> tuple[Column, Column, Column]:
    return tuple(a[c] - b[c] for c in AXES)


def dot(u, v) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u, v) -> tuple[Column, Column, Column]:
    return (
        u[1] * v[2] - u[2] * v[1],
        u[2] * v[0] - u[0] * v[2],
        u[0] * v[1] - u[1] * v[0],
    )


def min_image(delta: Column, length) -> Column:
    """Orthorhombic minimum image of one component; halves round to even, a cell length <= 0 is open."""
    if isinstance(length, (int, float)):
        return delta - F.lit(float(length)) * F.rint(delta / F.lit(float(length))) if length > 0 else delta
    return F.when(length > 0, delta - length * F.rint(delta / length)).otherwise(delta)


def displacement(a: Column, b: Column, cell: Sequence[float] | None = None):
    d = sub(a, b)
    return d if cell is None else tuple(min_image(x, length) for x, length in zip(d, cell))


def distance(a: Column, b: Column, cell: Sequence[float] | None = None) -> Column:
    d = displacement(b, a, cell)
    return F.sqrt(dot(d, d))


def _acos_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def _named(df: DataFrame, vectors: dict[str, tuple]) -> DataFrame:
    return df.withColumns({f"_{v}{n}": part for v, parts in vectors.items() for n, part in enumerate(parts)})


def _read(name: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"_{name}{n}") for n in range(3))


def _tidy(df: DataFrame, keep: list[str], out: str) -> DataFrame:
    return df.select(*keep, out)


def _points(df: DataFrame, **points: Column) -> DataFrame:
    """Name the coordinates of each point. A missing one becomes NaN, so the arithmetic that follows
    carries no NULL checks and stays small enough for the JIT compiler."""
    nan = F.lit(float("nan"))
    return _named(df, {name: tuple(F.coalesce(p[c], nan) for c in AXES) for name, p in points.items()})


def _minus(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """Name the vectors ``to - from`` between named points."""
    return _named(df, {
        v: tuple(p - q for p, q in zip(_read(head), _read(tail))) for v, (head, tail) in pairs.items()
    })


def _known(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def add_distance(df: DataFrame, a: Column, b: Column, out: str = "value", cell=None) -> DataFrame:
    """Add the distance a-b; the three differences are named first and squared by name."""
    t = _minus(_points(df, a=a, b=b), d=("b", "a"))
    if cell is not None:
        t = _named(t, {"d": tuple(min_image(x, length) for x, length in zip(_read("d"), cell))})
    t = t.withColumn("_r", F.sqrt(dot(_read("d"), _read("d"))))
    return _tidy(t.withColumn(out, _known(F.col("_r"))), df.columns, out)


def add_angle(df: DataFrame, a: Column, b: Column, c: Column, out: str = "value") -> DataFrame:
    """Add the angle a-b-c in degrees, b the vertex; NULL when two of the points coincide.

    Each step is a projection of its own, so no expression repeats a bigger one.
    """
    t = _minus(_points(df, a=a, b=b, c=c), u=("a", "b"), v=("c", "b"))
    u, v = _read("u"), _read("v")
    t = t.withColumns({"_n": F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)), "_c": dot(u, v)})
    usable = (F.col("_n") != 0.0) & ~F.isnan("_n")
    t = t.withColumn(out, F.when(usable, _acos_degrees(F.col("_c") / F.col("_n"))))
    return _tidy(t, df.columns, out)


def add_dihedral(
    df: DataFrame, a: Column, b: Column, c: Column, d: Column, out: str = "value", convention: str = "trajectory"
) -> DataFrame:
    """Add the torsion a-b-c-d in (-180, 180]; "iupac" has the opposite sign. Collinear atoms give NULL."""
    if convention not in ("trajectory", "iupac"):
        raise ValueError(f"unknown dihedral convention {convention!r}")
    t = _minus(_points(df, a=a, b=b, c=c, d=d), ab=("b", "a"), bc=("c", "b"), cd=("d", "c"))
    t = _named(t, {"m": cross(_read("ab"), _read("bc")), "n": cross(_read("bc"), _read("cd"))})
    m, n, bc = _read("m"), _read("n"), _read("bc")
    # The lengths of the two normals are a common factor of sine and cosine and drop out of atan2.
    t = t.withColumns({
        "_sin": dot(cross(m, bc), n),
        "_cos": dot(m, n) * F.sqrt(dot(bc, bc)),
        "_ok": (dot(m, m) != 0.0) & (dot(n, n) != 0.0) & (dot(bc, bc) != 0.0),
    })
    t = t.withColumn("_angle", F.degrees(F.atan2("_sin", "_cos")))
    value, usable = F.col("_angle"), F.col("_ok") & ~F.isnan("_angle")
    if convention == "iupac":
        value = F.when(value == 180.0, value).otherwise(-value)
    return _tidy(t.withColumn(out, F.when(usable, value)), df.columns, out)


def wrap_360(degrees: Column) -> Column:
    return F.when(degrees < 0.0, degrees + 360.0).otherwise(degrees)


def time_ps(frame_id: Column, dt: float, sampling: int, origin: int = 0) -> Column:
    """Simulation time in ps; ``dt`` in atomic units, ``origin`` is the number given to the first frame."""
    return (frame_id + F.lit(origin)) * F.lit(dt * sampling * ATOMIC_TIME_FS / 1000.0)


def lookup(table: dict[str, float], key: Column, default: float | None = None) -> Column:
    """Value of a fixed per-element table. An unknown element gives ``default`` or NULL."""
    entries = F.expr("map(" + ", ".join(f"'{k}', {v!r}D" for k, v in table.items()) + ")")
    value = F.try_element_at(entries, key)
    return value if default is None else F.coalesce(value, F.lit(default))


def required(value: Column, key: Column) -> Column:
    """A looked-up value, or an error that names the element it is missing for."""
    message = F.concat(F.lit("unknown element "), F.coalesce(key, F.lit("NULL")))
    return F.coalesce(value, F.raise_error(message).cast("double"))


def labels(ids: Sequence[int]) -> list[int]:
    """1-based atom labels of a group; anything else is refused before a plan is built."""
    found = [int(i) for i in ids]
    if not found:
        raise ValueError("a group needs at least one atom label")
    if min(found) < 1:
        raise ValueError("atom labels start at 1")
    return found


def weighted_center(pos: Column, ids, weight=None, fields: Sequence[str] = AXES) -> Column:
    """Weighted mean of ``fields`` over the atoms ``ids`` (a Python list or an ARRAY<INT> column).

    ``weight`` maps a label to a Column; None means equal weights. A zero total weight falls back
    to the plain mean.
    """
    if isinstance(ids, (list, tuple)):
        ids = labels(ids)
    if isinstance(ids, list) and len(ids) <= UNROLL_LIMIT:
        points = [atom(pos, i) for i in ids]
        plain = [reduce(Column.__add__, [p[f] for p in points]) / F.lit(float(len(points))) for f in fields]
        if weight is None:
            return F.struct(*[c.alias(f) for c, f in zip(plain, fields)])
        weights = [weight(F.lit(i)) for i in ids]
        total = reduce(Column.__add__, weights)
        sums = [reduce(Column.__add__, [w * p[f] for w, p in zip(weights, points)]) for f in fields]
        return F.struct(*[
            F.when(total > 0.0, s / total).otherwise(c).alias(f) for s, c, f in zip(sums, plain, fields)
        ])
    ids = F.array(*[F.lit(i) for i in ids]) if isinstance(ids, list) else ids
    count = F.size(ids).cast("double")

    def total_of(value):
        return F.aggregate(ids, F.lit(0.0), lambda acc, i: acc + value(i))

    if weight is None:
        return F.struct(*[(total_of(lambda i, f=f: F.element_at(pos, i)[f]) / count).alias(f) for f in fields])
    total = total_of(weight)
    return F.struct(*[
        F.when(total > 0.0, total_of(lambda i, f=f: weight(i) * F.element_at(pos, i)[f]) / total)
        .otherwise(total_of(lambda i, f=f: F.element_at(pos, i)[f]) / count)
        .alias(f)
        for f in fields
    ])
