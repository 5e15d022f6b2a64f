"""Phase-space trajectories, plane-wave output, snapshots, state logs and energy logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.functions import constants as K
from kinetrove.functions.text import number, symbol, tokens, word
from kinetrove.plans.prefix import ordinal
from kinetrove.plans.staging import attach, stage
from kinetrove.sources.lines import RUN_BY_FOLDER, number_lines


def _required(value, what: str):
    """The value, or an error naming the line when it is missing."""
    message = F.concat(F.lit(f"{what} at line "), (F.col("line_no") + 1).cast("string"))
    return F.coalesce(value, F.raise_error(message).cast("double"))


def _strided(lines: DataFrame, sizes: DataFrame | int, titles: int) -> DataFrame:
    """Complete frames of ``titles`` + n_atoms lines; ``sizes``: n_atoms of all runs, or (run_id, n_atoms)."""
    if isinstance(sizes, int):
        sized = lines.withColumn("n_atoms", F.lit(sizes).cast("bigint"))
    else:
        sized = attach(lines, sizes.select("run_id", F.col("n_atoms").cast("bigint").alias("n_atoms")), ["run_id"], "left", spread="line_no")
        unknown = F.raise_error(F.concat(F.lit("no symbols or size for run "), F.col("run_id"))).cast("bigint")
        sized = sized.withColumn("n_atoms", F.coalesce("n_atoms", unknown))
    step = F.col("n_atoms") + titles
    return sized.where(F.col("line_no") < F.floor(F.col("n_lines") / step) * step).select(
        "run_id", "line_no", F.floor(F.col("line_no") / step).alias("frame_id"),
        (F.col("line_no") % step - titles + 1).cast("int").alias("atom_id"), tokens(F.col("value")).alias("w"),
    ).where(F.col("atom_id") >= 1)


def _by_run(symbols: DataFrame) -> bool:
    return "run_id" in symbols.columns


def _sizes(symbols: DataFrame) -> DataFrame | int:
    """Atoms per run; without run_id one count that holds for all."""
    if _by_run(symbols):
        return symbols.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    return symbols.count()


def _labelled(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Elements by atom, of the run's own symbols where they have a run_id; an atom without one is an error."""
    key = ["run_id", "atom_id"] if _by_run(symbols) else ["atom_id"]
    what = F.concat(F.lit("no symbol for atom "), F.col("atom_id").cast("string"), F.lit(" of run "), F.col("run_id"))
    found = attach(rows, symbols.select(*key, "element"), key, "left")
    return found.withColumn("element", F.coalesce("element", F.raise_error(what).cast("string")))


def parse_phase_space(lines: DataFrame, symbols: DataFrame, to_angstrom: bool = False) -> DataFrame:
    """Headerless ``idx x y z vx vy vz`` lines; a frame is as many lines as ``symbols`` ([run_id,] atom_id, element) has.

    A last, incomplete frame is left out. ``to_angstrom`` converts positions from bohr.
    """
    rows = _strided(lines, _sizes(symbols), 0)
    scale = K.BOHR_ANGSTROM_PHASE_SPACE if to_angstrom else 1.0
    values = [_required(number(word(F.col("w"), k)), "invalid line format") for k in range(1, 7)]
    placed = [(v * scale if n < 3 else v).alias(c) for n, (v, c) in enumerate(zip(values, ("x", "y", "z", "vx", "vy", "vz")))]
    return _labelled(rows, symbols).select("run_id", "frame_id", "atom_id", "element", *placed)


def read_phase_space(spark: SparkSession, path, symbols: DataFrame, to_angstrom: bool = False, run_pattern: str | None = None) -> DataFrame:
    return parse_phase_space(number_lines(spark, path, run_pattern), symbols, to_angstrom)


def phase_space_errors(lines: DataFrame, n_atoms: DataFrame | int) -> DataFrame:
    """Frames whose lines do not share one numeric first word: run_id, frame_id (from 1), error."""
    rows = _strided(lines, n_atoms, 0).withColumn("idx", word(F.col("w"), 0))
    per = rows.groupBy("run_id", "frame_id").agg(
        F.count_if(~F.col("idx").rlike("^[0-9]+$") | F.col("idx").isNull()).alias("bad"),
        (F.min("idx") != F.max("idx")).alias("mixed"),
    )
    error = F.when(F.col("bad") > 0, "first word is not a number").when(F.col("mixed"), "frame number changes inside the frame")
    return per.select("run_id", (F.col("frame_id") + 1).alias("frame_id"), error.alias("error")).where(F.col("error").isNotNull())


def validate_phase_space(spark: SparkSession, path, n_atoms: DataFrame | int, run_pattern: str | None = None) -> DataFrame:
    return phase_space_errors(number_lines(spark, path, run_pattern), n_atoms)


def parse_cp_labels(lines: DataFrame) -> DataFrame:
    """Atom labels of plane-wave input decks, one deck per run: the ``nat`` lines after ATOMIC_POSITIONS."""
    lines = lines.withColumn("w", tokens(F.col("value")))
    nat = F.when(F.array_contains("w", "nat"), F.regexp_replace(word(F.col("w"), 2), ",", "").try_cast("int"))
    start = F.when(F.array_contains("w", "ATOMIC_POSITIONS"), F.col("line_no"))
    where = lines.groupBy("run_id").agg(F.max(nat).alias("nat"), F.min(start).alias("start"))
    at = (F.col("line_no") - F.col("start")).cast("int")
    return attach(lines, where, ["run_id"], spread="line_no").where(at.between(F.lit(1), F.col("nat"))).select(
        "run_id", at.alias("atom_id"), word(F.col("w"), 0).alias("element")
    )


def read_cp_labels(spark: SparkSession, path, run_pattern: str | None = None) -> DataFrame:
    """Labels by run where ``run_pattern`` names runs; otherwise of one deck that holds for all of them."""
    labels = parse_cp_labels(number_lines(spark, path, run_pattern))
    if run_pattern is not None:
        return labels
    unlike = F.raise_error(F.lit("decks with different labels need run names")).cast("string")
    one = F.when(F.min("element") == F.max("element"), F.min("element")).otherwise(unlike)
    return labels.groupBy("atom_id").agg(one.alias("element"))


def parse_cp_frames(lines: DataFrame, labels: DataFrame, kind: str = "pos") -> DataFrame:
    """Title line and ``x y z`` lines per frame: positions in angstrom ("pos") or force magnitudes ("for").

    ``labels``: ([run_id,] atom_id, element).
    """
    if kind not in ("pos", "for"):
        raise ValueError(f"unknown kind {kind!r}")
    rows = _labelled(_strided(lines, _sizes(labels), 1), labels)
    x, y, z = (_required(number(word(F.col("w"), k)), "incomplete atomic data") for k in range(3))
    key = ["run_id", "frame_id", "atom_id", "element"]
    if kind == "for":
        return rows.select(*key, F.hypot(F.hypot(x, y), z).alias("force"))
    return rows.select(*key, *[(v * K.BOHR_ANGSTROM_CP).alias(c) for v, c in zip((x, y, z), "xyz")])


def read_cp_frames(spark: SparkSession, path, labels: DataFrame, kind: str = "pos", run_pattern: str | None = None) -> DataFrame:
    return parse_cp_frames(number_lines(spark, path, run_pattern), labels, kind)


def parse_snapshots(lines: DataFrame, unit: str = "au") -> DataFrame:
    """Geometry with velocities and optional forces, one frame per file.

    With a count line the atoms start at the third line, and a file with fewer lines than that is an error; without,
    every line that is neither blank nor a ``#`` comment is an atom. ``unit="angstrom_fs"`` converts velocities to atomic units.
    """
    n = F.trim("head").try_cast("int")
    cut = F.raise_error(F.concat(F.lit("fewer atom lines than its count says in "), F.col("run_id"))).cast("boolean")
    # The count line itself meets the check, so that a file without any atom line fails too.
    short = n.isNotNull() & (F.col("n_lines") < F.greatest(n, F.lit(0)) + 2)
    counted = lines.where(F.when(short, cut).otherwise(n.isNotNull() & F.col("line_no").between(F.lit(2), n + 1))).select(
        "run_id", "line_no", (F.col("line_no") - 1).cast("int").alias("atom_id"), "value"
    )
    bare = lines.where(n.isNull() & (F.length(F.trim("value")) > 0) & ~F.ltrim("value").startswith("#"))
    bare = ordinal(bare.select("run_id", "line_no", "value"), ["run_id"], "line_no", "_k").select(
        "run_id", "line_no", (F.col("_k") + 1).cast("int").alias("atom_id"), "value"
    )
    w = tokens(F.col("value"))
    rows = counted.unionByName(bare).withColumn("w", w)
    scale = {"au": 1.0, "angstrom_fs": 1.0 / K.AU_VELOCITY_ANGSTROM_PER_FS}[unit]
    names = ("x", "y", "z", "vx", "vy", "vz")
    values = [_required(number(word(F.col("w"), k + 1)), "incomplete line") for k in range(6)]
    force = [F.when(F.size("w") >= 10, number(word(F.col("w"), 7 + k))).otherwise(0.0).alias(c) for k, c in enumerate(("fx", "fy", "fz"))]
    return rows.select(
        "run_id", F.lit(0).cast("bigint").alias("frame_id"), "atom_id", word(F.col("w"), 0).alias("element"),
        *[(v * scale if k >= 3 else v).alias(c) for k, (v, c) in enumerate(zip(values, names))], *force,
    )


def read_snapshot(spark: SparkSession, path, unit: str = "au", run_pattern: str | None = None) -> DataFrame:
    return parse_snapshots(number_lines(spark, path, run_pattern), unit)


def parse_states(lines: DataFrame, n_states: int) -> DataFrame:
    """State logs: run_id, row_idx, step, state and what is wrong with the line."""
    rows = lines.withColumn("w", tokens(F.col("value")))
    step, state = (word(F.col("w"), k).try_cast("int") for k in range(2))
    error = (
        F.when(F.size("w") != 2, F.concat(F.lit("expected 2 items, found "), F.size("w").cast("string")))
        .when(step.isNull() | state.isNull(), "non-integer value")
        .when(~state.between(0, n_states), F.concat(F.lit("invalid state "), state.cast("string")))
    )
    return rows.select(
        "run_id", F.col("line_no").alias("row_idx"), step.alias("step"),
        F.when(error.isNull(), state).alias("state"), error.alias("error"),
    )


def read_states(spark: SparkSession, path, n_states: int, run_pattern: str = RUN_BY_FOLDER) -> DataFrame:
    """State logs, one run per folder."""
    return parse_states(number_lines(spark, path, run_pattern), n_states)


ENERGY_COLUMNS = ("e_fict", "temperature", "e_ks", "c4", "e_total", "c6", "cpu_s")


def parse_energy(lines: DataFrame) -> DataFrame:
    """Energy logs of exactly eight columns per line."""
    rows = lines.withColumn("w", tokens(F.col("value")))
    value = lambda k: _required(F.when(F.size("w") == 8, number(word(F.col("w"), k))), "invalid format")
    return rows.select(
        "run_id", value(0).cast("bigint").alias("step"), *[value(k + 1).alias(c) for k, c in enumerate(ENERGY_COLUMNS)]
    )


def read_energy(spark: SparkSession, path, run_pattern: str | None = None) -> DataFrame:
    return parse_energy(number_lines(spark, path, run_pattern))


#: a comma outside of quotes
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line, comma):
    """Words of a line, or its comma-separated cells without blanks and quotes."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), '""', '"')
    return F.when(comma, F.transform(F.split(line, _COMMA), bare)).otherwise(tokens(line))


def parse_energy_headered(lines: DataFrame) -> DataFrame:
    """Energy tables, each run with its own header line: run_id, line_no, names, values and what is wrong with the line.

    The first non-blank line of a run names its columns. Cells are comma-separated (quotes allowed) if that
    line has a comma, else separated by blanks. Missing or repeated names and runs without a header are errors.
    """
    filled = lines.where(F.length(F.trim("value")) > 0)
    tops = filled.groupBy("run_id").agg(F.min("line_no").alias("_top"), F.min_by("value", "line_no").alias("_header"))
    comma = F.contains(F.col("_header"), F.lit(","))
    tops = tops.withColumn("_comma", comma).withColumn("names", F.transform(_cells(F.col("_header"), comma), F.trim))
    wrong = F.when(F.exists("names", lambda n: n == ""), "empty column name").when(
        F.size(F.array_distinct("names")) != F.size("names"), "duplicate column names"
    )
    tops = tops.select("run_id", "_top", "_comma", "names", F.when(wrong.isNotNull(), F.concat(wrong, F.lit(" in "), F.col("run_id"))).alias("_wrong"))
    rows = attach(filled.select("run_id", "line_no", "value"), tops, ["run_id"], spread="line_no")
    failed = F.raise_error(F.col("_wrong")).cast("boolean")
    rows = rows.where(F.when(F.col("_wrong").isNotNull(), failed).otherwise(F.col("line_no") > F.col("_top")))
    rows = rows.withColumn("w", _cells(F.col("value"), F.col("_comma"))).withColumn("values", F.transform("w", lambda c: c.try_cast("double")))
    first = F.array_position(F.transform("values", lambda v: v.isNull()), True).cast("int")
    error = (
        F.when(F.size("w") != F.size("names"), F.concat(F.size("w").cast("string"), F.lit(" values for "), F.size("names").cast("string"), F.lit(" columns")))
        .when(first > 0, F.concat(F.lit("column '"), F.get("names", first - 1), F.lit("' is not numeric")))
    )
    return rows.select("run_id", (F.col("line_no") + 1).alias("line_no"), "names", "values", error.alias("error"))


def energy_column(rows: DataFrame, name: str):
    """The values of one named column, NULL in runs whose header does not have it."""
    at = F.array_position("names", name).cast("int")
    return F.when(at > 0, F.get("values", at - 1))


def read_energy_headered(spark: SparkSession, path, run_pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: run_id, line_no and one column of doubles per name, error rows: run_id, line_no, error).

    Files may have different headers; a column that a file does not have is NULL there.
    """
    rows = stage(parse_energy_headered(number_lines(spark, path, run_pattern)))
    # Column names become part of the plan; there are as many as the headers hold.
    names = [r["n"] for r in rows.select(F.explode("names").alias("n")).groupBy("n").count().orderBy("n").collect()]
    good = rows.where(F.col("error").isNull()).select("run_id", "line_no", *[energy_column(rows, n).alias(n) for n in names])
    return good, rows.where(F.col("error").isNotNull()).select("run_id", "line_no", "error")


def symbols_of(atoms: DataFrame) -> DataFrame:
    """atom_id, element of a one-frame geometry, to label headerless trajectories."""
    return atoms.where(F.col("frame_id") == 0).select("atom_id", symbol(F.col("element")).alias("element"))
