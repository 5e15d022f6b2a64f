"""Many small one-structure files: XYZ, PDB/ENT, HIN, MOL, MOL2, Gaussian and CPMD input decks.

A file is one row. Its lines become an array, a format picks the atom lines from it by position or by
their first characters, and every atom line becomes a row; all of that with built-in functions. Only
CPMD decks, whose lines have no meaning without those before, are read line by line in Python, one
file at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.functions.constants import BOHR_ANGSTROM_DECK
from kinetrove.functions.text import number, symbol, tokens, word

SCHEMA = "run_id string, frame_id bigint, atom_id int, element string, x double, y double, z double"


def _fail(reason: str | Column) -> Column:
    return F.raise_error(F.concat(F.col("run_id"), F.lit(": "), F.lit(reason) if isinstance(reason, str) else reason))


def _first(lines: Column, test: Callable[[Column], Column], after: Column | None = None) -> Column:
    """0-based position of the first line that passes, past ``after``; NULL if none does."""
    at = F.transform(lines, lambda x, i: F.when(test(x) & (F.lit(True) if after is None else i > after), i))
    return F.array_min(at)


def _between(lines: Column, start: Column, stop: Column) -> Column:
    """Lines from position ``start`` up to before ``stop``."""
    return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))


def _counted(block: Column, wanted: Column, what: str) -> Column:
    short = F.concat(F.lit(f"{what}: "), F.size(block).cast("string"), F.lit(" of "), F.coalesce(wanted.cast("string"), F.lit("?")), F.lit(" atoms"))
    return F.when(F.size(block).eqNullSafe(wanted), block).otherwise(_fail(short).cast("array<string>"))


def _filled(x: Column) -> Column:
    return F.trim(x) != ""


def _xyz(lines: Column) -> Column:
    body = F.filter(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), _filled)
    return _counted(body, F.trim(F.get(lines, F.lit(0))).try_cast("int"), "header says otherwise")


def _pdb(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.startswith("ATOM") | x.startswith("HETATM"))


def _hin(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.startswith("atom"))


def _mol(lines: Column) -> Column:
    wanted = F.trim(F.substr(F.get(lines, F.lit(3)), F.lit(1), F.lit(3))).try_cast("int")
    return _counted(F.slice(lines, 5, F.greatest(F.coalesce(wanted, F.lit(0)), F.lit(0))), wanted, "lines are missing")


def _mol2(lines: Column) -> Column:
    start = _first(lines, lambda x: F.startswith(F.trim(x), F.lit("@<TRIPOS>ATOM")))
    stop = F.coalesce(_first(lines, lambda x: F.startswith(F.trim(x), F.lit("@<TRIPOS>")), start), F.size(lines))
    return F.when(start.isNull(), F.array().cast("array<string>")).otherwise(F.filter(_between(lines, start + 1, stop), _filled))


def _gaussian(lines: Column) -> Column:
    charge = _first(lines, lambda x: x.rlike(r"^\s*[-+]?\d+\s+[-+]?\d+\s*$"))
    end = F.coalesce(_first(lines, lambda x: F.trim(x) == "", charge), F.size(lines))
    return F.when(charge.isNull(), _fail("charge and multiplicity are missing").cast("array<string>")).otherwise(_between(lines, charge + 1, end))


def _words(name: int, first: int, need: int) -> Callable[[Column], tuple[Column, list[Column]]]:
    def cells(line: Column) -> tuple[Column, list[Column]]:
        w = F.when(F.size(tokens(line)) >= need, tokens(line)).otherwise(_fail(F.concat(F.lit("too few words: "), line)).cast("array<string>"))
        return word(w, name), [word(w, first + k) for k in range(3)]

    return cells


def _fixed(name: list[tuple[int, int]], first: list[tuple[int, int]]) -> Callable[[Column], tuple[Column, list[Column]]]:
    def cells(line: Column) -> tuple[Column, list[Column]]:
        cut = [F.trim(F.substr(line, F.lit(a), F.lit(n))) for a, n in name]
        return F.coalesce(*[F.when(c != "", c) for c in cut], F.lit("")), [F.substr(line, F.lit(a), F.lit(n)) for a, n in first]

    return cells


def _mol2_cells(line: Column) -> tuple[Column, list[Column]]:
    kind, places = _words(5, 2, 6)(line)
    return F.substring_index(kind, ".", 1), places


#: fixed values: where each format has its atom lines, and symbol and coordinates on them (words from 0, columns from 1)
_FORMATS = {
    "xyz": (_xyz, _words(0, 1, 4)),
    "pdb": (_pdb, _fixed([(77, 2), (13, 4)], [(31, 8), (39, 8), (47, 8)])),
    "ent": (_pdb, _fixed([(77, 2), (13, 4)], [(31, 8), (39, 8), (47, 8)])),
    "hin": (_hin, _words(2, 4, 7)),
    "mol": (_mol, _fixed([(32, 3)], [(1, 10), (11, 10), (21, 10)])),
    "mol2": (_mol2, _mol2_cells),
    "gaussian": (_gaussian, _words(0, 1, 4)),
}


def _deck_section(lines: list[str], name: str) -> list[str]:
    inside = [n for n, x in enumerate(lines) if x.upper() == name]
    return list(takewhile(lambda x: x.upper() != "&END", islice(lines, inside[0] + 1, None))) if inside else []


def _deck_atoms(text: str) -> Iterator[tuple[str, float, float, float]]:
    lines = [x.strip() for x in text.splitlines()]
    system = {x.upper() for x in _deck_section(lines, "&SYSTEM")}
    if "CELL" not in system:
        raise ValueError("the system section gives no CELL")
    scale = 1.0 if "ANGSTROM" in system else BOHR_ANGSTROM_DECK
    fortran = str.maketrans("dD", "ee")
    rest = iter([x for x in _deck_section(lines, "&ATOMS") if x])
    for line in rest:
        if not line.startswith("*"):
            continue
        name = "".join(takewhile(str.isalpha, line.lstrip("*")[:2])).capitalize()
        if not name:
            raise ValueError(f"a pseudopotential without an element: {line}")
        next(rest)  # angular momentum
        for _ in range(int(next(rest))):
            place = [float(w.translate(fortran)) * scale for w in next(rest).split()[:3]]
            if len(place) < 3:
                raise ValueError(f"an atom of {name} has fewer than three coordinates")
            yield (name, *place)


def _parse_decks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for run, text in zip(batch["run_id"], batch["value"]):
            try:
                rows = [(run, 0, n, *a) for n, a in enumerate(_deck_atoms(text or ""), start=1)]
            except (ValueError, RuntimeError) as problem:
                raise ValueError(f"{run}: {problem}") from problem
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])


def parse_structures(files: DataFrame, fmt: str) -> DataFrame:
    """(run_id, value = whole file) -> atoms of frame 0. A malformed file fails with its name."""
    fmt = fmt.lower()
    if fmt == "cpmd":
        return files.select("run_id", "value").mapInPandas(_parse_decks, SCHEMA)
    if fmt not in _FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    pick, cells = _FORMATS[fmt]
    split = files.select("run_id", F.split(F.coalesce("value", F.lit("")), "\r?\n").alias("_lines"))
    atoms = split.select("run_id", F.posexplode(pick(F.col("_lines"))).alias("_n", "_line"))
    name, places = cells(F.col("_line"))
    placed = [F.coalesce(number(p), _fail(F.concat(F.lit("not a coordinate in: "), F.col("_line"))).cast("double")).alias(c) for p, c in zip(places, "xyz")]
    return atoms.select("run_id", F.lit(0).cast("bigint").alias("frame_id"), (F.col("_n") + 1).cast("int").alias("atom_id"), symbol(name).alias("element"), *placed)


def read_structures(spark: SparkSession, path: str | list[str], fmt: str) -> DataFrame:
    """Read one-structure files; ``run_id`` is the file path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run_id"), "value")
    return parse_structures(files, fmt)
