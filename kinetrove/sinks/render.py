"""Frames as text: one string per frame, formatted inside the row and written by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: layouts of one atom line. Arguments: number, symbol, x, y, z ----------------
_ATOM = {
    "trajectory": "%2$-4s%3$14.7f%4$14.7f%5$14.7f",
    "selection": "%2$s %3$14.6f %4$14.6f %5$14.6f",
    "xyz": "%2$-2s %3$16.8f %4$16.8f %5$16.8f",
    "pdb": "ATOM  %1$5d %2$-4s MOL A   1    %3$8.3f%4$8.3f%5$8.3f  1.00  0.00          %2$2s",
    "hin": "atom %1$5d %2$-2s 0 %3$.6f %4$.6f %5$.6f",
    "mol": "%3$10.4f%4$10.4f%5$10.4f %2$-3s 0  0  0  0  0  0  0  0  0  0  0  0",
    "mol2": "%1$7d %2$s%1$-3d %3$10.4f %4$10.4f %5$10.4f %2$-6s 1 MOL 0.0000",
    "gaussian": "%2$-2s %3$16.8f %4$16.8f %5$16.8f",
}
# --- fixed values: text before and after the atoms; %1$d is the number of atoms, %2$s a title --
_FRAME = {
    "xyz": ("%1$d\n%2$s\n", ""),
    "pdb": ("REMARK   %2$s\n", "\nEND"),
    "hin": ("mol 1 %2$s\n", "\nendmol 1"),
    "mol": ("%2$s\n\n\n%1$3d  0  0  0  0  0            999 V2000\n", "\nM  END"),
    "mol2": ("@<TRIPOS>MOLECULE\n%2$s\n%1$d 0 0 0 0\nSMALL\nNO_CHARGES\n\n@<TRIPOS>ATOM\n", "\n@<TRIPOS>BOND"),
    "gaussian": ("# sp\n\n%2$s\n\n0 1\n", "\n"),
}


def _body(layout: str, scale: float = 1.0) -> Column:
    def line(p, n):
        xyz = [p[c] * F.lit(scale) if scale != 1.0 else p[c] for c in "xyz"]
        return F.format_string(_ATOM[layout], n + 1, F.get("elements", n), *xyz)

    return F.array_join(F.transform("pos", line), "\n")


def render_xyz(
    frames: DataFrame,
    comment: Column | None = None,
    layout: str = "trajectory",
    scale: float = 1.0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """run_id, frame_id, text: one XYZ frame per row. ``scale`` converts lengths on the way out,
    ``keep`` names further columns to carry along."""
    note = F.concat(F.lit("Frame "), (F.col("frame_id") + 1).cast("string")) if comment is None else comment
    head = F.concat(F.size("pos").cast("string"), F.lit("\n"), note, F.lit("\n"))
    return frames.select("run_id", "frame_id", *keep, F.concat(head, _body(layout, scale)).alias("text"))


def render_structures(frames: DataFrame, fmt: str, header: str | None = None, title: str = "kinetrove frame") -> DataFrame:
    """run_id, frame_id, text: every frame as one file of the format. ``header`` replaces the text
    before the atoms."""
    fmt = {"ent": "pdb"}.get(fmt.lower(), fmt.lower())
    if fmt not in _FRAME:
        raise ValueError(f"Unsupported format: {fmt}")
    top, bottom = _FRAME[fmt]
    head = F.format_string(top, F.size("pos"), F.lit(title)) if header is None else F.lit(header)
    return frames.select("run_id", "frame_id", F.concat(head, _body(fmt), F.lit(bottom)).alias("text"))


def gaussian_inputs(
    frames: DataFrame, chk: str, memory: str, processors: int, route: str, charge: int = 0, multiplicity: int = 1,
    title: str = "Gaussian input",
) -> DataFrame:
    """One Gaussian input per selected frame."""
    header = f"%chk={chk}\n%Mem={memory}\n%nproc={processors}\n# {route}\n\n{title}\n\n{charge} {multiplicity}\n"
    return render_structures(frames, "gaussian", header)


def write_text(
    frames: DataFrame, path: str, by: tuple[str, ...] = ("run_id",), partitions: int | None = None,
    render: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write frames under ``path``, one folder per value of ``by``, in frame order.

    Rows are ranged by (by, frame_id), so a long run becomes many files that follow each other. ``render`` gives the
    text of ranged frames, once; without it ``frames`` has a column ``text`` already.
    """
    order = [*by, *(c for c in ("run_id", "frame_id") if c not in by)]
    ranged = frames.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    rendered = render(ranged) if render else ranged
    rendered.select(*by, "text").write.partitionBy(*by).mode("overwrite").text(path)


def write_frames_by_state(labelled: DataFrame, path: str, partitions: int | None = None) -> None:
    """Frames with a ``state`` column as XYZ text, one folder per state over all runs.

    A rerun replaces the folder; nothing is appended.
    """
    write_text(labelled, path, by=("state",), partitions=partitions, render=lambda f: render_xyz(f, keep=("state",)))


def write_series(df: DataFrame, path: str) -> None:
    """Series, histograms and curves as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
