"""Multi-frame XYZ trajectories: count line, comment line, one line per atom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.functions.text import number, symbol, tokens, word
from kinetrove.plans.staging import attach, stage
from kinetrove.sources.chain import laid_over, starts
from kinetrove.sources.lines import number_lines

_ROW = ["run_id", "frame_id", "row", "count", "n_atoms", "line_no", "value", "last_line"]


def _first_word(value: Column) -> Column:
    return word(tokens(value), 0).try_cast("int")


def _chained(lines: DataFrame, count: Column, skip: Column) -> DataFrame:
    """Frames whose own count lines give their lengths, read one after another: frame_id, row, count per line.

    ``skip`` marks lines that are passed over where a frame may begin. A line there that is no count
    ends the chain; it is a frame of its own. Lines outside of frames are left out.
    """
    sized = lines.select("run_id", "line_no", count.cast("bigint").alias("count"), skip.alias("skip"), F.col("last_line").cast("bigint").alias("last_line"))
    return laid_over(lines, stage(starts(sized), "frame-starts"))


def frame_rows(lines: DataFrame) -> DataFrame:
    """Lines with their frame, their row in the frame (0 count, 1 comment, 2.. atoms), count and n_atoms.

    ``lines``: run_id, line_no, value, head. ``count`` is what the frame's own count line says,
    ``n_atoms`` what the first one of the run does. Lines are placed by arithmetic; runs whose count
    lines are not where that puts them (blank lines before frames, changing or damaged counts) are
    followed from frame to frame instead.
    """
    filled = F.length(F.trim("value")) > 0
    sized = lines.withColumn("_n", _first_word(F.col("head")))
    step = F.when(F.col("_n") > 0, F.col("_n") + 2)
    at_count = F.col("line_no") % step == 0
    checks = sized.groupBy("run_id").agg(
        F.max(F.when(filled, F.col("line_no"))).alias("last_line"),
        F.min_by(_first_word(F.col("value")), F.when(filled, F.col("line_no"))).alias("n_atoms"),
        F.max(F.when(filled & at_count & ~_first_word(F.col("value")).eqNullSafe(F.col("_n")), F.col("line_no"))).alias("_bad"),
        F.max(F.when(~filled & at_count, F.col("line_no"))).alias("_blank"),
        F.max("_n").alias("_n"),
    ).where(F.col("last_line").isNotNull())
    odd = F.col("_n").isNull() | (F.col("_n") < 1) | F.col("_bad").isNotNull() | (F.col("_blank") < F.col("last_line"))
    marked = stage(checks.select("run_id", "last_line", "n_atoms", F.coalesce(odd, F.lit(False)).alias("odd")))
    joined = attach(lines.select("run_id", "line_no", "value"), marked, ["run_id"], spread="line_no", staged=True)
    joined = joined.where(F.col("line_no") <= F.col("last_line"))
    length = F.when(F.col("n_atoms") > 0, F.col("n_atoms") + 2)
    regular = joined.where(~F.col("odd")).withColumns({
        "frame_id": F.floor(F.col("line_no") / length), "row": F.col("line_no") % length, "count": F.col("n_atoms").cast("bigint"),
    })
    if marked.where("odd").isEmpty():
        return regular.select(*_ROW)
    count = F.when(_first_word(F.col("value")) >= 1, _first_word(F.col("value")))
    # Blank lines between frames belong to none; after a damaged count line nothing can be placed.
    followed = _chained(joined.where("odd"), count, ~filled)
    return regular.select(*_ROW).unionByName(followed.select(*_ROW))


def _problem(words: Column) -> Column:
    """What is wrong with a line, or NULL."""
    row, n = F.col("row"), F.col("count")
    coords = [number(word(words, k)) for k in (1, 2, 3)]
    where = F.concat(F.lit(" in frame "), (F.col("frame_id") + 1).cast("string"), F.lit(", line "), (F.col("line_no") + 1).cast("string"))
    # Lines outside of frames are filtered away too, but filters may run in any order.
    outside = (row > 0) & (n.isNull() | (row >= n + 2))
    return (
        F.when(outside | (F.col("line_no") > F.col("last_line")), F.lit(None).cast("string"))
        .when((row == 0) & n.isNull(), F.concat(F.lit("invalid atom count"), where))
        .when((row == 0) & ~n.eqNullSafe(F.col("n_atoms").cast("bigint")), F.concat(F.lit("atom count changes"), where))
        .when((row == 0) & (F.col("line_no") + n + 1 > F.col("last_line")), F.concat(F.lit("truncated frame"), where))
        .when((row >= 2) & (F.size(words) < 4), F.concat(F.lit("atom line needs four words"), where))
        .when((row >= 2) & (coords[0].isNull() | coords[1].isNull() | coords[2].isNull()),
              F.concat(F.lit("coordinate is not a number"), where))
    )


def _checked(lines: DataFrame) -> DataFrame:
    return frame_rows(lines).withColumn("_w", tokens(F.col("value"))).withColumn("_problem", _problem(F.col("_w")))


def placed_frames(lines: DataFrame) -> DataFrame:
    """Count lines of the complete frames before the first damaged one of each run: run_id, frame_id, line_no, count."""
    rows = _checked(lines)
    first = rows.where(F.col("_problem").isNotNull() & ~F.col("_problem").startswith("atom count changes")).groupBy("run_id").agg(F.min("frame_id").alias("_cut"))
    kept = attach(rows.where("row = 0"), first, ["run_id"], "left", spread="line_no")
    return kept.where(F.col("_cut").isNull() | (F.col("frame_id") < F.col("_cut"))).select("run_id", "frame_id", "line_no", "count")


def corrupt_frames(lines: DataFrame) -> DataFrame:
    """What PERMISSIVE leaves out: run_id, frame_id (from 0), line_no (from 1) and error of the first bad line of
    each run, and the number of frames from there on that could be placed."""
    rows = _checked(lines)
    first = rows.where(F.col("_problem").isNotNull()).groupBy("run_id").agg(
        F.min(F.struct("frame_id", "line_no", F.col("_problem").alias("error"))).alias("e")
    )
    last = rows.groupBy("run_id").agg(F.max("frame_id").alias("_last"))
    return first.join(last, ["run_id"]).select(
        "run_id", "e.frame_id", (F.col("e.line_no") + 1).alias("line_no"), "e.error", (F.col("_last") - F.col("e.frame_id") + 1).alias("dropped_frames")
    )


def parse_xyz(lines: DataFrame, mode: str = "STRICT", normalise: bool = False) -> DataFrame:
    """Numbered lines -> atoms. STRICT fails on a bad line; PERMISSIVE keeps the frames before the
    first bad one of each run, and ``corrupt_frames`` tells which it left out."""
    if mode not in ("STRICT", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    row = F.col("row")
    rows = _checked(lines)
    if mode == "PERMISSIVE":
        first = rows.where(F.col("_problem").isNotNull()).groupBy("run_id").agg(F.min("frame_id").alias("_cut"))
        rows = attach(rows, first, ["run_id"], "left", spread="line_no").where(
            (F.col("_cut").isNull() | (F.col("frame_id") < F.col("_cut"))) & (row >= 2)
        )
    else:
        # One condition and no other after it, so that a bad count line is met before count lines are filtered away.
        failed = F.raise_error(F.col("_problem")).cast("boolean")
        rows = rows.where(F.when(F.col("_problem").isNotNull(), failed).otherwise(row >= 2))
    w = F.col("_w")
    element = symbol(word(w, 0)) if normalise else word(w, 0)
    return rows.select(
        "run_id", "frame_id", (row - 1).cast("int").alias("atom_id"), element.alias("element"),
        *[number(word(w, k)).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))],
    )


def read_xyz(
    spark: SparkSession, path: str | list[str], mode: str = "STRICT", normalise: bool = False, run_pattern: str | None = None
) -> DataFrame:
    """Read XYZ trajectories; any number of files, each of any size. ``normalise`` fixes symbol case."""
    return parse_xyz(number_lines(spark, path, run_pattern), mode, normalise)


def validate_xyz(lines: DataFrame) -> DataFrame:
    """Error rows (run_id, line_no from 1, error); atom lines must have exactly four words.

    Each frame is as long as its own count line says. After a line that should hold a count and does
    not the lines of a run can no longer be placed, so it is the last one reported.
    """
    whole = F.trim("value").try_cast("int")
    sized = lines.withColumn("_n", F.trim("head").try_cast("int"))
    at_count = F.col("line_no") % F.when(F.col("_n") > 0, F.col("_n") + 2) == 0
    checks = sized.groupBy("run_id").agg(
        F.max("line_no").alias("last_line"), F.max("_n").alias("n_atoms"),
        F.coalesce(F.max(F.col("_n").isNull() | (F.col("_n") < 1) | (at_count & ~whole.eqNullSafe(F.col("_n")))), F.lit(True)).alias("odd"),
    )
    marked = stage(checks)
    joined = attach(lines.select("run_id", "line_no", "value"), marked, ["run_id"], spread="line_no", staged=True)
    length = F.when(F.col("n_atoms") > 0, F.col("n_atoms") + 2)
    rows = joined.where(~F.col("odd")).withColumns({"row": F.col("line_no") % length, "count": F.col("n_atoms").cast("bigint")})
    kept = ["run_id", "line_no", "value", "last_line", "row", "count"]
    rows = rows.select(*kept)
    if not marked.where("odd").isEmpty():
        rows = rows.unionByName(_chained(joined.where("odd"), whole, F.lit(False)).select(*kept))
    rows = rows.withColumn("_w", tokens(F.col("value")))
    w, row, n = F.col("_w"), F.col("row"), F.greatest("count", F.lit(0).cast("bigint"))
    known = F.col("count").isNotNull()
    coords = [number(word(w, k)) for k in (1, 2, 3)]
    atom = known & (row >= 2) & (row < n + 2)
    at_end = known & (F.col("line_no") == F.col("last_line"))
    error = (
        F.when((row == 0) & ~known, "invalid number of atoms")
        .when(atom & (F.size(w) != 4), F.concat(F.lit("expected 4 items, found "), F.size(w).cast("string")))
        .when(atom & (coords[0].isNull() | coords[1].isNull() | coords[2].isNull()), "non-numeric coordinate")
        .when(at_end & (row == 0), "missing comment line")
        .when(at_end & (row < n + 1), "incomplete atom lines")
    )
    return rows.withColumn("error", error).where(F.col("error").isNotNull()).select(
        "run_id", (F.col("line_no") + 1).alias("line_no"), "error"
    )
