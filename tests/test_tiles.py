import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.operators.neighbors import neighbor_pairs
from kinetrove.operators.tiles import tile_pairs


def read(df, extra=()):
    return sorted((r.run_id, r.frame_id, r.i, r.j, round(r.d2, 9), *[r[c] for c in extra]) for r in df.collect())


@pytest.fixture(scope="module")
def atoms(spark):
    rng = np.random.default_rng(5)
    rows = []
    for run, frame, n in (("a", 0, 300), ("a", 1, 250), ("b", 0, 40), ("c", 0, 1)):
        rows += [(run, frame, k + 1, *map(float, p), float(k)) for k, p in enumerate(rng.uniform(-1.5, 7.5, (n, 3)))]
    # On edges of tiles and of the cell, and two atoms at one place.
    rows += [("d", 0, k + 1, *p, 0.0) for k, p in enumerate([(0.0, 0.0, 0.0), (6.0, 0.0, 0.0), (3.0, 3.0, 3.0), (3.0, 3.0, 3.0), (-1e-17, 5.999999, 0.0), (0.7, 0.0, 0.0)])]
    return spark.createDataFrame(rows, "run_id string, frame_id long, atom_id int, x double, y double, z double, q double")


@pytest.mark.parametrize("cell", [None, (6.0, 6.0, 6.0), (6.0, 2.5, 9.0), (1.3, 6.0, 6.0)])
@pytest.mark.parametrize("edge", [1.0, 2.2, None])
def test_pairs_equal_those_of_the_join(spark, atoms, cell, edge):
    want = read(neighbor_pairs(atoms, 0.9, ["run_id", "frame_id"], carry=["q"], cell=cell), ("q_i", "q_j"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (before, "17"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert read(tile_pairs(atoms, 0.9, edge, cell, ["q"]), ("q_i", "q_j")) == want and len(want) > 200
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_large_frame(spark):
    """A periodic lattice: every atom has six neighbours."""
    n = 56
    k = F.col("id")
    atoms = spark.range(n**3, numPartitions=4).select(
        F.lit("r").alias("run_id"), F.lit(0).cast("long").alias("frame_id"), (k + 1).alias("atom_id"),
        (k % n).cast("double").alias("x"), (F.floor(k / n) % n).cast("double").alias("y"), F.floor(k / (n * n)).cast("double").alias("z"),
    )
    pairs = tile_pairs(atoms, 1.1, edge=7.0, cell=(n, n, n))
    assert pairs.count() == 3 * n**3
    assert pairs.select("i", "j").distinct().count() == 3 * n**3
