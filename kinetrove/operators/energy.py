"""Energy logs, unit conversion and transition-state rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.functions import constants as K
from kinetrove.functions.units import unit_table


def energy_columns(log: DataFrame, dt: float, unit: str = "steps") -> DataFrame:
    """The plotted quantities of an 8-column energy log over steps, fs or ps."""
    step = F.col("step").cast("double")
    fs = step * F.lit(float(dt)) * F.lit(K.ENERGY_LOG_TIME_FS)
    axis = {"steps": step, "fs": fs, "ps": fs / 1000.0}
    if unit not in axis:
        raise ValueError(f"unknown time unit {unit!r}")
    return log.select(
        *(["run_id"] if "run_id" in log.columns else []),
        "step",
        axis[unit].alias("x"),
        F.col("e_fict").alias("fictitious"),
        F.col("temperature"),
        F.col("e_ks").alias("kohn_sham"),
        F.col("c4"),
        (F.col("c4") - F.col("e_ks")).alias("ionic_kinetic"),
        F.col("e_total").alias("total"),
        F.col("cpu_s").alias("cpu_time"),
    )


def convert_units(df: DataFrame, value: str, from_unit: str, to_unit: str, category: str) -> DataFrame:
    """Convert a column between the units named in two columns; adds ``converted`` and ``unit_error``.

    A name matches its key exactly, or key and aliases ignoring case. The unit table is fixed and
    small, so it is broadcast twice.
    """
    units = unit_table(df.sparkSession, category)
    source = F.broadcast(units.select(F.col("name").alias("_from"), F.col("factor").alias("_f")))
    target = F.broadcast(units.select(F.col("name").alias("_to"), F.col("factor").alias("_t")))
    keyed = df.withColumn("_from", F.lower(from_unit)).withColumn("_to", F.lower(to_unit))
    joined = keyed.join(source, "_from", "left").join(target, "_to", "left")
    error = F.when(F.col("_f").isNull(), F.concat(F.lit("Unsupported unit "), F.col(from_unit))).when(
        F.col("_t").isNull(), F.concat(F.lit("Unsupported unit "), F.col(to_unit))
    )
    return joined.select(*df.columns, (F.col(value) * F.col("_f") / F.col("_t")).alias("converted"), error.alias("unit_error"))


def rescale(df: DataFrame, cols: list[str], factor: float) -> DataFrame:
    """Multiply coordinate or velocity columns by a unit factor."""
    return df.withColumns({c: F.col(c) * F.lit(float(factor)) for c in cols})


def tst_rate(temperature: Column, ea: Column, entropy: Column) -> Column:
    """(kB T / h) exp(S/R) exp(-Ea/(R T)); Ea in J/mol, S in J/(mol K)."""
    r = F.lit(K.GAS_CONSTANT_J)
    return F.lit(K.BOLTZMANN_J) * temperature / F.lit(K.PLANCK_JS) * F.exp(entropy / r) * F.exp(-ea / (r * temperature))


def rate_constant(reactions: DataFrame, temperature: float, ea: str = "ea", entropy: str = "entropy") -> DataFrame:
    t = F.lit(float(temperature))
    return reactions.withColumn("temperature", t).withColumn("rate", tst_rate(t, F.col(ea), F.col(entropy)))


def arrhenius(reactions: DataFrame, t_min: float, t_max: float, n: int = 100, ea: str = "ea", entropy: str = "entropy") -> DataFrame:
    """Each reaction over ``n`` evenly spaced temperatures: (T, k) and (1/T, ln k)."""
    step = (t_max - t_min) / (n - 1)
    point = F.when(F.col("point") == n - 1, F.lit(float(t_max))).otherwise(F.lit(float(t_min)) + F.col("point") * F.lit(step))
    grid = reactions.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("temperature", point)
    rate = tst_rate(F.col("temperature"), F.col(ea), F.col(entropy))
    return grid.withColumn("rate", rate).withColumn("inv_t", 1.0 / F.col("temperature")).withColumn("ln_k", F.ln("rate"))
