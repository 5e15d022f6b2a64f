"""Unit factors to the base unit of each category (J, m, s, m/s, g/cm^3) as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_AVOGADRO = 6.02214076e23
_ATOMIC_TIME_S = 2.4188843265857e-17
_BOHR_M = 5.29177210903e-11
_LENGTHS_PER = {"km": 1000.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}
_LENGTH_NAMES = {
    "km": "kilometer", "m": "meter", "cm": "centimeter", "mm": "millimeter", "ft": "foot", "yd": "yard", "mi": "mile",
}
_TIMES_PER = {"s": ("second", 1.0), "min": ("minute", 60.0), "h": ("hour", 3600.0)}

# --- fixed values: key, factor to the base unit, aliases separated by "|" ---------------------
_UNITS: dict[str, list[tuple[str, float, str]]] = {
    "energy": [
        ("hartree", 4.3597447222060e-18, "eh"),
        ("joule", 1.0, "j"),
        ("cal/mol", 4.184 / _AVOGADRO, "calorie/mol"),
        ("kcal/mol", 4184.0 / _AVOGADRO, "kilocalorie/mol"),
        ("ev", 1.602176634e-19, "electronvolt"),
    ],
    "length": [
        ("meter", 1.0, "m|metre"),
        ("kilometer", 1000.0, "km|kilometre"),
        ("centimeter", 0.01, "cm|centimetre"),
        ("millimeter", 0.001, "mm|millimetre"),
        ("micrometer", 1e-6, "um|µm|micron"),
        ("nanometer", 1e-9, "nm|nanometre"),
        ("angstrom", 1e-10, "ångström|ang|å"),
        ("bohr", _BOHR_M, "a0|a_0|a₀|bohr radius"),
        ("mile", 1609.344, "mi"),
        ("yard", 0.9144, "yd"),
        ("foot", 0.3048, "ft"),
        ("inch", 0.0254, "in"),
        ("light_year", 9.4607304725808e15, "light year|ly|light-year"),
        ("parsec", 3.0856775814913673e16, "pc"),
    ],
    "time": [
        ("second", 1.0, "s|sec"),
        ("millisecond", 1e-3, "ms"),
        ("minute", 60.0, "min"),
        ("hour", 3600.0, "h|hr"),
        ("day", 86400.0, "d"),
        ("week", 604800.0, "wk|w"),
        ("month", 31536000.0 / 12.0, "mo"),
        ("year", 31536000.0, "y|yr"),
        ("decade", 315360000.0, "dec"),
        ("century", 3153600000.0, "c"),
        ("millennium", 31536000000.0, "mil"),
        ("microsecond", 1e-6, "us|µs"),
        ("nanosecond", 1e-9, "ns"),
        ("picosecond", 1e-12, "ps"),
        ("femtosecond", 1e-15, "fs"),
        ("atomic_time_unit", _ATOMIC_TIME_S, "au|a.u.|atomic unit of time"),
    ],
    "density": [
        ("amu/angstrom^3", 1e24 / _AVOGADRO, "amu/å^3|amu/a^3|amu/ang^3|amu/å³|amu/a3"),
        ("g/cm^3", 1.0, "g/cm3|gram per cubic centimeter"),
        ("kg/l", 1.0, "kg/liter"),
    ],
    "velocity": [
        ("knot", 0.5144444444, "kt|kn"),
        ("knot_uk", 0.5147733333, "kt uk|kt (uk)|knot uk"),
        ("c", 299792458.0, "speed of light|light speed"),
        ("cosmic_first", 7899.9999999999, "first cosmic velocity"),
        ("cosmic_second", 11200.0, "second cosmic velocity"),
        ("cosmic_third", 16670.0, "third cosmic velocity"),
        ("earth_velocity", 29765.0, "earth velocity"),
        ("sound_pure_water", 1482.6999999998, "sound pure water"),
        ("sound_sea_water", 1521.6, "sound sea water"),
        ("mach_20c", 343.6, "mach 20c|mach 20 c"),
        ("mach_si", 295.0464000003, "mach si"),
        ("angstrom/fs", 1e5, "angstrom per fs|ang/fs|a/fs"),
        ("atomic_velocity", _BOHR_M / _ATOMIC_TIME_S, "au velocity|a.u. velocity|bohr/atomic time unit"),
    ],
}
# Further spellings of quotient units.
_VELOCITY_EXTRA = {
    "m/s": "meter per second|metre/second", "km/h": "kph|kilometre/hour", "mi/h": "mph", "ft/s": "fps",
}


def unit_rows(category: str) -> list[tuple[str, str, float]]:
    """(lower-case name, key, factor) for every key and alias of a category."""
    if category not in _UNITS:
        raise ValueError(f"Unsupported category: {category}")
    units = list(_UNITS[category])
    if category == "velocity":
        for length, meters in _LENGTHS_PER.items():
            for per, (word, seconds) in _TIMES_PER.items():
                key = f"{length}/{per}"
                extra = _VELOCITY_EXTRA.get(key)
                names = f"{_LENGTH_NAMES[length]}/{word}" + (f"|{extra}" if extra else "")
                units.append((key, meters / seconds, names))
    rows = {}
    for key, factor, aliases in units:
        for name in (key, *aliases.split("|")):
            rows.setdefault(name.lower(), (name.lower(), key, factor))
    return list(rows.values())


def unit_table(spark: SparkSession, category: str) -> DataFrame:
    rows = ", ".join(f"('{name}', '{key}', {factor!r}D)" for name, key, factor in unit_rows(category))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS units(name, key, factor)")
