"""Unit conversions, materials and display formats as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Units that board documents may declare, in metres.
UNIT_SCALE_M = {
    "MILLIMETER": 1e-3,
    "MILLIMETRE": 1e-3,
    "MICRON": 1e-6,
    "MICROMETER": 1e-6,
    "CENTIMETER": 1e-2,
    "METER": 1.0,
    "INCH": 25.4e-3,
    "MIL": 25.4e-6,
    "MICROINCH": 25.4e-9,
}
# Annealed copper, and the foil thickness of one ounce a square foot.
COPPER_CONDUCTIVITY = 5.8001e7
COPPER_TCR = 3.93e-3
COPPER_REFERENCE_K = 293.15
OUNCE_M = 34.8e-6


def unit_table(spark: SparkSession) -> DataFrame:
    """(unit, scale) of every known unit; nine rows, so it is always safe to broadcast."""
    return spark.createDataFrame(sorted(UNIT_SCALE_M.items()), "unit string, scale double")


def unit_scale(unit: Column) -> Column:
    """Metres of one ``unit``; an unknown or missing unit is an error, never a guess."""
    key = F.upper(F.trim(unit))
    scale = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(UNIT_SCALE_M.items()) for x in pair]), key)
    message = F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("none declared")))
    return F.when(key.isin(*UNIT_SCALE_M), scale).otherwise(F.raise_error(message).cast("double"))


def to_metres(value: Column, unit: Column) -> Column:
    return value * unit_scale(unit)


def celsius_to_kelvin(c: Column) -> Column:
    return c + F.lit(273.15)


def kelvin_to_celsius(k: Column) -> Column:
    return k - F.lit(273.15)


def millimetres(m: Column) -> Column:
    return m * 1e3


def micrometres(m: Column) -> Column:
    return m * 1e6


def mils(m: Column) -> Column:
    return m / 25.4e-6


def ounces(m: Column) -> Column:
    """Copper weight in ounces a square foot of a foil."""
    return m / OUNCE_M


def amps_per_mm2(j: Column) -> Column:
    """A/m^2 to A/mm^2."""
    return j * 1e-6


def resistivity(conductivity: Column) -> Column:
    return F.lit(1.0) / conductivity


def conductivity_at(conductivity: Column, tcr: Column, reference_k: Column, temperature_k: Column) -> Column:
    """Conductivity at a temperature by the linear coefficient; a scale that is not positive is an error.

    Without a coefficient or a temperature the value stays as it is.
    """
    scale = F.lit(1.0) + tcr * (temperature_k - reference_k)
    at = F.when(scale > 0, conductivity / scale).otherwise(F.raise_error(F.lit("temperature is outside the linear range")).cast("double"))
    return F.when(tcr.isNull() | temperature_k.isNull(), conductivity).otherwise(at)


def sheet_conductance(conductivity: Column, thickness: Column) -> Column:
    return conductivity * thickness


def barrel_area(inner_diameter: Column, plating: Column) -> Column:
    """Cross-section of a plated barrel, the exact annulus; an error if a part is unknown or not positive."""
    inner = inner_diameter / 2
    outer = inner + plating
    area = F.lit(math.pi) * (outer * outer - inner * inner)
    known = (inner_diameter > 0) & (plating > 0)
    return F.when(known, area).otherwise(F.raise_error(F.lit("barrel geometry is unknown")).cast("double"))


def barrel(finished: Column, drill: Column, plating: Column, study_plating: Column) -> Column:
    """struct(radius, area, assumed): the via's own plating before the study's; the finished hole before the drill.

    A drill that plating fills is a solid cylinder.  Null if plating or both holes are unknown.
    """
    t = F.coalesce(plating, study_plating)
    inner = F.coalesce(finished / 2, drill / 2 - t)
    solid = finished.isNull() & (inner <= 0)
    outer = F.when(solid, drill / 2).otherwise(inner + t)
    hole = F.when(solid, F.lit(0.0)).otherwise(inner)
    area = F.lit(math.pi) * (outer * outer - hole * hole)
    whole = F.struct(outer.alias("radius"), area.alias("area"), (plating.isNull() & study_plating.isNotNull()).alias("assumed"))
    return F.when(t.isNotNull() & inner.isNotNull(), whole)


def format_resistance(ohm: Column) -> Column:
    """Ohms, milliohms or microohms, by size."""
    return (
        F.when(ohm >= 1, F.format_string("%.4g ohm", ohm))
        .when(ohm >= 1e-3, F.format_string("%.4g mohm", ohm * 1e3))
        .otherwise(F.format_string("%.4g uohm", ohm * 1e6))
    )


def format_engineering(value: Column, unit: str) -> Column:
    """Three decimals with the prefix G, M, k, m, u or n that brings the value into 1..1000."""
    out = F.when(value == 0, F.lit(f"0 {unit}"))
    for power, prefix in ((9, "G"), (6, "M"), (3, "k"), (0, ""), (-3, "m"), (-6, "u")):
        out = out.when(F.abs(value) >= 10.0**power, F.concat(F.format_string("%.3f", value / 10.0**power), F.lit(f" {prefix}{unit}")))
    return out.otherwise(F.concat(F.format_string("%.3f", value * 1e9), F.lit(f" n{unit}")))


def format_bytes(n: Column) -> Column:
    out = F.when(n >= 1 << 30, F.format_string("%.1f GiB", n / (1 << 30)))
    out = out.when(n >= 1 << 20, F.format_string("%.1f MiB", n / (1 << 20))).when(n >= 1 << 10, F.format_string("%.1f KiB", n / (1 << 10)))
    return out.otherwise(F.format_string("%d B", n.cast("long")))
