"""Column functions on heat: geothermometers, conduction, resource, cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_YEAR = 365.25 * 86400.0
ROCK_DENSITY = 2700.0        # kg/m3
HEAT_CAPACITY = 1000.0       # J/kg/K
REJECT_T = 90.0              # deg C
LIFETIME_YEARS = 30.0
HOURS_PER_YEAR = 8760.0

# Plant cost cases ($/kW, $/kW-yr, $/MWh, capacity factor, rate, years).
COST_CASES = {
    "base": (5000.0, 130.0, 1.10, 0.93, 0.07, 30),
    "cheap": (4000.0, 110.0, 1.10, 0.95, 0.07, 30),
    "expensive": (7500.0, 180.0, 1.10, 0.88, 0.07, 30),
}
# Policy marks.
VISION_MWE = 60_000.0
TARGET_LCOE = 45.0
INSTALLED_MWE = 3_800.0
GRID_CO2_G_PER_KWH = 386.0


def chalcedony_t(sio2: Column) -> Column:
    """Silica geothermometer, kept when 20 < T < 350."""
    t = 1032.0 / F.nullif(4.69 - F.log10(F.when(sio2 > 0, sio2)), F.lit(0.0)) - 273.15
    return F.when((t > 20) & (t < 350), t)


def nak_t(na: Column, k: Column) -> Column:
    """Na-K geothermometer, kept when 20 < T < 400."""
    ratio = F.when((na > 0) & (k > 0), na / F.nullif(k, F.lit(0.0)))
    t = 1217.0 / F.nullif(F.log10(ratio) + 1.483, F.lit(0.0)) - 273.15
    return F.when((t > 20) & (t < 400), t)


def temperature_at_depth(heat_flow: Column, depth_km: float, conductivity: float = 2.5,
                         production: float = 2.5e-6, surface: float = 15.0) -> Column:
    """Conductive temperature from heat flow in mW/m2."""
    z = depth_km * 1000.0
    return (F.lit(surface) + heat_flow * 0.001 / conductivity * z
            - F.lit(production * z * z / (2 * conductivity)))


def log1p_clip(col: Column) -> Column:
    """log(1 + max(x, 0)) (F8)."""
    return F.log1p(F.greatest(col, F.lit(0.0)))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high)))


def reservoir_t(chalc_z: Column, nak_z: Column, heat_z: Column) -> tuple[Column, Column]:
    """Reservoir temperature and where it comes from."""
    by_chemistry = (chalc_z > 1.0) | (nak_z > 1.0)
    t = F.when(by_chemistry, F.least(150.0 + 35.0 * F.greatest(chalc_z, nak_z), F.lit(280.0)))
    return (t.otherwise(clamp(80.0 + 30.0 * heat_z, 50, 220)),
            F.when(by_chemistry, "geothermometer").otherwise("heat_flow_proxy"))


def reservoir_t_from_heat_flow(heat_flow: Column) -> Column:
    """15 + 50 * hf/60 clamped to 50..220; missing or non-positive hf counts as 55."""
    hf = F.when(heat_flow > 0, heat_flow).otherwise(55.0)
    return clamp(15.0 + 50.0 * (hf / 60.0), 50, 220)


def efficiency(t: Column, cold: float = REJECT_T) -> Column:
    """45 % of Carnot, between 0 and 0.18."""
    return clamp(0.45 * (F.greatest(t - cold, F.lit(0.0)) / (t + 273.15)), 0.0, 0.18)


def volumetric_mwe(area_km2: Column, t: Column, thickness_m, recovery, conversion,
                   cold: float = REJECT_T) -> Column:
    """Recoverable electric power of a heated volume, MW."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(float(v))

    heat = (area_km2 * 1e6 * lit(thickness_m) * ROCK_DENSITY * HEAT_CAPACITY
            * F.greatest(t - cold, F.lit(0.0)))
    return heat * lit(recovery) * lit(conversion) / (LIFETIME_YEARS * SECONDS_PER_YEAR) / 1e6


def screening_mwe(area_km2: Column, t: Column) -> dict[str, Column]:
    """Point estimate and the crude low/high band."""
    return {
        "mwe": volumetric_mwe(area_km2, t, 250.0, 0.10, 0.10),
        "mwe_low": volumetric_mwe(area_km2, t - 25.0, 250.0, 0.05, 0.05),
        "mwe_high": volumetric_mwe(area_km2, t + 25.0, 250.0, 0.15, 0.15),
    }


def thermal_mw(area_km2: Column, t: Column, thickness_m: float = 250.0,
               cold: float = 15.0) -> dict[str, Column]:
    """Direct-use heat and its electric equivalent, MW."""
    heat = volumetric_mwe(area_km2, t, thickness_m, 0.10, 1.0, cold)
    return {
        "p_th_mw": heat,
        "p_th_mw_half": heat * 0.5,
        "p_th_mw_fifth": heat * 0.2,
        "p_el_mw": heat * 0.45 * (t - cold) / (t + 273.15),
    }


def capital_recovery(rate: float, years: int) -> float:
    growth = (1 + rate) ** years
    return rate * growth / (growth - 1)


def lcoe(capex: Column, fixed_om: Column, variable_om: Column, factor: Column,
         rate: Column, years: Column) -> Column:
    """Levelised cost of energy, $/MWh (F16)."""
    growth = F.pow(1 + rate, years)
    annual = rate * growth / (growth - 1) * capex
    return (annual + fixed_om) / (HOURS_PER_YEAR / 1000.0 * factor) + variable_om


def lcoe_value(case: str = "base") -> float:
    capex, fixed, variable, factor, rate, years = COST_CASES[case]
    return (capital_recovery(rate, years) * capex + fixed) / (HOURS_PER_YEAR * factor / 1000.0) + variable


def meets_target(t: Column, cost: Column) -> Column:
    """Hot enough and within 1.5 times the cost target."""
    return (t >= 180) & (cost <= TARGET_LCOE * 1.5)


def gravity_thickness(value: Column, regional: Column, m_per_mgal: float = 50.0) -> Column:
    """Basin fill from the gravity residual, m."""
    return F.greatest(F.lit(0.0), -(value - regional) * m_per_mgal)
