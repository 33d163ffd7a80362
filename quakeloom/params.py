"""Parameters of the seismicity plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """m_c: completeness magnitude; b, d_f: slope and fractal dimension of the link metric; log10_eta0:
    threshold of strong links; q: how magnitude is dealt to rescaled time and distance."""

    m_c: float = 1.0
    b: float = 1.0
    d_f: float = 1.6
    log10_eta0: float = -5.468679834899335
    q: float = 0.5
    m_min: float = 1.0
    radii_km: tuple[int, ...] = (10, 25, 50, 100)
    windows_days: tuple[int, ...] = (1, 7, 30)
    horizon_hours: int = 24
    b_radius_km: int = 50
    b_window_days: float = 1095.75


#: Mean Earth radius, days of a year, km of a degree.
EARTH_KM, YEAR_SECONDS, DEGREE_KM = 6371.0088, 31557600.0, 111.32
#: Spread of clipping bounds and the count that a local b-value needs.
B_LOG10E, B_LEAST, B_MOST, B_COUNT = 0.4342944819, 0.3, 3.0, 5
EPSILON_COUNT, MONTH_DAYS, FIVE_YEARS_DAYS = 1e-5, 30.4375, 1826.25
DEFAULT = Params()
