"""Units as column expressions. Tables hold SI units; two mile factors are in use and each stays where it belongs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors.
MILES_PER_METRE, FEET_PER_METRE, MPH_PER_MS, METRES_PER_MILE = 0.000621371, 3.28084, 2.23694, 1609.34


def miles(metres: Column) -> Column:
    return metres * MILES_PER_METRE


def feet(metres: Column) -> Column:
    return metres * FEET_PER_METRE


def mph(metres_per_second: Column) -> Column:
    return metres_per_second * MPH_PER_MS


def hours(seconds: Column) -> Column:
    return seconds / 3600.0


def even(x: Column, digits: int = 0) -> Column:
    """Rounds half to even, as a double."""
    return F.bround(x.cast("double"), digits).cast("double")


def truthy(x: Column) -> Column:
    """The value where it is neither null nor zero."""
    return F.when(x != 0, x)


def fixed(x: Column, digits: int) -> Column:
    """The text with so many decimals. Doubles are first taken to fourteen decimals, then halves go up, so what division makes of a half is one too."""
    e14 = F.rint(x * 1e14)
    exact = e14.cast("long").cast("decimal(20,0)") * F.lit(Decimal("1e-14"))
    return F.when(F.abs(e14) < 9e18, F.round(exact, digits).cast(f"decimal(38,{digits})").cast("string")).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def distance_text(metres: Column, imperial: bool = False, digits: int = 1) -> Column:
    return F.concat(fixed(metres / (METRES_PER_MILE if imperial else 1000.0), digits), F.lit(" mi" if imperial else " km"))


def speed_text(metres_per_second: Column, imperial: bool = False) -> Column:
    return F.concat(fixed(metres_per_second * (2.23694 if imperial else 3.6), 1), F.lit(" mph" if imperial else " km/h"))


def temperature_text(celsius: Column, imperial: bool = False) -> Column:
    return F.concat(fixed(celsius * 9 / 5 + 32 if imperial else celsius, 0), F.lit("°F" if imperial else "°C"))


def elevation_text(metres: Column, imperial: bool = False) -> Column:
    return F.concat(fixed(metres * 3.28084 if imperial else metres, 0), F.lit(" ft" if imperial else " m"))
