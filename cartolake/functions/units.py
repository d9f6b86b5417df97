"""Length and area units, and distances on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The length units and what of each goes to an inch, 39.37 of which are a metre.
INCHES_PER_METER = 39.37
LENGTH_UNITS = ["unknown", "inches", "points", "feet", "yards", "miles", "nautical_miles", "millimeters", "centimeters", "meters", "kilometers", "decimal_degrees", "decimeters"]
_METERS = {
    "inches": 1 / INCHES_PER_METER, "points": 1 / INCHES_PER_METER / 72, "feet": 12 / INCHES_PER_METER, "yards": 36 / INCHES_PER_METER, "miles": 63360 / INCHES_PER_METER,
    "nautical_miles": 12 * 6080.27 / INCHES_PER_METER, "millimeters": 0.001, "centimeters": 0.01, "decimeters": 0.1, "meters": 1.0, "kilometers": 1000.0,
}
# Square metres of the area units.
AREA_UNITS = ["unknown", "square_inches", "square_feet", "square_yards", "acres", "square_miles", "square_millimeters", "square_centimeters", "square_decimeters", "square_meters", "ares", "hectares", "square_kilometers"]
_SQUARE_METERS = {
    "square_inches": 6.4516e-4, "square_feet": 9.290304e-2, "square_yards": 8.3612736e-1, "acres": 4046.8564224, "square_miles": 2589988.11, "square_millimeters": 1e-6,
    "square_centimeters": 1e-4, "square_decimeters": 1e-2, "square_meters": 1.0, "ares": 1e2, "hectares": 1e4, "square_kilometers": 1e6,
}
AREA_OF = {u: f"square_{u}" for u in ("inches", "feet", "yards", "miles", "millimeters", "centimeters", "meters", "kilometers")}
# Metres of half the equator as degrees are converted, of a radian's half-angle, and of a degree of distance.
HALF_CIRCLE, ARC, DEGREE = 20015077.0, 12741994.0, 111194.8742964


def degrees_to_meters(degrees: Column) -> Column:
    """Along the equator; whole half circles are counted apart."""
    halves = F.floor(F.abs(degrees) / 180) * F.signum(degrees)
    angle = F.radians(degrees - halves * 180) / 2
    return halves * HALF_CIRCLE + ARC * F.abs(F.atan(F.tan(angle)))


def convert_length(value: Column, from_unit: str, to_unit: str) -> Column:
    """By way of metres; an unknown unit on either side leaves the value as it is."""
    if from_unit == to_unit or "unknown" in (from_unit, to_unit) or not {from_unit, to_unit} <= set(LENGTH_UNITS):
        return value
    meters = degrees_to_meters(value) if from_unit == "decimal_degrees" else value * _METERS[from_unit]
    return meters / (DEGREE if to_unit == "decimal_degrees" else _METERS[to_unit])


def convert_area(value: Column, from_unit: str, to_unit: str) -> Column:
    if from_unit == to_unit or not {from_unit, to_unit} <= set(_SQUARE_METERS):
        return value
    return value * (_SQUARE_METERS[from_unit] / _SQUARE_METERS[to_unit])


def area_unit(linear: Column) -> Column:
    """The area unit of a linear one, by name; unknown for those without one."""
    pairs = [F.lit(x) for kv in AREA_OF.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), linear), F.lit("unknown"))


def radians_distance(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle distance of points in radians; rounding can't take it out of the arc cosine's domain."""
    plus, minus = F.cos(lat0 + lat1), F.cos(lat0 - lat1)
    product = 0.5 * ((minus + plus) * F.cos(lon1 - lon0) + (minus - plus))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product)))


def meters_distance(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle distance in metres of points in degrees."""
    return F.degrees(radians_distance(*map(F.radians, (lat0, lon0, lat1, lon1)))) * DEGREE


def length_factor(from_unit: str, to_unit: str) -> float:
    """What a length is multiplied by; for units of fixed size."""
    if not {from_unit, to_unit} <= set(_METERS):
        return 1.0
    return _METERS[from_unit] / _METERS[to_unit]


assert math.isclose(_METERS["miles"], 5280 * 12 / 39.37)
