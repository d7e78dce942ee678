"""Measurement units: conversion as plain arithmetic on columns, chosen when the query is planned."""

from __future__ import annotations

from dataclasses import dataclass

_BASE = ("m", "kg", "s", "A", "K", "mol", "cd", "sr")


@dataclass(frozen=True)
class Unit:
    """A value x in this unit is ``x * factor + shift`` in base units; ``dims`` are the exponents of the base units."""

    name: str
    title: str
    dims: tuple[int, ...]
    factor: float = 1.0
    shift: float = 0.0


def _dims(text: str) -> tuple[int, ...]:
    out = dict.fromkeys(_BASE, 0)
    for part in text.split():
        base, _, power = part.partition("^")
        out[base] += int(power or 1)
    return tuple(out.values())


# Names, factors and shifts.
_TABLE = (
    ("m", "meter", "m", 1.0, 0.0),
    ("kg", "kilogram", "kg", 1.0, 0.0),
    ("s", "second", "s", 1.0, 0.0),
    ("A", "ampere", "A", 1.0, 0.0),
    ("K", "kelvin", "K", 1.0, 0.0),
    ("mol", "mole", "mol", 1.0, 0.0),
    ("cd", "candela", "cd", 1.0, 0.0),
    ("Hz", "hertz", "s^-1", 1.0, 0.0),
    ("N", "newton", "m kg s^-2", 1.0, 0.0),
    ("Pa", "pascal", "m^-1 kg s^-2", 1.0, 0.0),
    ("J", "joule", "m^2 kg s^-2", 1.0, 0.0),
    ("W", "watt", "m^2 kg s^-3", 1.0, 0.0),
    ("C", "coulomb", "s A", 1.0, 0.0),
    ("V", "volt", "m^2 kg s^-3 A^-1", 1.0, 0.0),
    ("F", "farad", "m^-2 kg^-1 s^4 A^2", 1.0, 0.0),
    ("Ohm", "ohm", "m^2 kg s^-3 A^-2", 1.0, 0.0),
    ("S", "siemens", "m^-2 kg^-1 s^3 A^2", 1.0, 0.0),
    ("Wb", "weber", "m^2 kg s^-2 A^-1", 1.0, 0.0),
    ("T", "tesla", "kg s^-2 A^-1", 1.0, 0.0),
    ("H", "henry", "m^2 kg s^-2 A^-2", 1.0, 0.0),
    ("dC", "degree Celsius", "K", 1.0, 273.15),
    ("rad", "radian", "", 1.0, 0.0),
    ("sr", "steradian", "sr", 1.0, 0.0),
    ("lm", "lumen", "cd sr", 1.0, 0.0),
    ("lx", "lux", "cd sr m^-2", 1.0, 0.0),
    ("Bq", "becquerel", "s^-1", 1.0, 0.0),
    ("Gy", "gray", "m^2 s^-2", 1.0, 0.0),
    ("Sv", "sievert", "m^2 s^-2", 1.0, 0.0),
    ("kat", "katal", "mol s^-1", 1.0, 0.0),
    ("dm", "decimeter", "m", 1e-1, 0.0),
    ("cm", "centimeter", "m", 1e-2, 0.0),
    ("mm", "millimeter", "m", 1e-3, 0.0),
    ("mkm", "micrometer", "m", 1e-6, 0.0),
    ("nm", "nanometer", "m", 1e-9, 0.0),
    ("km", "kilometer", "m", 1e3, 0.0),
    ("in", "inch", "m", 0.0254, 0.0),
    ("ft", "foot", "m", 0.3048, 0.0),
    ("yd", "yard", "m", 0.9144, 0.0),
    ("mi", "mile", "m", 1609.344, 0.0),
    ("nmi", "nautical mile", "m", 1852.0, 0.0),
    ("au", "astronomical unit", "m", 149597870691.0, 0.0),
    ("pc", "parsec", "m", 30.85678e15, 0.0),
    ("ly", "light year", "m", 9.460730473e15, 0.0),
    ("mps", "meters per second", "m s^-1", 1.0, 0.0),
    ("kph", "kilometers per hour", "m s^-1", 1 / 3.6, 0.0),
    ("fpm", "feet per minute", "m s^-1", 0.00508, 0.0),
    ("mph", "miles per hour", "m s^-1", 0.44704, 0.0),
    ("kt", "knot", "m s^-1", 1852 / 3600, 0.0),
    ("g", "gram", "kg", 1e-3, 0.0),
    ("mg", "milligram", "kg", 1e-6, 0.0),
    ("mkg", "microgram", "kg", 1e-9, 0.0),
    ("t", "ton", "kg", 1000.0, 0.0),
    ("lb", "pound", "kg", 0.45359237, 0.0),
    ("oz", "ounce", "kg", 0.0283495231, 0.0),
    ("st", "stone", "kg", 6.35029, 0.0),
    ("m2", "square meter", "m^2", 1.0, 0.0),
    ("cm2", "square centimeter", "m^2", 1e-4, 0.0),
    ("sqin", "square inch", "m^2", 6.4516e-4, 0.0),
    ("sqft", "square foot", "m^2", 0.09290304, 0.0),
    ("ac", "acre", "m^2", 4046.873, 0.0),
    ("ha", "hectare", "m^2", 10000.0, 0.0),
    ("m3", "cubic meter", "m^3", 1.0, 0.0),
    ("l", "liter", "m^3", 1e-3, 0.0),
    ("cl", "centiliter", "m^3", 1e-5, 0.0),
    ("cm3", "cubic centimeter", "m^3", 1e-6, 0.0),
    ("cf", "cubic foot", "m^3", 0.02831685, 0.0),
    ("ci", "cubic inch", "m^3", 1.63871e-5, 0.0),
    ("floz", "fluid ounce", "m^3", 29.573531e-6, 0.0),
    ("bbl", "barrel", "m^3", 0.158987, 0.0),
    ("bu", "bushel", "m^3", 3.523907e-2, 0.0),
    ("gal", "gallon", "m^3", 3.785411784e-3, 0.0),
    ("qt", "quart", "m^3", 0.946352946e-3, 0.0),
    ("pt", "pint", "m^3", 0.473176473e-3, 0.0),
    ("b", "bar", "m^-1 kg s^-2", 1e5, 0.0),
    ("mmHg", "millimeters of mercury", "m^-1 kg s^-2", 133.3, 0.0),
    ("inHg", "inches of mercury", "m^-1 kg s^-2", 3386.38, 0.0),
    ("cal", "calorie", "m^2 kg s^-2", 4.1868, 0.0),
    ("kcal", "Calorie", "m^2 kg s^-2", 4186.8, 0.0),
    ("ct", "carat", "kg", 2e-4, 0.0),
    ("dF", "degrees Fahrenheit", "K", 0.5555555555556, 255.3722222),
)
UNITS: dict[str, Unit] = {n: Unit(n, title, _dims(d), f, s) for n, title, d, f, s in _TABLE}


class UnitMismatch(TypeError):
    """Two units of different dimensions meet."""


def _number(x: float) -> str:
    return f"{x!r}D"


def convert(sql: str, source: str | None, target: str) -> str:
    """``sql``, a value in ``source``, as an expression in ``target``; a plain number just gets the unit."""
    if source is None or source == target:
        return sql
    a, b = UNITS[source], UNITS[target]
    if a.dims != b.dims:
        raise UnitMismatch(f"{source} does not convert to {target}")
    if a.shift == b.shift:
        return f"({sql} * {_number(a.factor)} / {_number(b.factor)})"
    return f"(({sql} * {_number(a.factor)} + {_number(a.shift)} - {_number(b.shift)}) / {_number(b.factor)})"


def aligned(a: str, ua: str | None, b: str, ub: str | None) -> tuple[str, str, str | None]:
    """Both sides in one unit, that of the left if it has one."""
    if ua == ub or ua is None or ub is None:
        return a, b, ua or ub
    return a, convert(b, ub, ua), ua


def product(a: str, ua: str | None, b: str, ub: str | None, divide: bool) -> tuple[str, str | None]:
    """``a * b`` or ``a / b`` with the unit whose dimensions result; a base unit is preferred."""
    op = "/" if divide else "*"
    if ub is None or ua is None and not divide:
        return f"({a} {op} {b})", ua or ub
    x, y = UNITS[ua] if ua else Unit("", "", _dims("")), UNITS[ub]
    dims = tuple(p - q if divide else p + q for p, q in zip(x.dims, y.dims, strict=True))
    left = f"({a} * {_number(x.factor)} + {_number(x.shift)})"
    right = f"({b} * {_number(y.factor)} + {_number(y.shift)})"
    sql = f"({left} {op} {right})"
    if not any(dims):
        return sql, None
    fits = [u for u in UNITS.values() if u.dims == dims]
    if not fits:
        raise UnitMismatch(f"{ua} {op} {ub} has no unit")
    best = next((u for u in fits if u.factor == 1 and not u.shift), fits[-1])
    return (sql if best.factor == 1 and not best.shift else f"(({sql} - {_number(best.shift)}) / {_number(best.factor)})"), best.name
