"""Physical dimensions as exponent maps over the seven base dimensions, and unit texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base dimensions.
BASE = ["M", "L", "T", "I", "K", "N", "J"]
#: Units and quantities by the dimension they have.
NAMES = {
    "L1": "m meter meters metre metres", "M1": "kg kilogram kilograms", "T1": "s sec second seconds", "I1": "a amp ampere amperes", "K1": "k kelvin", "N1": "mol mole", "J1": "cd candela",
    "T-1": "hz hertz frequency", "M1L1T-2": "n newton newtons force", "M1L-1T-2": "pa pascal pressure", "M1L2T-2": "j joule joules energy", "M1L2T-3": "w watt watts power", "T1I1": "c coulomb coulombs charge",
    "M1L2T-3I-1": "v volt volts voltage", "M-1L-2T4I2": "f farad farads capacitance", "M1L2T-3I-2": "ohm ohms resistance", "M1L2T-2I-1": "wb weber", "M1T-2I-1": "t tesla", "M1L2T-2I-2": "h henry henrys inductance",
    "L1T-1": "m/s velocity speed", "L1T-2": "m/s2 m/s^2 acceleration", "": "dimensionless unitless ratio fraction rad radian radians sr steradian db decibel decibels coefficient",
}
#: Words before a name that change nothing.
PREFIXES = "normalized relative absolute mean rms peak"


def from_compact(c: Column) -> Column:
    """'M1L2T-3' as an array of exponents in the order of BASE; a base that isn't named has 0."""
    return F.array(*[F.coalesce(F.nullif(F.regexp_extract(c, rf"{b}(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0)) for b in BASE])


def to_compact(a: Column) -> Column:
    part = lambda i: F.when(a[i] != 0, F.concat(F.lit(BASE[i]), F.regexp_replace(a[i].cast("string"), r"\.0$", "")))
    return F.when(a.isNotNull(), F.concat_ws("", *[part(i) for i in range(len(BASE))]))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def power(a: Column, n: float) -> Column:
    return F.transform(a, lambda x: x * n)


def compatible(a: Column, b: Column) -> Column:
    return a == b


def parse_units(c: Column) -> Column:
    """The exponents of a named unit or quantity; null if the name is unknown, all zero if it has no dimension.

    Case, blanks around it, and what joins words ('_' and '-') don't matter, nor one word such as 'mean' before it.
    """
    table = F.create_map(*[x for d, names in NAMES.items() for u in names.split() for x in (F.lit(u), F.lit(d))])
    key = F.translate(F.lower(F.trim(c)), "_-", "  ")
    bare = F.regexp_replace(key, f"^({PREFIXES.replace(' ', '|')}) ", "")
    d = F.coalesce(F.try_element_at(table, key), F.try_element_at(table, bare))
    return F.when(d.isNotNull(), from_compact(d))


def parse_dimension_vector(c: Column) -> Column:
    """A vector text 'A0E0L1I0M1H0T-2D0' as an array in the order of BASE (A amount, E current, I intensity, H heat)."""
    names = {"M": "M", "L": "L", "T": "T", "I": "E", "K": "H", "N": "A", "J": "I"}
    num = lambda s: F.regexp_replace(s, "pt", ".").cast("double")
    return F.array(*[F.coalesce(num(F.nullif(F.regexp_extract(c, rf"{names[b]}(-?\d+(?:pt\d+)?)", 1), F.lit(""))), F.lit(0.0)) for b in BASE])


#: Symbols that a compound unit text is made of.
SYMBOLS = {"kg": "M1", "m": "L1", "s": "T1", "A": "I1", "K": "K1", "mol": "N1", "cd": "J1", "Hz": "T-1", "N": "M1L1T-2", "Pa": "M1L-1T-2", "J": "M1L2T-2", "W": "M1L2T-3", "C": "T1I1", "V": "M1L2T-3I-1"}


def infer_signature(c: Column) -> Column:
    """The exponents of a compound text such as 'kg m^2 s^-1': symbols with powers, set off by blanks or dots.

    Null if any symbol is unknown or the text is blank.
    """
    table = F.create_map(*[x for u, d in SYMBOLS.items() for x in (F.lit(u), from_compact(F.lit(d)))])
    tokens = F.filter(F.split(F.trim(c), r"[ .·]+"), lambda x: x != "")
    zero = F.array(*[F.lit(0.0)] * len(BASE))

    def one(t: Column) -> Column:
        power_ = F.coalesce(F.nullif(F.regexp_extract(t, r"\^(-?\d+)$", 1), F.lit("")).cast("double"), F.lit(1.0))
        return F.transform(F.try_element_at(table, F.regexp_extract(t, r"^([A-Za-z]+)(?:\^-?\d+)?$", 1)), lambda x: x * power_)

    return F.when(F.size(tokens) > 0, F.aggregate(tokens, zero, lambda s, t: multiply(s, one(t))))
