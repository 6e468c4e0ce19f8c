"""Lunations: times of the phases, and eclipses at syzygies, as column expressions built from term tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sky import horner

PHASES = ["new moon", "first quarter", "full moon", "last quarter"]

# fixed values (Meeus, Astronomical Algorithms, chapter 49): coefficient, power of E, multiples of M', M, F and omega
NEW = [
    (-0.40720, 0, 1, 0, 0, 0), (0.17241, 1, 0, 1, 0, 0), (0.01608, 0, 2, 0, 0, 0), (0.01039, 0, 0, 0, 2, 0), (0.00739, 1, 1, -1, 0, 0),
    (-0.00514, 1, 1, 1, 0, 0), (0.00208, 2, 0, 2, 0, 0), (-0.00111, 0, 1, 0, -2, 0), (-0.00057, 0, 1, 0, 2, 0), (0.00056, 1, 2, 1, 0, 0),
    (-0.00042, 0, 3, 0, 0, 0), (0.00042, 1, 0, 1, 2, 0), (0.00038, 1, 0, 1, -2, 0), (-0.00024, 1, 2, -1, 0, 0), (-0.00017, 0, 0, 0, 0, 1),
    (-0.00007, 0, 1, 2, 0, 0), (0.00004, 0, 2, 0, -2, 0), (0.00004, 0, 0, 3, 0, 0), (0.00003, 0, 1, 1, -2, 0), (0.00003, 0, 2, 0, 2, 0),
    (-0.00003, 0, 1, 1, 2, 0), (0.00003, 0, 1, -1, 2, 0), (-0.00002, 0, 1, -1, -2, 0), (-0.00002, 0, 3, 1, 0, 0), (0.00002, 0, 4, 0, 0, 0),
]
FULL = [
    (-0.40614, 0, 1, 0, 0, 0), (0.17302, 1, 0, 1, 0, 0), (0.01614, 0, 2, 0, 0, 0), (0.01043, 0, 0, 0, 2, 0), (0.00734, 1, 1, -1, 0, 0),
    (-0.00515, 1, 1, 1, 0, 0), (0.00209, 2, 0, 2, 0, 0), *NEW[7:],
]
QUARTER = [
    (-0.62801, 0, 1, 0, 0, 0), (0.17172, 1, 0, 1, 0, 0), (-0.01183, 1, 1, 1, 0, 0), (0.00862, 0, 2, 0, 0, 0), (0.00804, 0, 0, 0, 2, 0),
    (0.00454, 1, 1, -1, 0, 0), (0.00204, 2, 0, 2, 0, 0), (-0.00180, 0, 1, 0, -2, 0), (-0.00070, 0, 1, 0, 2, 0), (-0.00040, 0, 3, 0, 0, 0),
    (-0.00034, 1, 2, -1, 0, 0), (0.00032, 1, 0, 1, 2, 0), (0.00032, 1, 0, 1, -2, 0), (-0.00028, 2, 1, 2, 0, 0), (0.00027, 1, 2, 1, 0, 0),
    (-0.00017, 0, 0, 0, 0, 1), (-0.00005, 0, 1, -1, -2, 0), (0.00004, 0, 2, 0, 2, 0), (-0.00004, 0, 1, 1, 2, 0), (0.00004, 0, 1, -2, 0, 0),
    (0.00003, 0, 1, 1, -2, 0), (0.00003, 0, 0, 3, 0, 0), (0.00002, 0, 2, 0, -2, 0), (0.00002, 0, 1, -1, 2, 0), (-0.00002, 0, 3, 1, 0, 0),
]
QUARTER_SHIFT = [(0.00306, 0, 0, 0, 0, 0), (-0.00038, 1, 0, 1, 0, 0), (0.00026, 0, 1, 0, 0, 0), (-0.00002, 0, 1, -1, 0, 0), (0.00002, 0, 1, 1, 0, 0), (0.00002, 0, 0, 0, 2, 0)]
# fixed values: planetary arguments as coefficient, constant, factor of k, factor of T squared
PLANETS = [
    (0.000325, 299.77, 0.107408, -0.009173), (0.000165, 251.88, 0.016321, 0), (0.000164, 251.83, 26.651886, 0), (0.000126, 349.42, 36.412478, 0),
    (0.000110, 84.66, 18.206239, 0), (0.000062, 141.74, 53.303771, 0), (0.000060, 207.14, 2.453732, 0), (0.000056, 154.84, 7.306860, 0),
    (0.000047, 34.52, 27.261239, 0), (0.000042, 207.19, 0.121824, 0), (0.000040, 291.34, 1.844379, 0), (0.000037, 161.72, 24.198154, 0),
    (0.000035, 239.56, 25.513099, 0), (0.000023, 331.55, 3.592518, 0),
]

# fixed values (chapter 54): terms of the time of greatest eclipse besides those in M' and M, with F1 for F; of P, Q and u
ECLIPSE = [
    (0.0161, 0, 2, 0, 0, 0), (-0.0097, 0, 0, 0, 2, 0), (0.0073, 1, 1, -1, 0, 0), (-0.0050, 1, 1, 1, 0, 0), (-0.0023, 0, 1, 0, -2, 0),
    (0.0021, 1, 0, 2, 0, 0), (0.0012, 0, 1, 0, 2, 0), (0.0006, 1, 2, 1, 0, 0), (-0.0004, 0, 3, 0, 0, 0), (-0.0003, 1, 0, 1, 2, 0),
    (-0.0002, 1, 0, 1, -2, 0), (-0.0002, 1, 2, -1, 0, 0), (-0.0002, 0, 0, 0, 0, 1),
]
P_TERMS = [(0.2070, 1, 0, 1, 0, 0), (0.0024, 1, 0, 2, 0, 0), (-0.0392, 0, 1, 0, 0, 0), (0.0116, 0, 2, 0, 0, 0), (-0.0073, 1, 1, 1, 0, 0), (0.0067, 1, 1, -1, 0, 0), (0.0118, 0, 0, 0, 2, 0)]
Q_TERMS = [(5.2207, 0, 0, 0, 0, 0), (-0.0048, 1, 0, 1, 0, 0), (0.0020, 1, 0, 2, 0, 0), (-0.3299, 0, 1, 0, 0, 0), (-0.0060, 1, 1, 1, 0, 0), (0.0041, 1, 1, -1, 0, 0)]
U_TERMS = [(0.0059, 0, 0, 0, 0, 0), (0.0046, 1, 0, 1, 0, 0), (-0.0182, 0, 1, 0, 0, 0), (0.0004, 0, 2, 0, 0, 0), (-0.0005, 0, 1, 1, 0, 0)]


def arguments(k: Column) -> dict[str, Column]:
    """Mean time and angles of a lunation number; degrees but for jde, t and e."""
    t = k / 1236.85
    return {
        "t": t,
        "jde": horner(t, [2451550.09766, 0, 0.00015437, -0.000000150, 0.00000000073]) + 29.530588861 * k,
        "e": horner(t, [1, -0.002516, -0.0000074]),
        "m": horner(t, [2.5534, 0, -0.0000014, -0.00000011]) + 29.10535670 * k,
        "mp": horner(t, [201.5643, 0, 0.0107582, 0.00001238, -0.000000058]) + 385.81693528 * k,
        "f": horner(t, [160.7108, 0, -0.0016118, -0.00000227, 0.000000011]) + 390.67050284 * k,
        "omega": horner(t, [124.7746, 0, 0.0020672, 0.00000215]) - 1.56375588 * k,
    }


def series(terms: list[tuple], wave, a: dict[str, Column]) -> Column:  # noqa: ANN001
    """The unrolled sum of a term table over columns mp, m, f, omega and e."""
    total = F.lit(0.0)
    for coefficient, power, *multiples in terms:
        angle = sum((n * a[x] for n, x in zip(multiples, ("mp", "m", "f", "omega"), strict=True) if n), F.lit(0.0))
        term = wave(F.radians(angle))
        for _ in range(power):
            term = term * a["e"]
        total = total + coefficient * term
    return total


def phase_correction(quarter: Column, k: Column, a: dict[str, Column]) -> Column:
    """Days from the mean to the true phase; quarter: 0 new, 1 first quarter, 2 full, 3 last quarter."""
    shift = series(QUARTER_SHIFT, F.cos, a)
    main = F.when(quarter == 0, series(NEW, F.sin, a)).when(quarter == 2, series(FULL, F.sin, a)).otherwise(series(QUARTER, F.sin, a) + F.when(quarter == 1, shift).otherwise(-shift))
    return main + sum((c * F.sin(F.radians(b + n * k + s * a["t"] * a["t"])) for c, b, n, s in PLANETS), F.lit(0.0))
