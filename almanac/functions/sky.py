"""Time scales, angles and the Sun's seasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import calendars as cal

# fixed values: signs of thirty degrees from the vernal point, in order
SIGNS = ["Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces"]

# fixed values: ΔT in seconds (Espenak and Meeus): from this decimal year on, the polynomial in (y - origin) / scale, lowest power first
DELTA_T: list[tuple[float, float, float, list[float]]] = [
    (-1e9, 1820, 100, [-20, 0, 32]),
    (-500, 0, 100, [10583.6, -1014.41, 33.78311, -5.952053, -0.1798452, 0.022174192, 0.0090316521]),
    (500, 1000, 100, [1574.2, -556.01, 71.23472, 0.319781, -0.8503463, -0.005050998, 0.0083572073]),
    (1600, 1600, 1, [120, -0.9808, -0.01532, 1 / 7129]),
    (1700, 1700, 1, [8.83, 0.1603, -0.0059285, 0.00013336, -1 / 1174000]),
    (1800, 1800, 1, [13.72, -0.332447, 0.0068612, 0.0041116, -0.00037436, 0.0000121272, -0.0000001699, 0.000000000875]),
    (1860, 1860, 1, [7.62, 0.5737, -0.251754, 0.01680668, -0.0004473624, 1 / 233174]),
    (1900, 1900, 1, [-2.79, 1.494119, -0.0598939, 0.0061966, -0.000197]),
    (1920, 1920, 1, [21.20, 0.84493, -0.076100, 0.0020936]),
    (1941, 1950, 1, [29.07, 0.407, -1 / 233, 1 / 2547]),
    (1961, 1975, 1, [45.45, 1.067, -1 / 260, -1 / 718]),
    (1986, 2000, 1, [63.86, 0.3345, -0.060374, 0.0017275, 0.000651814, 0.00002373599]),
    (2005, 2000, 1, [62.92, 0.32217, 0.005589]),
    (2150, 1820, 100, [-20, 0, 32]),
]

# fixed values: mean times of equinoxes and solstices (Meeus, chapter 27), years before 1000 and from 1000, lowest power first
SEASONS = ["march equinox", "june solstice", "september equinox", "december solstice"]
SEASONS_EARLY = [
    [1721139.29189, 365242.13740, 0.06134, 0.00111, -0.00071],
    [1721233.25401, 365241.72562, -0.05323, 0.00907, 0.00025],
    [1721325.70455, 365242.49558, -0.11677, -0.00297, 0.00074],
    [1721414.39987, 365242.88257, -0.00769, -0.00933, -0.00006],
]
SEASONS_LATE = [
    [2451623.80984, 365242.37404, 0.05169, -0.00411, -0.00057],
    [2451716.56767, 365241.62603, 0.00325, 0.00888, -0.00030],
    [2451810.21715, 365242.01767, -0.11575, 0.00337, 0.00078],
    [2451900.05952, 365242.74049, -0.06223, -0.00823, 0.00032],
]
# fixed values: periodic terms of the seasons as (A, B, C)
SEASON_TERMS = [
    (485, 324.96, 1934.136), (203, 337.23, 32964.467), (199, 342.08, 20.186), (182, 27.85, 445267.112), (156, 73.14, 45036.886), (136, 171.52, 22518.443),
    (77, 222.54, 65928.934), (74, 296.72, 3034.906), (70, 243.58, 9037.513), (58, 119.81, 33718.147), (52, 297.17, 150.678), (50, 21.02, 2281.226),
    (45, 247.54, 29929.562), (44, 325.15, 31555.956), (29, 60.93, 4443.417), (18, 155.12, 67555.328), (17, 288.79, 4562.452), (16, 198.04, 62894.029),
    (14, 199.76, 31436.921), (12, 95.39, 14577.848), (12, 287.11, 31931.756), (12, 320.81, 34777.259), (9, 227.73, 1222.114), (8, 15.45, 16859.074),
]


def horner(x: Column, powers: list[float]) -> Column:
    out = F.lit(float(powers[-1]))
    for p in reversed(powers[:-1]):
        out = out * x + p
    return out


def decimal_year(y: Column, m: Column) -> Column:
    return y + (m - 0.5) / 12


def delta_t(year: Column) -> Column:
    """TT - UT in seconds at a decimal year."""
    out = None
    for start, origin, scale, powers in DELTA_T:
        value = horner((year - origin) / scale, powers)
        if start == 2005:  # from 2050 the long-term parabola is joined smoothly
            value = F.when(year < 2050, value).otherwise(horner((year - 1820) / 100, [-20, 0, 32]) - 0.5628 * (2150 - year))
        out = value if out is None else F.when(year >= start, value).otherwise(out)
    return out


def decimal_year_of(jd: Column) -> Column:
    return 2000 + (jd - 2451545.0) / 365.2425


def tt_to_ut(jd: Column) -> Column:
    return jd - delta_t(decimal_year_of(jd)) / 86400


def ut_to_tt(jd: Column) -> Column:
    return jd + delta_t(decimal_year_of(jd)) / 86400


def jd_of(rd: Column, hour: Column) -> Column:
    """The Julian day of an hour (0 to 24) of a day."""
    return rd - cal.JDN_OFFSET - 0.5 + hour / 24


def day_and_hour(jd: Column) -> Column:
    """Struct of the day number and the hour of a Julian day."""
    return F.struct((F.floor(jd + 0.5).cast("long") + cal.JDN_OFFSET).alias("rd"), (F.pmod(jd + 0.5, F.lit(1.0)) * 24).alias("hour"))


def centuries(jd: Column) -> Column:
    """Julian centuries from the year 2000."""
    return (jd - 2451545.0) / 36525


def wrap(degrees: Column) -> Column:
    return F.pmod(degrees.cast("double"), F.lit(360.0))


def signed(degrees: Column) -> Column:
    return wrap(degrees + 180) - 180


def separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def sign(longitude: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SIGNS)), (F.floor(wrap(longitude) / 30) + 1).cast("int"))


def season_jd(year: Column, which: int) -> Column:
    """JD (TT) of an equinox or solstice: 0 March, 1 June, 2 September, 3 December."""
    jde = F.when(year < 1000, horner(year / 1000, SEASONS_EARLY[which])).otherwise(horner((year - 2000) / 1000, SEASONS_LATE[which]))

    def corrected(j: Column) -> Column:
        t = (j - 2451545.0) / 36525
        w = F.radians(35999.373 * t - 2.47)
        total = sum((a * F.cos(F.radians(b + c * t)) for a, b, c in SEASON_TERMS[1:]), SEASON_TERMS[0][0] * F.cos(F.radians(SEASON_TERMS[0][1] + SEASON_TERMS[0][2] * t)))
        return j + 0.00001 * total / (1 + 0.0334 * F.cos(w) + 0.0007 * F.cos(2 * w))

    return cal.let(jde, corrected)
