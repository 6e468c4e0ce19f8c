"""Calendars as column expressions over the Rata Die day number (1 is 1 January of year 1, proleptic Gregorian).

Years are astronomical: 0 is 1 BCE. All divisions are floor divisions, so negative years and days are right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: offsets and epochs in Rata Die
JDN_OFFSET = -1721425
JULIAN_EPOCH = -1
HEBREW_EPOCH = -1373427
ISLAMIC_EPOCH = 227015
EGYPTIAN_EPOCH = 1448638 + JDN_OFFSET
MAYA_EPOCH = 584283 + JDN_OFFSET
COPTIC_EPOCH = 103605
ETHIOPIC_EPOCH = 2796
PERSIAN_EPOCH = 226896

# fixed values: names
MONTHS = {
    "hebrew": ["Nisan", "Iyyar", "Sivan", "Tammuz", "Av", "Elul", "Tishri", "Marheshvan", "Kislev", "Tevet", "Shevat", "Adar", "Adar II"],
    "islamic": ["Muharram", "Safar", "Rabi' al-awwal", "Rabi' al-thani", "Jumada al-awwal", "Jumada al-thani", "Rajab", "Sha'ban", "Ramadan", "Shawwal", "Dhu al-Qi'dah", "Dhu al-Hijjah"],
    "egyptian": ["Thoth", "Phaophi", "Athyr", "Choiak", "Tybi", "Mechir", "Phamenoth", "Pharmuthi", "Pachon", "Payni", "Epiphi", "Mesore", "Epagomenae"],
    "coptic": ["Thoout", "Paope", "Athor", "Koiak", "Tobe", "Meshir", "Paremotep", "Parmoute", "Pashons", "Paone", "Epep", "Mesore", "Epagomenae"],
    "ethiopic": ["Maskaram", "Teqemt", "Hedar", "Takhsas", "Ter", "Yakatit", "Magabit", "Miyazya", "Genbot", "Sane", "Hamle", "Nahase", "Paguemen"],
    "persian": ["Farvardin", "Ordibehesht", "Khordad", "Tir", "Mordad", "Shahrivar", "Mehr", "Aban", "Azar", "Dey", "Bahman", "Esfand"],
}
HAAB = ["Pop", "Uo", "Zip", "Zotz", "Tzec", "Xul", "Yaxkin", "Mol", "Chen", "Yax", "Zac", "Ceh", "Mac", "Kankin", "Muan", "Pax", "Kayab", "Cumku", "Uayeb"]
TZOLKIN = ["Imix", "Ik", "Akbal", "Kan", "Chicchan", "Cimi", "Manik", "Lamat", "Muluc", "Oc", "Chuen", "Eb", "Ben", "Ix", "Men", "Cib", "Caban", "Etznab", "Cauac", "Ahau"]
STEMS = ["Jia", "Yi", "Bing", "Ding", "Wu", "Ji", "Geng", "Xin", "Ren", "Gui"]
BRANCHES = ["Zi", "Chou", "Yin", "Mao", "Chen", "Si", "Wu", "Wei", "Shen", "You", "Xu", "Hai"]
ANIMALS = ["Rat", "Ox", "Tiger", "Rabbit", "Dragon", "Snake", "Horse", "Goat", "Monkey", "Rooster", "Dog", "Pig"]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def long(x: int | Column) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def div(a: Column, b: int) -> Column:
    """Floor division by a positive constant."""
    return F.floor((a - F.pmod(a, long(b))) / b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once."""
    return F.transform(F.array(value), body)[0]


def name_of(names: list[str], index: Column) -> Column:
    """The name at a place counted from zero."""
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def ymd(year: Column, month: Column, day: Column) -> Column:
    return F.struct(long(year).alias("year"), long(month).alias("month"), long(day).alias("day"))


def rd_of_date(date: Column) -> Column:
    return (F.datediff(date.cast("date"), F.lit("0001-01-01").cast("date")) + 1).cast("long")


def jdn(rd: Column) -> Column:
    return rd - JDN_OFFSET


def gregorian_leap(y: Column) -> Column:
    return (F.pmod(y, long(4)) == 0) & ((F.pmod(y, long(100)) != 0) | (F.pmod(y, long(400)) == 0))


def julian_leap(y: Column) -> Column:
    return F.pmod(y, long(4)) == 0


def _solar(days: Column, leap: Column, month: Column, day: Column) -> Column:
    """Day number from the days before the year and month lengths of the Roman calendars."""
    return days + div(367 * month - 362, 12) + F.when(month <= 2, 0).when(leap, -1).otherwise(-2) + day


def from_gregorian(y: Column, m: Column, d: Column) -> Column:
    p = y - 1
    return _solar(365 * p + div(p, 4) - div(p, 100) + div(p, 400), gregorian_leap(y), m, d)


def from_julian(y: Column, m: Column, d: Column) -> Column:
    p = y - 1
    return _solar(JULIAN_EPOCH - 1 + 365 * p + div(p, 4), julian_leap(y), m, d)


def _roman_date(rd: Column, year: Column, of: Callable, leap: Callable) -> Column:
    def body(y: Column) -> Column:
        prior = rd - of(y, long(1), long(1))
        shift = F.when(rd < of(y, long(3), long(1)), 0).when(leap(y), 1).otherwise(2)
        return let(div(12 * (prior + shift) + 373, 367), lambda m: ymd(y, m, rd - of(y, m, long(1)) + 1))

    return let(year, body)


def to_gregorian(rd: Column) -> Column:
    d0 = rd - 1
    d1 = F.pmod(d0, long(146097))
    d2 = F.pmod(d1, long(36524))
    n100, n1 = div(d1, 36524), div(F.pmod(d2, long(1461)), 365)
    year = 400 * div(d0, 146097) + 100 * n100 + 4 * div(d2, 1461) + n1
    return _roman_date(rd, F.when((n100 == 4) | (n1 == 4), year).otherwise(year + 1), from_gregorian, gregorian_leap)


def settled(year: Column, rd: Column, new_year: Callable[[Column], Column]) -> Column:
    """A year guessed within one, put right by the new years on either side."""
    return let(year, lambda y: F.when(new_year(y) > rd, y - 1).when(new_year(y + 1) <= rd, y + 1).otherwise(y))


def to_julian(rd: Column) -> Column:
    guess = div(4 * (rd - JULIAN_EPOCH) + 1464, 1461)
    return _roman_date(rd, settled(guess, rd, lambda y: from_julian(y, long(1), long(1))), from_julian, julian_leap)


def hebrew_leap(y: Column) -> Column:
    return F.pmod(7 * y + 1, long(19)) < 7


def _hebrew_elapsed(y: Column) -> Column:
    months = div(235 * y - 234, 19)
    parts = 12084 + 13753 * months
    return let(29 * months + div(parts, 25920), lambda d: F.when(F.pmod(3 * (d + 1), long(7)) < 3, d + 1).otherwise(d))


def hebrew_new_year(y: Column) -> Column:
    three = F.array(_hebrew_elapsed(y - 1), _hebrew_elapsed(y), _hebrew_elapsed(y + 1))
    return let(three, lambda a: HEBREW_EPOCH + a[1] + F.when(a[2] - a[1] == 356, 2).when(a[1] - a[0] == 382, 1).otherwise(0))


def hebrew_month_starts(y: Column, length: Column) -> Column:
    """Days before each month of a Hebrew year of the given length, in the order from Tishri."""
    leap = hebrew_leap(y)
    marheshvan, kislev = F.when(F.pmod(length, long(10)) == 5, 30).otherwise(29), F.when(F.pmod(length, long(10)) == 3, 29).otherwise(30)
    lengths = [F.lit(30), marheshvan, kislev, F.lit(29), F.lit(30), F.when(leap, 30).otherwise(29), F.when(leap, 29).otherwise(0), *map(F.lit, (30, 29, 30, 29, 30, 29))]
    out, total = [], long(0)
    for n in lengths:
        out.append(total)
        total = total + n
    return F.array(*out)


TISHRI_ORDER = [7, 8, 9, 10, 11, 12, 13, 1, 2, 3, 4, 5, 6]


def from_hebrew(y: Column, m: Column, d: Column) -> Column:
    def within(x: Column) -> Column:
        place = F.when(x["m"] >= 7, x["m"] - 7).otherwise(x["m"] + 6).cast("int")
        return x["ny"] + hebrew_month_starts(x["y"], x["next"] - x["ny"])[place] + x["d"] - 1

    # each argument once: they may be large expressions themselves
    with_new_years = lambda x: F.struct(x["y"].alias("y"), x["m"].alias("m"), x["d"].alias("d"), hebrew_new_year(x["y"]).alias("ny"), hebrew_new_year(x["y"] + 1).alias("next"))
    return let(let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), with_new_years), within)


def to_hebrew(rd: Column) -> Column:
    guess = F.floor((rd - HEBREW_EPOCH) * 98496 / 35975351).cast("long") + 1

    def body(y: Column) -> Column:
        both = F.struct(hebrew_new_year(y).alias("ny"), hebrew_new_year(y + 1).alias("next"))
        return let(both, lambda n: let(hebrew_month_starts(y, let(n["next"] - n["ny"], lambda x: x)), lambda s: within(s, y, rd - n["ny"])))

    def within(starts: Column, y: Column, day: Column) -> Column:
        # the last month that starts on or before the day; of two that start together (no Adar II) the later
        place = F.size(F.filter(starts, lambda x: x <= day)) - 1
        return let(place, lambda p: ymd(y, F.element_at(F.array(*map(F.lit, TISHRI_ORDER)), p + 1), day - starts[p] + 1))

    return let(settled(guess, rd, hebrew_new_year), body)


def hebrew_month(date: Column) -> Column:
    return F.when((date["month"] == 12) & hebrew_leap(date["year"]), "Adar I").otherwise(name_of(MONTHS["hebrew"], date["month"] - 1))


def from_islamic(y: Column, m: Column, d: Column) -> Column:
    return ISLAMIC_EPOCH - 1 + (y - 1) * 354 + div(3 + 11 * y, 30) + 29 * (m - 1) + div(m, 2) + d


def to_islamic(rd: Column) -> Column:
    def body(y: Column) -> Column:
        guess = F.least(long(12), div(rd - from_islamic(y, long(1), long(1)), 29) + 1)
        month = let(guess, lambda m: F.when(from_islamic(y, m, long(1)) > rd, m - 1).otherwise(m))
        return let(month, lambda m: ymd(y, m, rd - from_islamic(y, m, long(1)) + 1))

    return let(div(30 * (rd - ISLAMIC_EPOCH) + 10646, 10631), body)


def from_egyptian(y: Column, m: Column, d: Column) -> Column:
    return EGYPTIAN_EPOCH + 365 * (y - 1) + 30 * (m - 1) + d - 1


def to_egyptian(rd: Column) -> Column:
    days = rd - EGYPTIAN_EPOCH
    rest = F.pmod(days, long(365))
    return ymd(div(days, 365) + 1, div(rest, 30) + 1, F.pmod(rest, long(30)) + 1)


def _from_alexandrian(epoch: int) -> Callable:
    return lambda y, m, d: epoch - 1 + 365 * (y - 1) + div(y, 4) + 30 * (m - 1) + d


def _to_alexandrian(epoch: int) -> Callable[[Column], Column]:
    start = _from_alexandrian(epoch)

    def convert(rd: Column) -> Column:
        body = lambda y: let(rd - start(y, long(1), long(1)), lambda n: ymd(y, div(n, 30) + 1, F.pmod(n, long(30)) + 1))
        return let(div(4 * (rd - epoch) + 1463, 1461), body)

    return convert


def from_persian(y: Column, m: Column, d: Column) -> Column:
    base = F.when(y > 0, y - 474).otherwise(y - 473)
    cycle = F.pmod(base, long(2820)) + 474
    months = F.when(m <= 7, 31 * (m - 1)).otherwise(30 * (m - 1) + 6)
    return PERSIAN_EPOCH - 1 + 1029983 * div(base, 2820) + 365 * (cycle - 1) + div(31 * cycle - 5, 128) + months + d


def to_persian(rd: Column) -> Column:
    # a year is 365 days and 683 in 2820 of a day long; from the start of a cycle the guess is within one
    days = rd - from_persian(long(475), long(1), long(1))
    rest = F.pmod(days, long(1029983))
    guess = 475 + 2820 * div(days, 1029983) + F.least(long(2819), F.floor(rest * 2820 / 1029983).cast("long"))
    new_year = lambda y: from_persian(y, long(1), long(1))

    def body(y: Column) -> Column:
        n = rd - new_year(y)
        return ymd(y, F.when(n < 186, div(n, 31) + 1).otherwise(div(n - 6, 30) + 1), F.when(n < 186, F.pmod(n, long(31)) + 1).otherwise(F.pmod(n - 6, long(30)) + 1))

    return let(settled(guess, rd, new_year), body)


def from_maya(baktun: Column, katun: Column, tun: Column, uinal: Column, kin: Column, epoch: int = MAYA_EPOCH) -> Column:
    return epoch + baktun * 144000 + katun * 7200 + tun * 360 + uinal * 20 + kin


def to_maya(rd: Column, epoch: int = MAYA_EPOCH) -> Column:
    """Long Count as text; the days before the epoch count back from it in the first place."""
    n = rd - epoch
    parts = [div(n, 144000), div(F.pmod(n, long(144000)), 7200), div(F.pmod(n, long(7200)), 360), div(F.pmod(n, long(360)), 20), F.pmod(n, long(20))]
    return F.concat_ws(".", *[p.cast("long").cast("string") for p in parts])


def haab(rd: Column) -> Column:
    n = F.pmod(rd - MAYA_EPOCH + 348, long(365))
    return F.concat_ws(" ", F.pmod(n, long(20)).cast("string"), name_of(HAAB, div(n, 20)))


def tzolkin(rd: Column) -> Column:
    n = rd - MAYA_EPOCH + 159
    return F.concat_ws(" ", (F.pmod(n, long(13)) + 1).cast("string"), name_of(TZOLKIN, F.pmod(n, long(20))))


def sexagenary(year: Column) -> Column:
    i = F.pmod(year - 4, long(60))
    return F.struct((i + 1).alias("position"), name_of(STEMS, F.pmod(i, long(10))).alias("stem"), name_of(BRANCHES, F.pmod(i, long(12))).alias("branch"), name_of(ANIMALS, F.pmod(i, long(12))).alias("animal"))


def eras(year: Column) -> Column:
    """Years of other eras, each only where it is positive."""
    some = lambda y: F.when(y > 0, y)
    games = year + 776
    olympiad = F.when(year >= -775, F.concat(F.lit("Ol. "), (div(games, 4) + 1).cast("string"), F.lit("."), (F.pmod(games, long(4)) + 1).cast("string")))
    return F.struct(some(year + 753).alias("urbis_conditae"), some(year - 311).alias("seleucid"), some(year - 283).alias("martyrs"), olympiad.alias("olympiad"), some(year + 5508).alias("byzantine"))


def weekday(rd: Column) -> Column:
    return name_of(WEEKDAYS, F.pmod(rd, long(7)))


#: system -> (day number of year, month, day; year, month and day of a day number). Users may add their own.
SYSTEMS: dict[str, tuple[Callable, Callable]] = {
    "gregorian": (from_gregorian, to_gregorian),
    "julian": (from_julian, to_julian),
    "hebrew": (from_hebrew, to_hebrew),
    "islamic": (from_islamic, to_islamic),
    "egyptian": (from_egyptian, to_egyptian),
    "coptic": (_from_alexandrian(COPTIC_EPOCH), _to_alexandrian(COPTIC_EPOCH)),
    "ethiopic": (_from_alexandrian(ETHIOPIC_EPOCH), _to_alexandrian(ETHIOPIC_EPOCH)),
    "persian": (from_persian, to_persian),
}


#: Systems whose arithmetic stands for a calendar that was observed, so that a day may be off by one.
OBSERVED = ["islamic", "persian"]


def register(system: str, from_ymd: Callable, to_ymd: Callable) -> None:
    SYSTEMS[system] = (from_ymd, to_ymd)


def to_rd(system: Column, y: Column, m: Column, d: Column) -> Column:
    """The day number of a date in the named system; null for an unknown system or a month or day below 1."""
    out = F.lit(None).cast("long")
    for name, (convert, _) in SYSTEMS.items():
        out = F.when(F.lower(system) == name, convert(long(y), long(m), long(d))).otherwise(out)
    return F.when((m >= 1) & (d >= 1), out)


def year_span(system: str, y: Column) -> Column:
    """First and last day number of a year, counted from month 1 day 1."""
    convert = SYSTEMS[system][0]
    first = convert(long(y), long(1), long(1))
    return let(F.array(first, convert(long(y) + 1, long(1), long(1))), lambda a: F.struct(a[0].alias("first"), (a[1] - 1).alias("last"), (a[1] - a[0]).alias("days")))
