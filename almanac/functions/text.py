"""Text functions as column expressions: normalising, tokens, script, language, matches with offsets, titles, slugs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: Unicode ranges of scripts, with the language that each stands for
SCRIPTS: list[tuple[str, int, int, str]] = [
    ("Hebrew", 0x0590, 0x05FF, "he"),
    ("Arabic", 0x0600, 0x06FF, "ar"),
    ("Syriac", 0x0700, 0x074F, "syc"),
    ("Devanagari", 0x0900, 0x097F, "sa"),
    ("Greek", 0x0370, 0x03FF, "el"),
    ("Coptic", 0x2C80, 0x2CFF, "cop"),
    ("Cyrillic", 0x0400, 0x04FF, "ru"),
    ("Ethiopic", 0x1200, 0x137F, "gez"),
    ("Han", 0x4E00, 0x9FFF, "zh"),
    ("Hiragana", 0x3040, 0x309F, "ja"),
    ("Katakana", 0x30A0, 0x30FF, "ja"),
    ("Hangul", 0xAC00, 0xD7AF, "ko"),
    ("Cuneiform", 0x12000, 0x123FF, "akk"),
    ("Egyptian Hieroglyphs", 0x13000, 0x1342F, "egy"),
]

# fixed values: function words of the Latin-script languages, in order of precedence
PROFILES: dict[str, list[str]] = {
    "en": ["the", "and", "of", "to", "that", "shall", "unto", "which", "with", "was"],
    "la": ["et", "in", "est", "non", "cum", "qui", "quod", "ad", "sed", "ut"],
    "fr": ["le", "la", "les", "de", "et", "que", "qui", "dans", "pour", "sera"],
    "es": ["el", "la", "los", "de", "que", "en", "por", "para", "con", "sera"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "von", "mit", "den", "wird"],
    "it": ["il", "la", "di", "che", "non", "per", "con", "sono", "nel", "una"],
    "pt": ["o", "de", "que", "para", "com", "nao", "uma", "dos", "por", "sera"],
}

# fixed values: early modern English words
ARCHAIC = ["thee", "thou", "thy", "thine", "ye", "hath", "doth", "saith", "unto", "shalt", "wilt", "cometh", "behold", "verily", "whosoever", "thereof", "wherefore"]

# fixed values: words that say nothing in retrieval
STOP_WORDS = """a an and are as at be by for from has have he her his i in is it its of on or
she that the their them there they this to was were what when which who will with
you your not but if then than so such have had do does did shall may can""".split()


def unicode_form(form: str) -> Callable[[Column], Column]:
    """NFC or NFKC. Only texts beyond the range that every form leaves alone go through Python, in Arrow batches."""

    @F.pandas_udf(StringType())
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    plain = r"^[\x{0}-\x{9F}\x{C0}-\x{FF}]*$" if form == "NFKC" else r"^[\x{0}-\x{2FF}]*$"
    # a UDF is evaluated for all rows whatever a `when` around it says, so plain texts reach it as null
    return lambda c: F.coalesce(F.when(c.rlike(plain), c), fold(F.when(~c.rlike(plain), c)))


def normalise(c: Column, fold: Callable[[Column], Column] | None = None) -> Column:
    """For storage: NFC, no control and zero-width characters, line ends as newline, blank runs as one, trimmed."""
    c = (fold or unicode_form("NFC"))(c)
    gone = F.regexp_replace(c, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    runs = F.regexp_replace(F.regexp_replace(gone, r"\r\n?", "\n"), r"[ \t]+", " ")
    clean = F.regexp_replace(F.regexp_replace(runs, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    # most texts need none of this: one test instead of five passes
    dirty = c.rlike(r"[\x{0}-\x{8}\x{B}-\x{1F}\x{7F}\x{200B}-\x{200D}\x{2060}\x{FEFF}\t]|  |\n\n\n|\A\s|\s\z")
    return F.when(dirty, clean).otherwise(c)


def matching_form(c: Column, fold: Callable[[Column], Column] | None = None) -> Column:
    """For matching: NFKC, lower case, white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower((fold or unicode_form("NFKC"))(c)), r"(?U)\s+", " "))


def tokens(matching: Column) -> Column:
    """Tokens of a text in matching form, without stop words."""
    found = F.regexp_extract_all(matching, F.lit(r"(?U)[\w\x{370}-\x{1FFF}\x{2C80}-\x{2DFF}]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def check(c: Column, limit: int = 400_000) -> Column:
    """Why a text is refused, or null."""
    return F.when(c.isNull() | (F.length(c) == 0), "empty").when(F.length(c) > limit, "too long")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), r"^-+|-+$", ""), 1, 80)


def title(c: Column, limit: int = 80) -> Column:
    """The first characters of a text, cut at a word where it is longer."""
    head = F.trim(F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, limit))
    cut = F.when(F.length(c) > limit, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))).otherwise(head)
    return F.when(F.length(cut) > 0, cut).otherwise("Untitled")


def excerpt(c: Column, limit: int = 12_000) -> Column:
    """A long text without its middle: two thirds of the limit from its start, the rest from its end."""
    head = limit * 2 // 3
    note = F.format_string("\n\n[... %d characters left out ...]\n\n", F.length(c) - limit)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), note, F.right(c, F.lit(limit - head))))


def script_counts(c: Column) -> Column:
    """Letters of each script, as an array of (n, order, script) for the scripts that occur."""
    count = lambda r: F.regexp_count(c, F.lit(r))
    parts = [F.struct(count(r"[\p{L}&&[\x{0}-\x{24F}]]").alias("n"), F.lit(0).alias("place"), F.lit("Latin").alias("script"))]
    for k, (name, lo, hi, _) in enumerate(SCRIPTS):
        parts.append(F.struct(count(rf"[\p{{L}}&&[\x{{{lo:X}}}-\x{{{hi:X}}}]]").alias("n"), F.lit(-k - 1).alias("place"), F.lit(name).alias("script")))
    # one test decides whether any other script than Latin needs counting
    counted = F.when(c.rlike(r"[\p{L}&&[^\x{0}-\x{24F}]]"), F.array(*parts)).otherwise(F.array(parts[0]))
    return F.filter(counted, lambda x: x["n"] > 0)


def script(counts: Column) -> Column:
    """The script with most letters; on ties Latin, then the order of SCRIPTS."""
    return F.coalesce(F.array_max(counts)["script"], F.lit("Unknown"))


def language(c: Column) -> Column:
    """code, script, confidence, register of a text: by script, or by function words of Latin-script languages."""
    telling = sorted({w for ws in PROFILES.values() for w in ws} | set(ARCHAIC))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0)), lambda w: w.isin(telling)))

    def judge(x: Column) -> Column:
        counts, own = x["counts"], x["words"]
        name = script(counts)
        share = F.array_max(counts)["n"] / F.aggregate(counts, F.lit(0), lambda a, y: a + y["n"])
        hits = [F.struct(F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))).alias("n"), F.lit(-k).alias("place"), F.lit(code).alias("code")) for k, (code, ws) in enumerate(PROFILES.items())]
        best = F.array_max(F.array(*hits))
        other = F.create_map(*[F.lit(y) for s in SCRIPTS for y in (s[0], s[3])])[name]
        archaic = F.size(F.array_intersect(own, F.array(*map(F.lit, ARCHAIC))))
        latin = F.when(best["n"] / 10 < 0.15, F.lit("und")).otherwise(best["code"])
        sure = F.when(best["n"] / 10 < 0.15, F.lit(0.25)).otherwise(F.least(F.lit(0.92), 0.4 + best["n"] / 10 * 2))
        return F.struct(
            F.coalesce(other, latin).alias("code"),
            name.alias("script"),
            F.round(F.when(other.isNotNull(), F.least(F.lit(0.9), 0.5 + share * 0.45)).otherwise(sure), 3).alias("confidence"),
            F.when(other.isNull() & (best["code"] == "en") & (archaic >= 2) & (latin != "und"), F.lit("Early Modern English")).alias("register"),
        )

    return F.transform(F.array(F.struct(script_counts(c).alias("counts"), words.alias("words"))), judge)[0]
