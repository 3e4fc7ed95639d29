"""Scalar normalisation as column expressions.

Everything stays in the JVM; `let` and the functions on words are higher-order functions, which Spark interprets. Only `unicode=True` adds an Arrow UDF
for NFKC, which Spark has no function for; the engine asks for it only where a column holds a character beyond ASCII (one aggregate tells).
"""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .udfs import nfkc

# What counts as blank text, and the business abbreviations with their long forms.
BLANKS = ("", "nan", "none", "nat")
SYNONYMS = {
    "pvt": "private",
    "priv": "private",
    "ltd": "limited",
    "co": "company",
    "corp": "corporation",
    "inc": "incorporated",
    "llp": "limited liability partnership",
}


def header(name: object) -> str:
    """Canonical column name: upper case, trimmed, without line ends (which go after trimming)."""
    return "" if name is None else str(name).upper().strip().replace("\n", "").replace("\r", "")


def field(name: object) -> str:
    """A reference to a column, which also loses double quotes."""
    return header(name).replace('"', "")


def with_canonical_headers(df: DataFrame) -> DataFrame:
    names = [header(c) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns that have the same canonical name: {', '.join(twice)}")
    return df.toDF(*names)


def quoted(name: str) -> str:
    """A reference to a column whose name may hold dots."""
    return f"`{name.replace('`', '``')}`"


def cell(df: DataFrame, name: str) -> Column:
    """The column as the text that a sheet shows: whole doubles get one decimal."""
    c, kind = df[quoted(name)], df.schema[name].dataType.typeName()
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        odd = (F.abs(c) < 1e15) & ((F.abs(c) >= 1e7) | (F.abs(c) < 1e-3))  # Spark would print an exponent
        plain = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), "0+$", "")
        return F.when(F.isnan(c), None).when(whole, F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).when(odd, plain).otherwise(c.cast("string"))
    return c.cast("string")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))), F.lit("")).isin(*BLANKS)


def _clean(c: Column, unicode: bool) -> Column:
    return nfkc(c) if unicode else c


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def expand(norm: Column) -> Column:
    """Normalised text with business abbreviations in their long forms."""
    table = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return F.array_join(F.transform(F.split(norm, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def token_key(norm: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(norm, " "), lambda t: t != "")), " ")


def normalize_text(c: Column, synonyms: bool = False, unicode: bool = False) -> Column:
    text = F.lower(_clean(c, unicode))
    for pattern in (r"[/_.\-]+", r"[^\p{L}\p{N}_\s&]", r"\s+"):
        text = F.regexp_replace(text, pattern, " ")
    text = F.when(is_blank(c), "").otherwise(F.trim(text))
    return expand(text) if synonyms else text


def compact_identifier(c: Column, unicode: bool = False) -> Column:
    return F.when(is_blank(c), "").otherwise(F.regexp_replace(F.lower(_clean(c, unicode)), "[^a-z0-9]", ""))


def tokens(c: Column, synonyms: bool = False, unicode: bool = False) -> Column:
    return F.filter(F.split(normalize_text(c, synonyms, unicode), " "), lambda t: t != "")


def sorted_token_key(c: Column, synonyms: bool = False, unicode: bool = False) -> Column:
    return F.array_join(F.array_sort(tokens(c, synonyms, unicode)), " ")


def to_number(c: Column, kind: str = "string") -> Column:
    """A double, or null: numbers as they are, booleans never, text without all but digits, signs and points."""
    if kind in ("double", "float", "integer", "long", "short", "byte") or kind.startswith("decimal"):
        number = c.cast("double")
        return F.when(~F.isnan(number), number)
    text = F.regexp_replace(c, "[, ]", "")
    text = F.when(text.rlike(r"^\((?s:.*)\)$"), F.concat(F.lit("-"), F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    text = F.regexp_replace(text, "[^0-9.+-]", "")
    return F.when(~is_blank(c), text.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(df[quoted(name)], df.schema[name].dataType.typeName())


# A day's text is digit runs and at most one month name, in any order that ranges settle, then a time and a zone if they are given.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
_HALF = r"(?:0?[1-9]|1[0-2])"
_CLOCK = (
    rf"(?:(?:\s+|(?<=\d)t)(?:{_HALF}(?::[0-5]\d){{1,2}}(?:[.,]\d{{1,9}})?\s*[ap]m|(?:[01]?\d|2[0-3])(?::[0-5]\d){{1,2}}(?:[.,]\d{{1,9}})?)"
    rf"|\s+{_HALF}\s*[ap]m|(?<=\d)t(?:[01]\d|2[0-3])(?:[0-5]\d){{0,2}})(?:\s*(?:z|utc|gmt|[+-]\d{{2}}:?\d{{2}}))?$"
)
_MONTH = "(?:" + "|".join(m[:3] for m in MONTHS) + ")"
#: How a day can begin, which most texts and numbers don't, and the shape of one without its clock.
_BEGINS = rf"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?(?:\d{{1,4}}(?:st|nd|rd|th)?[-/., ]*{_MONTH}|{_MONTH}[a-z]*[-/., ]+\d|\d{{1,4}}[-/., ]+\d|\d{{4}}$|\d{{6}}$|\d{{8}}(?:$|t|\s)|\d{{14}}$)"
_SHAPE = r"^(?:[0-9]{1,14}|[a-z]{3,9}\.?)(?:[-/., ]{1,3}(?:[0-9]{1,4}|[a-z]{3,9}\.?)){0,2}$|^[0-9]{1,2}[a-z]{3,9}[0-9]{2,4}$"
#: Days outside are none: what a 64-bit count of nanoseconds reaches.
_FIRST_DAY, _LAST_DAY = "1677-09-22", "2262-04-10"


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day; years of one or two digits lie in 1976 to 2075."""
    two = F.lpad(year, 2, "0")
    whole = F.when(F.length(year) == 4, year).when(F.length(year) <= 2, F.concat(F.when(two >= "76", "19").otherwise("20"), two))
    return F.concat_ws("-", whole, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _day_of_tokens(f: Column) -> Column:
    n, month = f["n"], f["month"]
    size, one = F.size(n), F.lit("1")
    a, b, c = (F.get(n, i) for i in range(3))
    long = lambda x: F.length(x) == 4
    number = lambda x: x.try_cast("int")
    plain = F.length(a) <= 2
    named = (
        F.when((size == 2) & (long(a) | (number(a) > 31)), _day(a, month, b)).when((size == 2) & plain, _day(b, month, a)).when((size == 1) & long(a), _day(a, month, one))
    )
    digits = (
        F.when((size == 3) & (long(a) | (plain & (number(a) > 31))), _day(a, b, c))
        .when((size == 3) & plain & (number(a) > 12), _day(c, b, a))
        .when((size == 3) & plain, _day(c, a, b))
        .when((size == 2) & long(a) & (F.length(b) <= 2), _day(a, b, one))
        .when((size == 2) & plain & long(b), _day(b, a, one))
        .when((size == 1) & F.length(a).isin(8, 14), _day(F.substring(a, 1, 4), F.substring(a, 5, 2), F.substring(a, 7, 2)))
        .when((size == 1) & (F.length(a) == 6), _day(F.substring(a, 5, 2), F.substring(a, 1, 2), F.substring(a, 3, 2)))
        .when((size == 1) & long(a), _day(a, one, one))
    )
    return F.when(f["word"] == "", digits).otherwise(F.when(month.isNotNull(), named))


def parse_date(c: Column, kind: str = "string") -> Column:
    """The day of a text, or null. Time and zone are read and dropped: the day is the one that is written.

    A four-digit run is the year. Of two short runs the first is the month if it can be, else the day. A month and a year alone
    are the first day of the month, a year alone its first day. Words for today, and times without a day, are no days.
    """
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("date")
    text = F.lower(F.trim(c.cast("string")))
    bare = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), _CLOCK, "")
    bare = F.regexp_replace(bare, r"(\d)(?:st|nd|rd|th)\b", "$1")
    table = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for k in dict.fromkeys((m, m[:3], "sept" if m[:4] == "sept" else m)) for x in (k, str(i + 1))))

    def tokens(f: Column) -> Column:
        word = F.regexp_extract(f, "[a-z]+", 0)
        return F.struct(F.regexp_extract_all(f, F.lit("[0-9]+"), F.lit(0)).alias("n"), word.alias("word"), F.try_element_at(table, word).alias("month"))

    found = let(bare, lambda t: F.when(t.rlike(_SHAPE) & ~t.rlike("[a-z][^a-z]+[a-z]"), let(tokens(t), _day_of_tokens)))
    return F.when((F.length(c.cast("string")) <= 64) & text.rlike(_BEGINS), day_in_range(found))


def day_in_range(c: Column) -> Column:
    """The day of a date or time: what parse_date makes of its text."""
    day = c.cast("date")
    return F.when(day.between(F.lit(_FIRST_DAY).cast("date"), F.lit(_LAST_DAY).cast("date")), day)


def looks_like_gstin(c: Column) -> Column:
    return F.upper(compact_identifier(c)).rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]$")


def looks_like_pan(c: Column) -> Column:
    return F.upper(compact_identifier(c)).rlike(r"^[A-Z]{5}\d{4}[A-Z]$")


def looks_like_identifier(c: Column) -> Column:
    compact = compact_identifier(c)
    return compact.rlike("[a-z]") & compact.rlike("[0-9]")


def looks_like_name(a: Column, b: Column) -> Column:
    """Both together have four to ten words and no digit."""
    return (F.size(tokens(a)) + F.size(tokens(b))).between(4, 10) & ~F.concat_ws(" ", normalize_text(a), normalize_text(b)).rlike(r"\d")


def table_name(name: str) -> str:
    cleaned = re.sub(r"[^a-zA-Z0-9_]", "", name)
    return (f"_{cleaned}" if cleaned[:1].isdigit() else cleaned)[:30] or "TableData"


def file_label(name: str) -> str:
    own = PurePath(name).name
    return re.sub(r"\.xlsx?$", "", own, flags=re.I)


def missing_sheet_name(number: int, name: str) -> str:
    return f"{'04' if number == 1 else '05'} Missing - {file_label(name)}"[:31]
