"""Names and years as column functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinloom.functions.text import display_name, normalize_quotes

# Words that are no part of a name, and the value of letters in years.
HONORIFICS = (
    "הרב", "רבי", "ר'", "הרה\"ח", "הרה\"ג", "הרה\"ק", "הרה\"צ", "הגה\"ח", "הגה\"ק", "הגה\"צ", "הגאון", "החסיד",
    "הר\"ר", "מוהר\"ר", "הרבנית", "מרת", "כ\"ק", "אדמו\"ר", "הרבי", "רבינו", "הצדיק", "התמים", "השליח", "המשפיע",
    "הבחור", "גב'", "הגברת", "מר", "ד\"ר", "פרופ'", "הרה\"ת", "המקובל", "הדיין", "האדמו\"ר",
)
SUFFIXES = (
    "ז\"ל", "זצ\"ל", "זצוק\"ל", "זי\"ע", "ע\"ה", "הי\"ד", "נ\"ע", "שליט\"א", "שיחי'", "שי'", "תחי'", "שתחי'",
    "זצוקללה\"ה", "נבג\"מ", "זיע\"א", "יבלחט\"א", "יבדל\"א", "שיבדל\"א", "הכ\"מ",
)
LETTER_VALUES = {
    "א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ז": 7, "ח": 8, "ט": 9, "י": 10, "כ": 20, "ך": 20, "ל": 30, "מ": 40, "ם": 40, "נ": 50, "ן": 50,
    "ס": 60, "ע": 70, "פ": 80, "ף": 80, "צ": 90, "ץ": 90, "ק": 100, "ר": 200, "ש": 300, "ת": 400,
}


def _without(words: Column, drop: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(*drop))


def name_words(name: Column) -> Column:
    """Words of a name without titles before and blessings after it."""
    return _without(F.split(normalize_quotes(display_name(name)), r"\s+"), HONORIFICS + SUFFIXES)


def surname_of(name: Column) -> Column:
    """The last word, if there are two; a place of origin in the last of three words or more is none."""
    w = name_words(name)
    n = F.size(w)
    last, before = F.try_element_at(w, F.lit(-1)), F.try_element_at(w, F.lit(-2))
    place = last.startswith("מ") & (n >= 3) & ~before.isin("בן", "בת")
    return F.when((n < 2) | place, "").otherwise(last)


def alias_key(name: Column) -> Column:
    return F.array_join(name_words(name), " ")


def mention_surname(name: Column) -> Column:
    """Surname of an unlinked name: the last word, if there are two without titles."""
    w = _without(F.split(normalize_quotes(F.coalesce(name, F.lit(""))), r"\s+"), HONORIFICS)
    return F.when(F.size(w) >= 2, F.element_at(w, -1)).otherwise("")


def plain_surname(surname: Column) -> Column:
    """Spelling of a surname that is compared: an alef at the end of five letters or more goes."""
    return F.when((F.length(surname) >= 5) & surname.endswith("א"), F.left(surname, F.length(surname) - 1)).otherwise(surname)


def key_words(name: Column) -> Column:
    """Words that are compared: hyphens part words, signs at their ends, titles and blessings go, the last of two or more
    is spelled as ``plain_surname`` does. What stands in parentheses stays."""
    parts = F.split(F.replace(normalize_quotes(F.coalesce(name, F.lit(""))), F.lit("-"), F.lit(" ")), r"\s+")
    parts = F.transform(parts, lambda w: F.regexp_replace(w, r"^[(),.;:'\"]+|[(),.;:'\"]+$", ""))
    w = _without(parts, HONORIFICS + SUFFIXES)
    last = plain_surname(F.try_element_at(w, F.lit(-1)))
    return F.when(F.size(w) >= 2, F.concat(F.slice(w, F.lit(1), F.size(w) - 1), F.array(last))).otherwise(w)


def name_key(name: Column) -> Column:
    """``key_words``, joined."""
    return F.array_join(key_words(name), " ")


def given_part(name: Column) -> Column:
    """``name_key`` of the name up to the maiden name."""
    return name_key(F.split(name, r"\s+לבית\s+", 2)[0])


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; an edit distance does not give the same."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def shared_letters(a: Column, b: Column) -> Column:
    """How many letters two texts have in common, each as often as both have it."""
    each = F.array_distinct(F.split(a, ""))
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    return F.aggregate(each, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def names_may_match(a: Column, b: Column, ratio: float = 0.85) -> Column:
    """False only for names that ``names_match`` denies: matching blocks have no more letters than both texts share, and no
    more than the shorter one, which bounds the similarity. Without Python."""
    x, y = given_part(a), given_part(b)
    total = F.length(x) + F.length(y)
    long_enough = 2 * F.least(F.length(x), F.length(y)) >= ratio * total
    return names_match_plain(a, b) | F.when(long_enough, 2 * shared_letters(x, y) >= ratio * total).otherwise(False)


def names_match_plain(a: Column, b: Column) -> Column:
    """Equal, one the beginning of the other, or equal ends with one's words among the other's."""
    x, y = given_part(a), given_part(b)
    wx, wy = F.split(x, " "), F.split(y, " ")
    some = (F.length(x) > 0) & (F.length(y) > 0)
    begins = F.concat(x, F.lit(" ")).startswith(F.concat(y, F.lit(" "))) | F.concat(y, F.lit(" ")).startswith(F.concat(x, F.lit(" ")))
    ends = (F.get(wx, F.lit(0)) == F.get(wy, F.lit(0))) & (F.element_at(wx, -1) == F.element_at(wy, -1))
    inside = (F.size(F.array_except(wx, wy)) == 0) | (F.size(F.array_except(wy, wx)) == 0)
    return some & ((x == y) | begins | (ends & inside & (F.size(wx) > 1) & (F.size(wy) > 1)))


def names_match(a: Column, b: Column, ratio: float = 0.85, given: float = 0.7) -> Column:
    """``names_match_plain``, or similar spelling; with one surname in common, the rest must be similar as well."""
    x, y = given_part(a), given_part(b)
    some = (F.length(x) > 0) & (F.length(y) > 0)
    wx, wy = F.split(x, " "), F.split(y, " ")
    shared = (F.size(wx) > 1) & (F.size(wy) > 1) & (F.element_at(wx, -1) == F.element_at(wy, -1))
    head = lambda w: F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), " ")
    near = (match_ratio(x, y) >= ratio) & (~shared | (match_ratio(head(wx), head(wy)) >= given))
    return names_match_plain(a, b) | (some & near)


def similar_surname_plain(a: Column, b: Column, least: int = 4) -> Column:
    """Equal, or one the beginning of the other with ``least`` letters at least; the empty name is like none."""
    x, y = normalize_quotes(a), normalize_quotes(b)
    short = F.least(F.length(x), F.length(y))
    return (short > 0) & ((x == y) | ((short >= least) & (x.startswith(y) | y.startswith(x))))


def similar_surname(a: Column, b: Column, ratio: float = 0.85) -> Column:
    """``similar_surname_plain``, or similar spelling."""
    x, y = normalize_quotes(a), normalize_quotes(b)
    return similar_surname_plain(a, b) | ((F.length(x) > 0) & (F.length(y) > 0) & (match_ratio(x, y) >= ratio))


def hebrew_number(text: Column) -> Column:
    """Sum of letter values, or null if anything else is in the text."""
    value = F.create_map(*[F.lit(x) for pair in LETTER_VALUES.items() for x in pair])
    total = F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: acc + F.element_at(value, c))
    return F.when(text.rlike(f"^[{''.join(LETTER_VALUES)}]+$"), total)


def year(text: Column) -> Column:
    """Civil year of four digits or of a Hebrew year, which counts from 5000 if the thousands are left out."""
    t = normalize_quotes(text)
    n = hebrew_number(F.regexp_replace(F.replace(t, F.lit("ה'"), F.lit("")), "[\"']", ""))
    return F.when(t.rlike(r"^\d{4}$"), t.try_cast("int")).otherwise(F.when(n < 1000, n + 5000).otherwise(n) - 3760)


def year_of(born: Column, died: Column) -> Column:
    return F.coalesce(year(born), year(died))
