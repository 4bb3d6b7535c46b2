"""Scalar clean-up functions as column expressions; null stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from packetflow.functions.text import blank_to_null, squeeze, squeeze_upper, strip

#: Colour codes, answers, name suffixes, words in place of an amount.
COLOR_CODES = {"GY": "GRAY", "GR": "GREEN", "BK": "BLACK", "BL": "BLUE", "WH": "WHITE", "RD": "RED", "SL": "SILVER", "SV": "SILVER", "GL": "GOLD", "BR": "BROWN", "TN": "TAN", "YL": "YELLOW", "OR": "ORANGE", "PU": "PURPLE", "PK": "PINK", "BG": "BEIGE", "CH": "CHARCOAL"}
YES, NO = ("yes", "y", "true", "1", "x", "checked"), ("no", "n", "false", "0", "unchecked")
NAME_SUFFIXES = ("JR", "SR", "II", "III", "IV", "ESQ")
PAID_MARKERS = ("satisfied", "tax paid", "dealer paid", "already paid", "tax included", "paid by dealer", "remitted")


def first_value(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def truthy(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin(*YES), True).when(v.isin(*NO), False)


def expand_color(c: Column) -> Column:
    """The colour a code stands for, in any case; other texts as written, with single spaces."""
    codes = F.create_map(*[F.lit(x) for pair in COLOR_CODES.items() for x in pair])
    return F.coalesce(codes[squeeze_upper(c)], squeeze(c))


def normalize_vin(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def short_vin(c: Column) -> Column:
    """The last eight characters of a normalized VIN."""
    return F.right(normalize_vin(c), F.lit(8))


def fixed(x: Column, digits: int) -> Column:
    """A number with that many decimals, rounded on its exact binary value."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def money_amount(c: Column) -> Column:
    """The first number of a text without $, commas and spaces; null when it says paid or is not above zero."""
    n = F.nullif(F.regexp_extract(F.regexp_replace(c, r"[$,\s]", ""), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    return F.when(~F.lower(c).rlike("|".join(PAID_MARKERS)) & (n > 0), n)


def currency_text(c: Column) -> Column:
    """$ 1,234.50 for a number, with commas or without; other texts and those with a $ as they are; blank is null."""
    v = blank_to_null(c)
    digits = F.replace(v, F.lit(","))
    return F.when(v.startswith("$"), v).when(digits.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(F.lit("$ "), F.format_number(digits.try_cast("double"), 2))).otherwise(v)


def odometer_text(c: Column) -> Column:
    """Digits without commas and leading zeros; other texts stripped."""
    v = F.regexp_replace(strip(c), ",", "")
    return F.when(v.rlike("^[0-9]+$"), F.regexp_replace(v, "^0+(?=.)", "")).otherwise(F.nullif(strip(c), F.lit("")))


def last_name(c: Column) -> Column:
    """The last word of a name, upper case, or the one before where it is a suffix; commas part words, a lone word stays."""
    words = F.filter(F.split(squeeze_upper(F.translate(c, ",", " ")), " "), lambda w: w != "")
    suffix = F.rtrim(F.try_element_at(words, F.lit(-1)), F.lit(".")).isin(*NAME_SUFFIXES)
    return F.when((F.size(words) > 1) & suffix, F.try_element_at(words, F.lit(-2))).otherwise(F.try_element_at(words, F.lit(-1)))


def date_parts(c: Column) -> Column:
    """month, day and four-digit year of m/d/y texts; years above 30 of two digits are 19xx."""
    pattern = r"^\s*([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4}|[0-9]{2})\s*$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3).cast("int") > 30, F.lit("19")).otherwise("20"), part(3))).otherwise(part(3))
    return F.when(c.rlike(pattern), F.struct(F.lpad(part(1), 2, "0").alias("month"), F.lpad(part(2), 2, "0").alias("day"), year.alias("year")))


def license_segments(c: Column) -> Column:
    """Three cells of a licence number: 5, 5 and up to 5 letters or digits, from ten on; else null."""
    v = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(F.length(v) >= 10, F.array(F.substring(v, 1, 5), F.substring(v, 6, 5), F.substring(v, 11, 5)))


def confidence(c: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def backoff_seconds(attempt: Column, base: float, transient: Column) -> Column:
    """Delay before a retry: doubling, three times as long after a dropped connection."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt) * F.when(transient, 3).otherwise(1)
