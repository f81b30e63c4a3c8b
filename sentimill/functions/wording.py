"""How numbers, dates, amounts and titles are worded, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"
#: Quotes in a minor unit, with the major one; those whose market value is quoted in the major unit.
MINOR_UNITS = {"GBp": "GBP", "GBX": "GBP", "ZAc": "ZAR", "ZAC": "ZAR", "ILA": "ILS"}
CAP_IN_MAJOR = ("GBp", "GBX")


def stance(score: Column) -> Column:
    """Of a score of 0 to 100: bullish from 55, bearish to 45, of the rounded score."""
    s = F.bround(score)
    return F.when(s >= 55, "bullish").when(s <= 45, "bearish").otherwise("neutral")


def polarity(score: Column, margin: float = 5.0) -> Column:
    """Bull or bear at least ``margin`` away from 50; neutral within and for null."""
    return F.when(score >= 50 + margin, "bull").when(score <= 50 - margin, "bear").otherwise("neutral")


def fear_greed_band(score: Column) -> Column:
    return F.when(score < 25, "Extreme Fear").when(score < 45, "Fear").when(score <= 55, "Neutral").when(score <= 75, "Greed").otherwise("Extreme Greed")


def _with_sign(value: Column, body: Column, is_zero: Column) -> Column:
    return F.when(is_zero, body).when(value > 0, F.concat(F.lit("+"), body)).otherwise(F.concat(F.lit(MINUS), body))


def signed(value: Column, digits: int = 2) -> Column:
    """A number with its sign, the minus a typographic one; what rounds to zero has none."""
    size = F.round(F.abs(value), digits)
    return _with_sign(value, F.format_string(f"%.{digits}f", size), size == 0)


def percent(value: Column, digits: int = 1) -> Column:
    """A signed per cent figure, without decimals from ten on."""
    size = F.when(F.abs(value) >= 10, F.round(F.abs(value))).otherwise(F.round(F.abs(value), digits))
    body = F.when(F.abs(value) >= 10, F.format_string("%.0f%%", size)).otherwise(F.format_string(f"%.{digits}f%%", size))
    return _with_sign(value, body, size == 0)


def trimmed(text: Column, limit: int = 140) -> Column:
    """White space folded; longer than ``limit``: cut at a word's end, an ellipsis after it."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    short = F.regexp_replace(F.regexp_replace(F.substring(t, 1, limit - 1), " [^ ]*$", ""), "[,;:-]+$", "")
    return F.when(F.length(t) > limit, F.concat(short, F.lit("…"))).otherwise(t)


def filing_label(title: Column) -> Column:
    """What stands before the first ': ' of a title; a leading 'Amended:' becomes a word after it; 'Filing' where nothing is left."""
    t = F.trim(F.regexp_replace(title, r"\s+", " "))
    amended = F.lower(t).startswith("amended:")
    rest = F.when(amended, F.trim(F.substring(t, 9, 1 << 30))).otherwise(t)
    label = F.trim(F.substring_index(rest, ": ", 1))
    return F.concat(F.when(label == "", "Filing").otherwise(label), F.when(amended, " (amended)").otherwise(""))


def filing_description(title: Column) -> Column:
    """What stands after the first ': ', null where nothing does."""
    t = F.regexp_replace(F.trim(F.regexp_replace(title, r"\s+", " ")), "(?i)^amended: ?", "")
    at = F.instr(t, ": ")
    rest = F.trim(F.substring(t, at + 2, F.length(t)))
    return F.when((at > 0) & (rest != ""), rest)


def major_currency(code: Column) -> Column:
    out = F.upper(code)
    for minor, major in MINOR_UNITS.items():
        out = F.when(code == minor, major).otherwise(out)
    return F.when(code != "", out)


def shares_outstanding(cap: Column, price: Column, code: Column) -> Column:
    """Market value by price, both in one unit; null where either is missing or the unit's use is unknown."""
    in_minor = F.coalesce(code.isin(*MINOR_UNITS), F.lit(False))
    known = ~in_minor | code.isin(*CAP_IN_MAJOR)
    return F.when((cap > 0) & (price > 0) & known, cap / F.when(in_minor, price / 100.0).otherwise(price))


def iso_currency(value: Column) -> Column:
    """A three-letter code in capitals, null for anything else."""
    t = F.upper(F.trim(value))
    return F.when(t.rlike("^[A-Z]{3}$"), t)


def noon(day: Column) -> Column:
    return F.to_timestamp(day) + F.expr("INTERVAL 12 HOURS")


def stored_time(ts: Column) -> Column:
    """UTC time of fixed width, which sorts as text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def compact_time(text: Column) -> Column:
    """yyyyMMddTHHmmss as a time, null for what isn't one."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{8}T\d{6}$"), text), F.lit("yyyyMMdd'T'HHmmss"))


def lenient_count(value: Column) -> Column:
    """A whole number of at least zero; 0 for what is none."""
    return F.greatest(F.coalesce(value.try_cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))


def is_title_case(text: Column) -> Column:
    """At least three words of over three letters, three quarters of them with a capital first."""
    long_words = F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0))
    capital = F.filter(long_words, lambda w: w.rlike("^[A-Z]"))
    return (F.size(long_words) >= 3) & (F.size(capital) >= 0.75 * F.size(long_words))


def calibrated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """A piecewise-linear map: in proportion below the first knot, level beyond the last."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots[:-1], knots[1:], strict=True))):
        out = F.when(x <= x1, (x - x0) * ((y1 - y0) / (x1 - x0)) + y0).otherwise(out)
    return F.when(x <= knots[0][0], x * (knots[0][1] / knots[0][0])).otherwise(out)


def target_direction(action: Column, target: Column, prior: Column) -> Column:
    """1 for a raise, -1 for a cut: by the action's own word, else by numbers more than a thousandth apart."""
    word = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    apart = (target > 0) & (prior > 0) & (F.abs(target / prior - 1.0) > 0.001)
    return F.when(word.startswith("raise"), 1).when(word.startswith("lower"), -1).when(apart & (target > prior), 1).when(apart, -1).otherwise(0)
