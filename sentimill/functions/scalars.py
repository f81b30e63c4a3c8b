"""Column expressions of the sentiment domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score bands from the top, and the label of what lies below the last.
BANDS = [(75.0, "very bullish"), (62.0, "bullish"), (55.0, "leaning bullish"), (46.0, "neutral"), (39.0, "leaning bearish"), (26.0, "bearish")]
LOWEST_BAND = "very bearish"
#: A tone within this of zero reads as neutral.
TONE_BAND = 0.05
#: Half-lives of news and social items in hours, least recency, recency of undated items.
NEWS_HALF_LIFE, SOCIAL_HALF_LIFE, LEAST_RECENCY, UNDATED_RECENCY = 72.0, 36.0, 0.15, 0.5


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; NaN becomes null first, as it would sort above everything."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.nanvl(x, F.lit(None).cast("double"))))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def positive(x: Column) -> Column:
    """x where it is finite and above zero, else null: zero means missing."""
    d = finite(x)
    return F.when(d > 0, d)


def points(score: Column) -> Column:
    """[-1, 1] as 0..100."""
    return (clamp(score, -1.0, 1.0) + 1.0) * 50.0


def squash(x: Column, scale: float) -> Column:
    return F.tanh(x / scale)


def band_label(score: Column) -> Column:
    """0..100 score to its band's name."""
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.when(score.isNotNull(), LOWEST_BAND)


def tone_label(tone: Column, band: float = TONE_BAND) -> Column:
    return F.when(tone > band, "bullish").when(tone < -band, "bearish").when(tone.isNotNull(), "neutral")


def lean_label(tone: Column, bullish: Column, bearish: Column, n: Column, clear: float = 0.10, lean: float = 0.10) -> Column:
    """``tone_label`` of a set of items; a small mean also needs the counts to lean its way."""
    label = tone_label(tone)
    share = (bullish - bearish) / F.when(n > 0, n)
    leans = F.when(tone > 0, share >= lean).otherwise(share <= -lean)
    return F.when((label == "neutral") | (F.abs(tone) >= clear) | (n <= 0) | leans, label).otherwise("neutral")


def fold_back(share: Column, n: Column, norm: float = 0.62, long: float = 0.85, short: float = 0.35, slope: float = 1.5, scale: float = 0.35) -> Column:
    """Signed strength of a bull share against its norm, shrunk for few tags; beyond the crowding thresholds the share folds back."""
    r = F.when(share > long, long - slope * (share - long)).when(share < short, short + 0.5 * (short - share)).otherwise(share)
    return squash((r - norm) * n / (n + 10.0), scale)


def recency(age_hours: Column, half_life: float = NEWS_HALF_LIFE) -> Column:
    """Half-life decay with a floor; undated items get a middling value."""
    return F.when(age_hours.isNull(), UNDATED_RECENCY).otherwise(F.greatest(F.lit(LEAST_RECENCY), F.pow(F.lit(0.5), age_hours / half_life)))


def short_id(*parts: Column, n: int = 12) -> Column:
    """First hex digits of SHA-1 over the parts joined by the unit separator; a null part counts as empty."""
    return F.substring(F.sha1(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, n)


def domain(url: Column) -> Column:
    """Host of a URL in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def count_of(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def blend(parts: list[tuple[Column, float]], least_weight: float = 0.6) -> Column:
    """50 plus the weighted departures from 50 of the parts that are known, over their weight or ``least_weight``; null if none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for x, w in parts:
        total = total + F.when(x.isNotNull(), (x - 50.0) * w).otherwise(0.0)
        weight = weight + F.when(x.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, 50.0 + total / F.greatest(weight, F.lit(least_weight)))
