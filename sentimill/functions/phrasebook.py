"""What the headline reader knows: amounts, claiming rules, phrases with roles, stems. Fixed values, kept below two hundred a table."""

from __future__ import annotations

from sentimill.functions import lexicon as L

#: Tokens, in the order in which they are tried: money, per cents, cashtags, numbers, words.
SCALE = r"(?:trillion|billion|million|thousand|tln|trn|bln|mln|tn|bn|mn|[tbmk])\b"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
TOKEN = rf"[$€£]{NUMBER}(?:\s?{SCALE})?|{NUMBER}%|\$[a-z](?:[a-z.]{{0,6}}[a-z])?|{NUMBER}|[a-z][a-z0-9&'-]*[a-z0-9]|[a-z]"
#: Currency codes before a number, and the sign they stand for.
CODES = (("$", r"\b(?:usd|us\$)\s?(\d)"), ("€", r"\beur\s?(\d)"), ("£", r"\bgbp\s?(\d)"))
#: Labels before a headline and attributions in it that say nothing about the story.
LEAD = r"^(?:update\s*\d*|exclusive|breaking(?: news)?|watch|video|opinion|analysis|live|premarket|market wrap|earnings call transcript|weekly recap)\s*[:|-]\s*"
LISTING = r"\s*\((?:[a-z]{1,6}[.:]?\s?)?(?:nasdaq|nyse|nysearca|nyseamerican|amex|otc|otcmkts|tsx|lse|asx)(?:\s?:\s?[a-z.]{1,8})?\)|\s*\([a-z.]{1,8}:(?:nasdaq|nyse|ca|us)\)"

#: An amount inside a rule.
AMOUNT = rf"[$€£]?{NUMBER}(?:%|\s?{SCALE})?"
_GAP = r"\s+(?:[a-z0-9']+\s+){0,4}?"
_GRADES = "strong buy|buy|outperform|overweight|hold|neutral|equal weight|sell|underperform|underweight"
#: Claiming rules in order of priority: key, value (None: from the amounts), pattern with up to three groups.
RULES: tuple[tuple[str, float | None, str], ...] = (
    ("target_up", 1.6, rf"\b(?:raise[sd]?|lift(?:s|ed)?|hike[sd]?|boost(?:s|ed)?){_GAP}price target{_GAP}to\s+({AMOUNT})(?:\s+from\s+({AMOUNT}))?()"),
    ("target_down", -1.6, rf"\b(?:cuts?|lower(?:s|ed)?|trim(?:s|med)?|slash(?:es|ed)?){_GAP}price target{_GAP}to\s+({AMOUNT})(?:\s+from\s+({AMOUNT}))?()"),
    ("rating_up", 2.0, rf"\bupgrade[sd]?(?:{_GAP}to\s+({_GRADES})\b(?:\s+from\s+({_GRADES})\b)?)?()"),
    ("rating_down", -2.0, rf"\bdowngrade[sd]?(?:{_GAP}to\s+({_GRADES})\b(?:\s+from\s+({_GRADES})\b)?)?()"),
    ("compared", None, rf"({AMOUNT}),?\s+(?:vs\.?|versus|compared (?:to|with)|against)\s+(?:the\s+|an?\s+)?((?:consensus|estimates?|expectations?|forecasts?)\s+)?(?:of\s+)?({AMOUNT})"),
    ("moved", None, rf"\bfrom\s+({AMOUNT})()\s+to\s+({AMOUNT})"),
)
#: What every match of a rule's pattern holds, one of them at least.
NEEDED = {pattern: needed for (_, _, pattern), needed in zip(RULES, (("price target",), ("price target",), ("upgrade",), ("downgrade",), ("vs", "versus", "compared ", "against"), ("from",)), strict=True)}

DIRECTIONS = {
    "raises": 1.4, "raised": 1.4, "rises": 1.1, "rose": 1.1, "grows": 1.2, "grew": 1.2, "jumps": 1.6, "jumped": 1.6, "surges": 2.0, "surged": 2.0, "climbs": 1.2, "climbed": 1.2,
    "improves": 1.3, "improved": 1.3, "expands": 1.0, "widens": 1.0, "widened": 1.0, "increases": 1.1, "increased": 1.1, "up": 1.0, "higher": 1.0, "stronger": 1.3,
    "cuts": -1.4, "cut": -1.4, "falls": -1.3, "fell": -1.3, "drops": -1.5, "dropped": -1.5, "declines": -1.3, "declined": -1.3, "slumps": -2.0, "slumped": -2.0, "plunges": -2.4, "plunged": -2.4,
    "narrows": -1.0, "narrowed": -1.0, "shrinks": -1.2, "shrank": -1.2, "lowers": -1.4, "lowered": -1.4, "slows": -1.1, "slowed": -1.1, "decreases": -1.1, "down": -1.0, "lower": -1.0, "weaker": -1.4,
}
METRICS = {
    "revenue": 1, "revenues": 1, "sales": 1, "profit": 1, "profits": 1, "earnings": 1, "income": 1, "guidance": 1, "outlook": 1, "forecast": 1, "margin": 1, "margins": 1, "dividend": 1, "demand": 1,
    "orders": 1, "shares": 1, "stock": 1, "price target": 1, "cash flow": 1, "loss": -1, "losses": -1, "net loss": -1, "costs": -1, "debt": -1, "expenses": -1, "churn": -1, "deficit": -1, "unemployment": -1, "inventory": -1,
}
#: Phrases whose meaning isn't that of their words.
PHRASES = {
    "beats estimates": 2.2, "beats expectations": 2.2, "tops estimates": 2.0, "better than expected": 2.0, "record high": 1.8, "all time high": 1.8, "short squeeze": 1.0, "strong demand": 1.4,
    "share buyback": 1.4, "strategic partnership": 1.2, "wins contract": 1.6, "back to profit": 1.8, "turns profitable": 1.8, "misses estimates": -2.2, "misses expectations": -2.2, "miss expectations": -2.0,
    "worse than expected": -2.0, "profit warning": -2.4, "going concern": -2.6, "class action": -1.8, "chapter 11": -2.8, "record low": -1.8, "job cuts": -1.4, "accounting fraud": -2.8, "sec probe": -2.0,
    "guidance cut": -2.0, "dividend cut": -2.0, "weak demand": -1.5, "price war": -1.2, "no growth": -1.0,
}
NEGATORS = ("not", "no", "never", "without", "hardly", "isn't", "aren't", "wasn't", "don't", "doesn't", "didn't", "won't", "can't", "cannot", "fails to", "failed to", "no longer", "far from")
STRENGTHS = L.STRONGER | {"more than": 1.1, "record": 1.2}
HEDGES = L.WEAKER | {"is expected to": 0.8, "plans to": 0.8, "rumored": 0.6, "if": 0.6, "whether": 0.5, "will": 0.8, "should": 0.7, "would": 0.7}
CONTRAST = ("but", "however", "yet", "despite", "although")


def roles() -> dict[str, tuple[str, float]]:
    """Phrase to (role, value); a phrase has one role, that of the first table that names it."""
    out: dict[str, tuple[str, float]] = {}
    for role, table in (
        ("word", PHRASES), ("not", dict.fromkeys(NEGATORS, 0.0)), ("hedge", HEDGES), ("strength", STRENGTHS), ("metric", METRICS), ("direction", DIRECTIONS), ("word", L.UP), ("word", {k: -v for k, v in L.DOWN.items()}),
    ):
        for phrase, v in table.items():
            out.setdefault(phrase, (role, float(v)))
    return out


#: Irregular forms and their base words, forms that stay as they are, and final stems that the rules would confuse.
IRREGULAR = {
    "fell": "fall", "rose": "rise", "risen": "rise", "sank": "sink", "sunk": "sink", "slid": "slide", "won": "win", "bought": "buy", "sold": "sell", "led": "lead", "paid": "pay", "said": "say", "says": "say", "ran": "run",
    "grew": "grow", "grown": "grow", "took": "take", "taken": "take", "made": "make", "gave": "give", "given": "give", "left": "leave", "lost": "lose", "shook": "shake", "sought": "seek", "spent": "spend", "struck": "strike",
    "fought": "fight", "brought": "bring",
}
KEPT = ("news", "series", "analysis", "data", "media", "us", "its", "this", "has", "was", "does", "is", "always", "perhaps", "species", "chaos", "plus", "bonus", "status")
FINAL = {
    "rating": "rating", "ratings": "rating", "rated": "rating", "rate": "rate", "rates": "rate", "united": "united", "deliver": "delivery", "delivers": "delivery", "delivered": "delivery", "deliveries": "delivery", "delivery": "delivery",
}

#: Brokers as headlines spell them, and one name for each.
FIRMS = {
    "harbor street": "Harbor Street", "harbor st.": "Harbor Street", "northfield": "Northfield", "pine ridge capital": "Pine Ridge", "pine ridge": "Pine Ridge", "quayside": "Quayside", "quayside securities": "Quayside",
    "stonebridge": "Stonebridge", "windmere": "Windmere",
}
ANALYST = ("upgrade", "downgrade", "target_up", "target_down")
_RISE, _FALL = r"(?:surges?|soars?|jumps?|rall(?:y|ies)|rises?)", r"(?:plunges?|tumbles?|slumps?|falls?|drops?)"
#: Moves that have a subject of their own.
MOVER = rf"\b(?:shares?|stock)\b[^.]{{0,20}}\b(?:{_RISE}|{_FALL})\b"
#: Events in the order in which one part states them: key, polarity, pattern.
EVENTS: tuple[tuple[str, str, str], ...] = (
    *((k, p, rx) for k, (p, rx) in L.EVENTS.items() if not k.startswith("price")),
    ("target_up", "bull", r"\b(?:raise[sd]?|lift(?:s|ed)?|hike[sd]?|boost(?:s|ed)?)\b[^.]{0,40}\bprice target\b"),
    ("target_down", "bear", r"\b(?:cuts?|lower(?:s|ed)?|trim(?:s|med)?|slash(?:es|ed)?)\b[^.]{0,40}\bprice target\b"),
    ("price_up", "bull", rf"\b(?:shares?|stock)\b[^.]{{0,20}}\b{_RISE}\b|\b{_RISE}\s+\d"),
    ("price_down", "bear", rf"\b(?:shares?|stock)\b[^.]{{0,20}}\b{_FALL}\b|\b{_FALL}\s+\d"),
)
#: What makes the event after it a preview, and what makes it a fact all the same.
HYPOTHETICAL = r"\b(?:could|may|might|would|should|can|will|if|whether|ahead of|before|expected to|expects|bets? on|hopes?|awaits?|eyes|weighs?|considers?)\b"
FACT = r"\b(?:after|following|on|despite|amid)\s+(?:its|the|an?|their|this|that)?\s*(?:[a-z0-9'&.-]+\s+){0,2}$"

#: Stems that say nothing about which story a headline tells: what every market headline has. Fixed values.
GENERIC = (
    "stock shar shareholder investor market today why here what say report updat news analyst company inc corp street year week month day tim new big now still next first last best better buy sell hold "
    "ahead befor know need thing way look watch see get mak tak go com trad trader pric valu worth mov lot key right long short hug major latest recent likely set want deal plan billion million trillion"
).split()
#: Months and weekdays. Fixed values.
CALENDAR = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "monday tuesday wednesday thursday friday saturday sunday"
).split()
