"""Words, patterns and themes of the text scorer. Fixed values, written for this engine."""

from __future__ import annotations

#: Direction words and their strengths.
UP = {
    "beat": 2.0, "beats": 2.0, "surge": 2.2, "surges": 2.2, "soar": 2.3, "soars": 2.3, "rally": 1.8, "rallies": 1.8, "jump": 1.6, "jumps": 1.6,
    "gain": 1.3, "gains": 1.3, "rise": 1.1, "rises": 1.1, "upgrade": 2.0, "upgrades": 2.0, "upgraded": 2.0, "outperform": 1.6, "outperforms": 1.6,
    "record": 1.2, "growth": 1.0, "profit": 1.0, "profits": 1.0, "strong": 1.2, "stronger": 1.3, "robust": 1.3, "bullish": 2.2, "buy": 1.2,
    "approval": 1.5, "approves": 1.5, "wins": 1.5, "win": 1.4, "expands": 1.0, "raises": 1.4, "boosts": 1.4, "tops": 1.7, "exceeds": 1.7, "optimistic": 1.5,
    "rebound": 1.4, "rebounds": 1.4, "breakthrough": 1.8, "buyback": 1.3, "dividend": 0.6, "undervalued": 1.4, "moon": 1.6, "rocket": 1.5,
}
DOWN = {
    "miss": 2.0, "misses": 2.0, "plunge": 2.4, "plunges": 2.4, "crash": 2.5, "crashes": 2.5, "slump": 2.0, "slumps": 2.0, "tumble": 2.1, "tumbles": 2.1,
    "drop": 1.5, "drops": 1.5, "fall": 1.3, "falls": 1.3, "decline": 1.3, "declines": 1.3, "downgrade": 2.0, "downgrades": 2.0, "downgraded": 2.0,
    "underperform": 1.6, "underperforms": 1.6, "loss": 1.5, "losses": 1.5, "weak": 1.3, "weaker": 1.4, "bearish": 2.2, "sell": 1.0, "lawsuit": 1.8,
    "probe": 1.7, "fraud": 2.6, "recall": 1.6, "layoffs": 1.6, "cuts": 1.4, "bankruptcy": 2.8, "default": 2.3, "warning": 1.6, "warns": 1.6, "halts": 1.4,
    "delay": 1.2, "delays": 1.2, "overvalued": 1.4, "selloff": 1.9, "fears": 1.2, "investigation": 1.7, "fine": 1.1, "dump": 1.5,
}
NEGATORS = frozenset("not no never without hardly barely isn't aren't wasn't don't doesn't didn't won't can't cannot fails failed".split())
STRONGER = {"very": 1.3, "sharply": 1.4, "strongly": 1.3, "massively": 1.5, "significantly": 1.3, "huge": 1.4, "biggest": 1.3}
WEAKER = {"slightly": 0.6, "somewhat": 0.7, "may": 0.7, "might": 0.6, "could": 0.7, "reportedly": 0.8, "possibly": 0.6}
CONTRAST = frozenset("but however despite although though".split())
#: Event keys, their polarity, and what states them.
EVENTS = {
    "earnings_beat": ("bull", r"\b(?:beats?|tops?|exceeds?)\b[^.]{0,40}\b(?:estimates?|expectations|consensus|earnings|profit)\b"),
    "earnings_miss": ("bear", r"\bmiss(?:es|ed)?\b[^.]{0,40}\b(?:estimates?|expectations|consensus|earnings|profit)\b"),
    "guidance_up": ("bull", r"\braises?\b[^.]{0,30}\b(?:guidance|outlook|forecast)\b"),
    "guidance_down": ("bear", r"\b(?:cuts?|lowers?|slashes)\b[^.]{0,30}\b(?:guidance|outlook|forecast)\b"),
    "upgrade": ("bull", r"\bupgrade[sd]?\b"),
    "downgrade": ("bear", r"\bdowngrade[sd]?\b"),
    "merger": ("bull", r"\b(?:acquires?|acquisition|merger|takeover|buyout)\b"),
    "buyback": ("bull", r"\b(?:buyback|repurchase)\b"),
    "dividend_up": ("bull", r"\braises?\b[^.]{0,20}\bdividend\b"),
    "dividend_cut": ("bear", r"\b(?:cuts?|suspends?)\b[^.]{0,20}\bdividend\b"),
    "lawsuit": ("bear", r"\b(?:sued|sues|lawsuit|class action)\b"),
    "probe": ("bear", r"\b(?:probe|investigation|subpoena)\b"),
    "layoffs": ("bear", r"\b(?:layoffs?|job cuts)\b"),
    "approval": ("bull", r"\b(?:approval|approves|cleared by)\b"),
    "recall": ("bear", r"\brecalls?\b"),
    "bankruptcy": ("bear", r"\b(?:bankruptcy|chapter 11|insolvency)\b"),
    "price_up": ("bull", r"\b(?:shares?|stock)\b[^.]{0,20}\b(?:surges?|soars?|jumps?|rall(?:y|ies)|rises?)\b"),
    "price_down": ("bear", r"\b(?:shares?|stock)\b[^.]{0,20}\b(?:plunges?|tumbles?|slumps?|falls?|drops?)\b"),
}
#: Themes in their fixed order, and the words that speak of them.
THEMES = {
    "earnings": "earnings revenue profit quarter results eps margin",
    "guidance": "guidance outlook forecast expects",
    "analysts": "analyst upgrade downgrade target rating",
    "deals": "merger acquisition takeover buyout stake",
    "legal": "lawsuit probe court settlement regulator",
    "products": "launch product release unveils device",
    "ai": "ai chip chips model datacenter",
    "macro": "inflation fed rates tariffs economy",
    "people": "ceo cfo resigns appoints layoffs",
    "returns": "dividend buyback repurchase",
}
STOPWORDS = frozenset(
    "the a an and or of to in on for with at by from as is are was were be been it its this that these those he she they we you i his her their our your not no but if then than so".split()
)
