"""Texts: normal forms, hashes, counts, signals, small classifiers. Column functions over built-ins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PAYWALL_PHRASES = ("subscribe", "subscription", "paywall", "premium content", "sign up", "register", "login required", "member only", "full article", "read more", "continue reading", "upgrade to premium", "unlock", "paid content")
EVERGREEN = ("how", "analysis", "explainer", "guide", "tutorial", "what is", "why", "understanding", "explained")
SYNONYMS = {
    "ceasefire": ("truce", "peace talks"),
    "armistice": ("ceasefire", "peace agreement"),
    "ai regulation": ("ai act", "artificial intelligence law", "ai law"),
    "sanction": ("sanctions", "penalties"),
    "election": ("vote", "poll"),
    "tump": ("trump",),
    "bidon": ("biden",),
    "pudin": ("putin",),
}
TREND_TERMS = {
    "politics": ("trump", "biden", "government", "congress", "election", "vote", "policy", "federal", "senate", "house"),
    "tech": ("ai", "tech", "software", "data", "app", "digital", "crypto", "bitcoin", "cyber"),
    "sports": ("nfl", "football", "basketball", "baseball", "soccer", "game", "team", "player", "league", "vs", "match"),
    "business": ("market", "stock", "company", "business", "financial", "bank", "economy", "trade", "investment"),
}
PII_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{16}\b|\b\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
}
ENTITY_PATTERNS = {
    "person": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    "organization": r"\b[A-Z][a-z]+ (?:Corp|Inc|Ltd|LLC|Company|Group|Association|Organization)\b",
    "location": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)?, [A-Z]{2}\b",
    "money": r"\$[\d,]+(?:\.\d{2})?(?:\s?(?:million|billion|trillion))?",
    "percent": r"\d+(?:\.\d+)?%",
}


#: sha256 of an empty text.
NO_TEXT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: A text is an article from so many words on; characters whose words are counted before all of a text's are.
ARTICLE_WORDS, HEAD = 200, 2_000


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(_text(text), r"\s+", " "))


def text_hash(text: Column) -> Column:
    """sha256 of the normal form; '' for a text without any."""
    return F.replace(F.sha2(normalize_text(text), 256), F.lit(NO_TEXT), F.lit(""))


def _without_clutter(text: Column) -> Column:
    """``clean_text`` before its white space is made even. An address is looked for where a word begins."""
    out = _text(text)
    for pattern, to in ((r"https?://\S+|www\.\S+", ""), (r"[@#]\w+", ""), (r"(?<!\S)\S+@\S+", ""), (r"\[.*?\]|\(.*?\)", ""), (r"\s*+[-–—]\s*", " - ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def clean_text(text: Column) -> Column:
    """Without URLs, handles, tags, addresses and bracketed parts; dashes and white space made even."""
    return normalize_text(_without_clutter(text))


def _cluttered(text: Column) -> Column:
    """Whether a text has anything that ``clean_text`` may change but white space; few have."""
    return reduce(or_, (_text(text).contains(x) for x in ("@", "#", "[", "(", "-", "–", "—", "http", "www.")))


def clean_words(text: Column) -> Column:
    """How many words ``clean_text`` leaves; a text without clutter isn't cleaned for that."""
    return F.when(_cluttered(text), word_count(_without_clutter(text))).otherwise(word_count(text))


def clean_for_hash(text: Column) -> Column:
    out = F.lower(_text(text))
    for pattern in (r"https?://\S+", r"\S+@\S+"):
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    for pattern in (r"\(.*?reuters.*?\)", r"\(.*?ap.*?\)", r"\(.*?breaking.*?\)", r"\(.*?updating.*?\)", "this story is developing.*", "this is a breaking news.*", "more details to follow.*"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(clean_for_hash(title), F.lit("|"), clean_for_hash(body)), 256)


def word_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(r"\S+"))


def reading_time(text: Column) -> Column:
    """Minutes at 200 words each, halves to the even, one at least; 0 without words."""
    return minutes(word_count(text))


def minutes(words: Column) -> Column:
    return F.greatest(F.least(words, F.lit(1)), F.bround(words / 200).cast("int"))


def paywall_signals(text: Column) -> Column:
    """(paywalled, partial, confidence, signals). Any phrase makes a text paywalled, as each phrase's signal names the paywall."""
    low, n, some = F.lower(_text(text)), word_count(text), _text(text) != ""
    phrases = F.array_compact(F.array(*(F.when(low.contains(p), f"paywall_phrase_{p.replace(' ', '_')}") for p in PAYWALL_PHRASES)))
    short = F.when(n < 50, F.array(F.lit("very_short_content"))).when(n < 100, F.array(F.lit("short_content"))).otherwise(F.array().cast("array<string>"))
    signals = F.when(~some, F.array().cast("array<string>")).otherwise(F.concat(phrases, short))
    paid = reduce(or_, (low.contains(p) for p in PAYWALL_PHRASES))
    confidence = F.when(paid, F.least(F.lit(1.0), F.size(signals) * 0.3)).when(F.size(signals) > 0, F.least(F.lit(1.0), F.size(signals) * 0.2)).otherwise(0.0)
    partial = some & ((n < 50) | (~paid & (n < 100)))
    return F.struct(paid.alias("paywalled"), partial.alias("partial"), F.round(confidence, 6).alias("confidence"), signals.alias("signals"))


def article_status(title: Column, text: Column) -> Column:
    """error without a title, partial with less than 200 words after cleaning, else stored. Of a long text without clutter the beginning is often enough."""
    begins = ~_cluttered(text) & (F.length(text) > HEAD) & (word_count(F.substring(text, 1, HEAD)) >= ARTICLE_WORDS)
    return F.when(F.trim(_text(title)) == "", "error").when(begins, "stored").when(clean_words(text) >= ARTICLE_WORDS, "stored").otherwise("partial")


def title_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two cleaned titles; 0 if either has none."""
    x, y = (F.array_distinct(F.array_remove(F.split(clean_for_hash(t), " "), "")) for t in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def freshness(published_at: Column, as_of: Column, tau_hours: float = 72.0) -> Column:
    """exp(-age / tau) within [0, 1]; 0 without a date."""
    hours = (as_of.cast("timestamp").cast("double") - published_at.cast("double")) / 3600
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-hours / tau_hours))), F.lit(0.0))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: text.contains(t))


def is_evergreen(query: Column) -> Column:
    return contains_any(F.lower(query), EVERGREEN)


def mask_pii(text: Column) -> Column:
    """Each kind in turn replaced by a mark, whatever the case."""
    out = _text(text)
    for kind, pattern in PII_PATTERNS.items():
        out = F.regexp_replace(out, f"(?i){pattern}", f"[REDACTED]_{kind.upper()}")
    return out


def detect_pii(text: Column) -> Column:
    """The kinds that a text shows."""
    return F.array_compact(F.array(*(F.when(_text(text).rlike(f"(?i){p}"), k) for k, p in PII_PATTERNS.items())))


def regex_entities(text: Column, most: int = 3) -> Column:
    """By kind, the first distinct matches in their order."""
    return F.struct(*(F.slice(F.array_distinct(F.regexp_extract_all(_text(text), F.lit(p), F.lit(0))), 1, most).alias(k) for k, p in ENTITY_PATTERNS.items()))


def relation_type(context: Column) -> Column:
    return F.when(context.rlike("invest|fund|acqui"), "influences").when(context.rlike("partner|collaborat"), "relates_to").when(context.rlike("mention|discuss|said"), "mentions").otherwise("relates_to")


def truncate_for_model(text: Column, max_tokens: int = 8191, chars: int = 4) -> Column:
    return F.substring(text, 1, max_tokens * chars)


def embed_input_text(title: Column, body: Column) -> Column:
    """The title and the first line of the body, at most 280 characters of it."""
    line = F.substring(F.split_part(F.trim(_text(body)), F.lit("\n"), F.lit(1)), 1, 280)
    return F.when((_text(title) != "") & (line != ""), F.concat(title, F.lit(". "), line)).otherwise(F.concat(_text(title), line))


def expand_query(query: Column) -> Column:
    """The query and the synonyms of the phrases in it that it doesn't have."""
    low, q = F.lower(F.trim(query)), F.trim(query)
    extra = [F.when(low.contains(k) & ~low.contains(s), s) for k, v in SYNONYMS.items() for s in v]
    return F.trim(F.concat_ws(" ", q, *extra))


def categorize_trend(keywords: Column) -> Column:
    """The first topic with a term inside the keywords, else general."""
    text = F.lower(F.array_join(keywords, " "))
    out = F.when(F.lit(False), "")
    for topic, terms in TREND_TERMS.items():
        out = out.when(contains_any(text, terms), topic)
    return out.otherwise("general")


def parse_window(window: Column) -> Column:
    """Hours of windows like 6h, 3d, 2w, 1m or 1mo, 1y; null beyond 24 h, 365 d, 52 w, 12 m, 5 y and for anything else."""
    w = F.lower(F.trim(window))
    n, unit = F.regexp_extract(w, r"^([0-9]{1,9})(mo|[hdwmy])$", 1).try_cast("int"), F.regexp_extract(w, r"^([0-9]{1,9})(mo|[hdwmy])$", 2)
    rules = {"h": (1, 24), "d": (24, 365), "w": (168, 52), "m": (720, 12), "mo": (720, 12), "y": (8760, 5)}
    out = F.when(F.lit(False), F.lit(0))
    for u, (hours, most) in rules.items():
        out = out.when((unit == u) & n.between(1, most), n * hours)
    return out


def assign_arm(user: Column, experiment: str, arms: list[tuple[str, float]]) -> Column:
    """The arm whose share of md5("user:experiment") mod 10000 a user falls into; the last one if none."""
    h = F.md5(F.concat(user.cast("string"), F.lit(f":{experiment}")))
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    at = F.aggregate(digits, F.lit(0), lambda a, x: (a * 16 + x) % 10000) / 10000
    out, edge = F.when(F.lit(False), ""), 0.0
    for name, weight in arms:
        edge += weight
        out = out.when(at < edge, name)
    return out.otherwise(arms[-1][0])


def parse_condition(condition: Column) -> Column:
    """(metric, op, threshold) of conditions like ``ctr > 0.5``; null fields for others."""
    p = r"^\s*(\w+)\s*(>=|<=|==|!=|>|<|=)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(condition, p, i), F.lit(""))
    return F.struct(part(1).alias("metric"), part(2).alias("op"), part(3).cast("double").alias("threshold"))


def eval_condition(value: Column, op: Column, threshold: Column, tolerance: float = 1e-4) -> Column:
    same = F.abs(value - threshold) < tolerance
    return F.when(op == ">", value > threshold).when(op == "<", value < threshold).when(op == ">=", value >= threshold).when(op == "<=", value <= threshold).when(op.isin("=", "=="), same).when(op == "!=", ~same).otherwise(False)


def direction(slope: Column) -> Column:
    return F.when(slope > 0.1, "up").when(slope < -0.1, "down").otherwise("flat")


def confidence_interval(slope: Column, n: Column) -> Column:
    """[0.5 - w, 0.5 + w] with w = min(|slope| / 2, 0.4) * min(n / 20, 1), within [0, 1]."""
    w = F.least(F.abs(slope) / 2, F.lit(0.4)) * F.least(n / 20, F.lit(1.0))
    return F.array(F.greatest(F.lit(0.0), 0.5 - w), F.least(F.lit(1.0), 0.5 + w))
