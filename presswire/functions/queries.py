"""Search queries: intent, operators, cues. Column functions over built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
QA_PATTERNS = (
    r"^\s*(what|how|why|difference|define|explain|meaning|definition|compare)",
    r"\b(what is|what are|how does|how do|why is|why does)\b",
    r"\b(difference between|comparison|versus|vs\.?)\b",
    r"\b(define|definition|meaning of|explanation)\b",
)
NEWS_PATTERNS = (
    r"\b(today|yesterday|this week|last week|this month)\b",
    r"\b(latest|recent|update|updates|breaking|current)\b",
    r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{1,2}",
    r"\b20[0-9]{2}\b",
    r"\b(announced|announced today|reported|happened)\b",
    r"\b(сегодня|вчера|на этой неделе|в этом месяце)\b",
    r"\b(последние|недавние|обновления|новости)\b",
)
ENTITY_PATTERNS = (
    r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    r"\b(israel|hamas|ukraine|russia|china|eu|us|uk)\b",
    r"\b(government|parliament|congress|senate|president)\b",
    r"\b(ceasefire|regulation|law|act|policy|treaty)\b",
)
OPERATORS = r"\b(site:|after:|before:)\S+"
CUE_STOP = ("the", "a", "an", "of", "and", "or", "in", "on", "for", "to", "with", "news", "update", "today", "latest")
CUE_SYNONYMS = {
    "immigration and customs enforcement": ("dhs ice", "immigration enforcement", "enforcement and removal operations", "ero", "homeland security investigations", "hsi"),
    "customs and border protection": ("cbp", "border patrol", "ports of entry"),
    "department of homeland security": ("dhs", "homeland security"),
    "supreme court": ("scotus", "supreme court of the united states"),
    "federal reserve": ("the fed", "us central bank"),
}
#: Sites that a query may ask for, and words of windows in two languages.
ALLOWED_SITES = (
    "reuters.com", "ap.org", "bbc.com", "bbc.co.uk", "cnn.com", "nytimes.com", "theguardian.com", "washingtonpost.com", "wsj.com", "bloomberg.com", "economist.com", "npr.org",
    "abcnews.go.com", "cbsnews.com", "nbcnews.com", "ft.com", "aljazeera.com", "dw.com", "europa.eu", "ec.europa.eu", "gov.uk", "whitehouse.gov", "state.gov", "defense.gov",
    "justice.gov", "un.org", "who.int", "imf.org", "worldbank.org", "techcrunch.com", "theverge.com", "arstechnica.com", "wired.com", "engadget.com", "zdnet.com", "cnet.com",
    "marketwatch.com", "cnbc.com", "forbes.com", "fortune.com", "businessinsider.com", "seekingalpha.com", "tass.ru", "ria.ru", "interfax.ru", "kommersant.ru", "vedomosti.ru", "rbc.ru",
)
WINDOW_WORDS = {"today": "24h", "yesterday": "24h", "this week": "7d", "last week": "7d", "24h": "24h", "24": "24h", "7d": "7d", "14d": "14d", "30d": "30d", "1w": "7d", "2w": "14d", "1m": "30d"}
WINDOW_WORDS_RU = {"сегодня": "24h", "вчера": "24h", "на этой неделе": "7d"}
RELATIVE_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def _hits(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(f"(?iU){p}").cast("int")
    return out


def intent(query: Column) -> Column:
    """(intent, confidence): operators make news certain; explanation alone is general; signs of news or names make news; else by length and capitals."""
    qa, news, names = _hits(F.lower(query), QA_PATTERNS), _hits(F.lower(query), NEWS_PATTERNS), _hits(query, ENTITY_PATTERNS)
    short = (F.size(F.array_remove(F.split(F.trim(query), r"\s+"), "")) <= 4) & query.rlike(r"\p{Lu}")
    operators = query.rlike(f"(?i){OPERATORS}")
    kind = F.when(operators, "news_current_events").when(qa + news + names == 0, F.when(short, "news_current_events").otherwise("general_qa")).when((qa > 0) & (news == 0) & (names == 0), "general_qa").otherwise("news_current_events")
    sure = F.when(operators, 1.0).when(qa + news + names == 0, F.when(short, 0.6).otherwise(0.5)).when((qa > 0) & (news == 0) & (names == 0), 0.9).otherwise(F.least(F.lit(0.95), 0.6 + 0.1 * (news + names)))
    return F.struct(kind.alias("intent"), F.round(sure, 6).alias("confidence"))


def time_window(query: Column) -> Column:
    """The window that words of a query name, the first of the first language that has any; else null."""
    out = []
    for words in (WINDOW_WORDS, WINDOW_WORDS_RU):
        found = F.lower(F.regexp_extract(query, "(?iU)\\b(" + "|".join(sorted(words, key=len, reverse=True)) + ")\\b", 1))
        out.append(F.element_at(F.create_map(*(F.lit(v) for pair in words.items() for v in pair)), F.nullif(found, F.lit(""))))
    return F.coalesce(*out)


def allowed_site(site: Column, allowed: tuple[str, ...] | None) -> Column:
    """A site of ``allowed``, or the longest of them that it is a sub-domain of; else null. Without a list, the site."""
    if allowed is None:
        return site
    parents = F.array(*map(F.lit, sorted(allowed, key=lambda s: (-len(s), s))))
    return F.get(F.filter(parents, lambda p: (site == p) | site.endswith(F.concat(F.lit("."), p))), 0)


def parse_search_operators(query: Column, as_of: Column, allowed: tuple[str, ...] | None = ALLOWED_SITES) -> Column:
    """(site, after, before, window, clean): a site of ``allowed``; dates as YYYY-MM-DD, YYYY/MM/DD, MM/DD/YYYY, DD.MM.YYYY or relative like 3d; the
    window that words name, which stay; the query without its operators."""
    site = F.regexp_replace(F.nullif(F.lower(F.regexp_extract(query, r"(?i)\bsite:(\S+)", 1)), F.lit("")), r"^www\.", "")

    def date(name: str) -> Column:
        raw = F.regexp_extract(query, rf"(?i)\b{name}:(\S+)", 1)
        n, unit = F.regexp_extract(raw, r"^([0-9]{1,4})([dwmy])$", 1).try_cast("int"), F.regexp_extract(raw, r"^([0-9]{1,4})([dwmy])$", 2)
        days = F.when(F.lit(False), F.lit(0))
        for u, k in RELATIVE_DAYS.items():
            days = days.when(unit == u, n * k)
        formats = [F.try_to_timestamp(raw, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM", "yyyy")]
        return F.to_date(F.coalesce(*formats, as_of - F.make_dt_interval(days)))

    clean = F.trim(F.regexp_replace(F.regexp_replace(query, r"(?i)\b(site|after|before):\S+", ""), r"\s+", " "))
    return F.struct(allowed_site(site, allowed).alias("site"), date("after").alias("after"), date("before").alias("before"), time_window(clean).alias("window"), clean.alias("clean"))


def cues(query: Column) -> Column:
    """What a relevant result may show: words, pairs and triples of words, and synonyms of phrases."""
    plain = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"[^a-z0-9/\-._\s]", " ")
    w = F.array_remove(F.split(plain, r"\s+|[/\-._]"), "")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    extra = F.array_compact(F.array(*(F.when(F.lower(query).contains(k), s) for k, v in CUE_SYNONYMS.items() for s in v)))
    return F.filter(F.array_distinct(F.concat(w, runs(2), runs(3), extra)), lambda x: (F.length(x) > 1) & ~x.isin(*CUE_STOP))
