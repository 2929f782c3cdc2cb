"""What is shown of results: relevance, matches, labels, snippets, diversity; entities in texts; memory suggestions; validation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswire.functions.queries import cues
from presswire.functions.text import detect_pii
from presswire.functions.urls import host, is_valid_url
from presswire.operators.select import domain_trust
from presswire.operators.vectors import _matrix
from presswire.sources.scratch import written

#: Fixed values.
MAJOR_MEDIA = ("apnews.com", "reuters.com", "nytimes.com", "washingtonpost.com", "wsj.com", "bbc.com", "theguardian.com", "npr.org", "bloomberg.com", "axios.com", "politico.com", "ft.com")
NOISE = ("football", "soccer", "hockey", "forecast", "weather", "nhl", "odds", "bet", "coupon", "promo", "recipe", "cooking", "celebrity", "gossip", "horoscope")
URL_HINTS = ("/policy/", "/regulation", "/court", "/law", "/case", "/immigration", "/agency", "/press/")
SPAN_STOP = ("The", "This", "That", "And", "But", "For", "With", "From", "Der", "Die", "Das", "Les", "Los")


def canonical_only(index: DataFrame) -> DataFrame:
    return index.where("is_canonical").orderBy(F.col("published_at").desc_nulls_last(), "article_id")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9/\-._\s]", " ")


def soft_relevance(results: DataFrame, queries: DataFrame, k: int = 30, least: float = 0.5, articles: DataFrame | None = None) -> DataFrame:
    """Results with ``soft_score``: those of ``least`` or more, or the best k of a query if fewer pass. ``results`` may have ``entities``, an array of names.

    ``articles``: what else is in ``results``, by ``article_id``; then a text is prepared once, however many queries find it.
    """
    asked = queries.select("query_id", cues(F.col("query")).alias("cues"))
    plain = {"__t": _plain(F.col("title_norm")), "__c": _plain(F.col("clean_text")), "__u": _plain(F.col("url"))}
    r = results.withColumns(plain) if articles is None else results.join(articles.withColumns(plain), "article_id")
    r = r.join(F.broadcast(asked), "query_id")
    found = lambda c: F.size(F.filter("cues", lambda x: F.col(c).contains(x)))
    score = found("__t") * 2.5 + found("__c") * 1.5 + found("__u") * 1.0
    if "entities" in r.columns:
        names = F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.lower(e))
        score = score + 1.5 * F.size(F.filter("cues", lambda x: F.exists(names, lambda e: e.contains(x))))
    score = score + F.when(F.col("source_domain").rlike(r"\.(gov|edu)$"), 2.0).otherwise(0.0) + F.when(F.col("source_domain").isin(*MAJOR_MEDIA), 1.5).otherwise(0.0)
    # plain words are looked for one by one, and only where they count: an alternative of all of them is tried at each letter of a text
    noisy = reduce(or_, (F.col(c).contains(n) for n in NOISE for c in ("__t", "__c")))
    r = r.withColumn("__s", score)
    r = r.withColumn("soft_score", F.col("__s") - F.when((F.col("__s") < 2) & noisy, 2.0).otherwise(0.0) + F.when(F.col("__u").rlike("|".join(URL_HINTS)), 0.5).otherwise(0.0))
    w = Window.partitionBy("query_id")
    r = r.withColumns({"__n": F.count_if(F.col("soft_score") >= least).over(w), "__i": F.row_number().over(w.orderBy(F.col("soft_score").desc(), "article_id"))})
    return r.where(F.when(F.col("__n") < k, F.col("__i") <= k).otherwise(F.col("soft_score") >= least)).drop("cues", "__t", "__c", "__u", "__s", "__n", "__i")


def capitalised_spans(texts: pd.Series) -> pd.Series:
    """Runs of name-like words: capitalised, mixed case, capitals, or letters with digits; words of no weight end a run."""

    def name_like(w: str) -> bool:
        return w not in SPAN_STOP and (bool(re.match(r"[A-ZÀ-Þ]\w{2,}$", w)) or bool(re.match(r"[A-Z]{2,}$", w)) or (any(c.isdigit() for c in w) and any(c.isalpha() for c in w)))

    def one(text: str | None) -> list[str]:
        out, run = [], []
        for w in re.findall(r"\w[\w'-]*|[^\w\s]", text or ""):
            if name_like(w):
                run.append(w)
                continue
            if run:
                out.append(" ".join(run))
            run = []
        if run:
            out.append(" ".join(run))
        return list(dict.fromkeys(out))

    return texts.map(one)


def entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity, kind)."""
    spans = F.pandas_udf(capitalised_spans, "array<string>")
    e = docs.select(F.col(id_col).alias("id"), F.explode(spans(text_col)).alias("entity"))
    kind = F.when(F.col("entity").rlike(r"\b(Inc|Corp|Ltd|LLC|Company|Group)$"), "organization").when(F.col("entity").rlike(r"^[A-Z]{2,}$"), "acronym").when(F.col("entity").rlike(r"\d"), "code").when(F.col("entity").rlike(r"^\S+ \S+$"), "person").otherwise("other")
    return e.withColumn("kind", kind)


def _places(text: str, word: str) -> Iterator[int]:
    """Where ``word``, of letters, digits and _, stands alone in ``text``."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and not (text[end : end + 1].isalnum() or text[end : end + 1] == "_"):
            yield at
        at = text.find(word, at + 1)


def query_match_context(results: DataFrame, width: int = 30, most: int = 3) -> DataFrame:
    """(query_id, article_id, term, position, context): where words of the query stand in a text, the first ``most``."""

    def find(text: pd.Series, query: pd.Series) -> pd.Series:
        out, seen, low = [], None, ""
        for t, q in zip(text, query, strict=True):
            if t is not seen:
                seen, low = t, (t or "").lower()
            found = []
            for term in dict.fromkeys(re.findall(r"\w+", (q or "").lower())):
                found += [(p, term, t[max(0, p - width) : p + len(term) + width]) for p in islice(_places(low, term), most)]
            out.append([{"position": p, "term": term, "context": ctx} for p, term, ctx in sorted(found)[:most]])
        return pd.Series(out)

    spans = F.pandas_udf(find, "array<struct<position:int,term:string,context:string>>")
    return results.select("query_id", "article_id", F.explode(spans("clean_text", "query")).alias("m")).select("query_id", "article_id", "m.*")


def explain_labels(results: DataFrame) -> DataFrame:
    """Words for freshness, score and date of each result."""
    fresh = F.when(F.col("freshness") >= 0.7, "very fresh").when(F.col("freshness") >= 0.3, "recent").otherwise("older")
    match = F.when(F.col("similarity") >= 0.7, "strong match").when(F.col("similarity") >= 0.4, "fair match").otherwise("weak match")
    return results.withColumn("labels", F.array_join(F.array_compact(F.array(fresh, match, F.when(F.col("published_at").isNull(), "no date"))), "; "))


def result_snippet(results: DataFrame, width: int = 200, k: int = 10) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "article_id"))
    title = F.coalesce(F.nullif("title_norm", F.lit("")), F.lit("Untitled"))
    short = results.select("query_id", "article_id", "score", "title_norm", F.substring("clean_text", 1, width).alias("snippet"), "published_at")
    cut = short.withColumn("rank", n).where(F.col("rank") <= k)
    return cut.select("query_id", "article_id", "rank", title.alias("title"), "snippet", F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("unknown")).alias("date"))


def _closest(rows: DataFrame, block: int = 2_000) -> DataFrame:
    """(query_id, similarity): the highest cosine of two vectors (query_id, embedding, id, again) of a query that have one length.

    A vector is there once, ``again`` where several rows have it: then it is 1, and nothing is compared; else blocks of the query's vectors meet, each two once.
    """
    v = F.col("embedding")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    groups = rows.where(~F.exists(v, lambda x: x.isNull()) & (F.size(v) > 0)).withColumn("some", norm > 0)
    equal = groups.where("again").groupBy("query_id").agg(F.max(F.when(F.col("some"), 1.0).otherwise(0.0)).alias("similarity"))
    rest = groups.join(equal.where("similarity = 1").select("query_id"), "query_id", "left_anti")
    parts = rest.groupBy("query_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = rest.join(parts, "query_id").select("query_id", "id", "embedding", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("p"), "parts")
    left = dealt.select("query_id", F.col("id").alias("i"), F.col("embedding").alias("v"), "p", F.explode(F.sequence("p", F.col("parts") - 1)).alias("q"))
    right = dealt.select(F.col("query_id").alias("query_id"), F.col("id").alias("i"), F.col("embedding").alias("w"), F.explode(F.sequence(F.lit(0), "p")).alias("p"), F.col("p").alias("q"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found = -np.inf
        a, b = (x.sort_by("i") if len(x) else x for x in (a, b))  # both sides of one block in one order, for the diagonal
        for dim in set(pc.list_value_length(a["v"]).to_pylist()) if len(a) and len(b) else ():
            m, k = (_matrix(x.combine_chunks(), dim)[1] for x in (a["v"], b["w"]))
            met = m @ k.T
            if met.size and a["p"][0] == a["q"][0]:
                np.fill_diagonal(met, -np.inf)
            found = max(found, met.max(initial=-np.inf))
        own = (a if len(a) else b)["query_id"].slice(0, int(found > -np.inf))
        return pa.table({"query_id": own, "similarity": pa.array([round(found, 9)] * len(own), pa.float64())})

    by, kind = ["query_id", "p", "q"], rows.schema["query_id"].dataType.simpleString()
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, f"query_id {kind}, similarity double")
    return equal.unionByName(met).groupBy("query_id").agg(F.max("similarity").alias("similarity"))


def diversity_report(results: DataFrame, key: str = "article_id") -> DataFrame:
    """Per query: distinct domains, their share, how often each is there, span in hours, mean and largest similarity of pairs, and 1 - mean.

    The mean comes from sums of unit vectors, the largest from products within the query (``_closest``); rows without a vector have no pairs.
    """
    domains = results.groupBy("query_id", "source_domain").agg(F.count("*").alias("n"), F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
    span = (F.max("hi").cast("double") - F.min("lo").cast("double")) / 3600
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("source_domain").isNotNull(), F.struct("source_domain", "n")))))
    out = domains.groupBy("query_id").agg(F.count("source_domain").alias("domains"), (F.count("source_domain") / F.sum("n")).alias("ratio"), listed.alias("domain_counts"), F.coalesce(span, F.lit(0.0)).alias("span_hours"))
    v = results.where(F.col("embedding").isNotNull()).select("query_id", F.xxhash64("query_id", key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = written(v.groupBy("query_id", "embedding").agg(F.count("*").alias("m"), F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("again")), "vectors")  # each vector of a query once
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    units = v.select("query_id", "m", F.posexplode(F.transform("embedding", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))).alias("pos", "x"))
    sums = units.groupBy("query_id", "pos").agg(F.sum(F.col("x") * F.col("m")).alias("s"), F.sum(F.col("x") * F.col("x") * F.col("m")).alias("q"))
    many = v.groupBy("query_id").agg(F.sum("m").alias("m"))
    mean = sums.groupBy("query_id").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("t")).join(many, "query_id").where("m > 1").select("query_id", (F.col("t") / (F.col("m") * (F.col("m") - 1))).alias("mean_similarity"))
    most = _closest(v).withColumnRenamed("similarity", "max_similarity")
    out = out.join(mean, "query_id", "left").join(most, "query_id", "left").fillna(0.0, ["mean_similarity", "max_similarity"])
    return out.withColumn("diversity", 1 - F.col("mean_similarity"))


def suggest_memory(contents: DataFrame, nearest: DataFrame) -> DataFrame:
    """(id, type, importance, ttl_days, store): 0.5, 0.1 more for long contents, 0.2 less where a memory of 0.9 or more is there."""
    near = nearest.groupBy("id").agg(F.max("similarity").alias("closest"))
    base = 0.5 + F.when(F.length("content") > 200, 0.1).otherwise(0.0) - F.when(F.col("closest") >= 0.9, 0.2).otherwise(0.0)
    episodic = F.lower("content").rlike(r"\b(today|yesterday|now|last|ago)\b")
    out = contents.join(near, "id", "left").withColumn("importance", F.round(base, 6))
    return out.select("id", F.when(episodic, "episodic").otherwise("semantic").alias("type"), "importance", F.when(episodic, 30).otherwise(90).alias("ttl_days"), (F.col("importance") >= 0.6).alias("store"))


#: Limits of ``validate_records``.
LIMITS = {"title": 100, "body": 5_000}


def validate_records(records: DataFrame, limits: dict[str, int] | None = None, rules: tuple[str, ...] | None = None) -> DataFrame:
    """(id, violations) of records (id, title, body, url, date): lengths, required fields, date form, personal data, URL and whether its domain is safe.

    ``limits``: other lengths than ``LIMITS``; ``rules``: the rules that hold, all by default.
    """
    most = LIMITS | (limits or {})
    checks = {
        "title_missing": F.coalesce(F.trim("title"), F.lit("")) == "",
        "title_long": F.length("title") > most["title"],
        "body_long": F.length("body") > most["body"],
        "date_form": ~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "url_invalid": ~is_valid_url(F.col("url")),
        "unsafe_domain": F.coalesce(domain_trust(host(F.col("url"))) == 0, F.lit(False)),
        "pii": F.array_contains(detect_pii(F.col("body")), "email"),
    }
    return records.select("id", F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items() if rules is None or k in rules))).alias("violations"))


def violation_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def article_quality_report(articles: DataFrame, by: str) -> DataFrame:
    n = F.length("clean_text")
    urls = articles.groupBy(by, "url").agg(F.count("*").alias("k")).groupBy(by).agg(F.count_if(F.col("k") > 1).alias("duplicate_urls"))
    return articles.groupBy(by).agg(F.count("*").alias("n"), F.count_if(n < 50).alias("near_empty"), F.min(n).alias("shortest"), F.max(n).alias("longest")).join(urls, by)


def event_members(docs: DataFrame, days: int) -> DataFrame:
    """``docs`` (topic, doc_id, date, ...) that have a date, with ``event``: it holds what is within ``days`` of its first day, and is named by its first id.

    A gap longer than that always starts an event, so topics are cut there first and each piece is worked on by itself, a row for each day.
    """
    w = Window.partitionBy("topic").orderBy("date")
    gap = F.coalesce((F.date_diff("date", F.lag("date").over(w)) > days).cast("int"), F.lit(1))
    daily = docs.where("date IS NOT NULL").groupBy("topic", "date").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))  # a row for each day
    daily = daily.withColumn("__g", gap).withColumn("piece", F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        anchor, event, out = None, None, []
        for r in rows.itertuples(index=False):
            if anchor is None or (r.date - anchor).days > days:
                anchor, event = r.date, r.first
            out.append((r.topic, event, r.date, r.n))
        return pd.DataFrame(out, columns=["topic", "event", "date", "n"])

    placed = daily.groupBy("topic", "piece").applyInPandas(one, "topic string, event long, date date, n long")
    return docs.join(placed.select("topic", "date", "event"), ["topic", "date"])


def anchored_event_clusters(docs: DataFrame, days: int, texts: int = 3) -> DataFrame:
    """(topic, event, start, end, members, title, texts) of docs (topic, doc_id, date, title, text): of each event the first title and texts, by date, then id."""
    members = event_members(docs, days)
    about = members.groupBy("topic", "event").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.countDistinct("doc_id").alias("members"), F.min_by("title", F.struct("date", "doc_id")).alias("title"))
    n = F.row_number().over(Window.partitionBy("topic", "event").orderBy("date", "doc_id"))
    first = members.withColumn("n", n).where(F.col("n") <= texts).groupBy("topic", "event").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]).alias("texts"))
    return about.join(first, ["topic", "event"])


def enrich_events(members: DataFrame, k: int = 10) -> DataFrame:
    """(topic, event, entity, n, rank): the k names that are most often in the texts of each event; a name is words with a capital, in a row."""
    names = members.select("topic", "event", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+( [A-Z][a-z]+)*"), F.lit(0))).alias("entity")).groupBy("topic", "event", "entity").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("topic", "event").orderBy(F.col("n").desc(), "entity"))
    return names.withColumn("rank", rank).where(F.col("rank") <= k)
