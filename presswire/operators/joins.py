"""Joins: lookups, profiles, as-of, pairs inside groups, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words whose pairs a task counts at once, and pairs of entities.
WORDS, PAIRS = 500_000, 4_000_000
#: Fixed values; a default of 0.5 stands for any other domain.
AUTHORITY = {"reuters.com": 1.0, "ap.org": 1.0, "bbc.com": 0.95, "nytimes.com": 0.9, "theguardian.com": 0.9, "bloomberg.com": 0.9, "wsj.com": 0.9}


def chunks_with_article(chunks: DataFrame, index: DataFrame, as_of: Column, hours: int, language: str | None = None) -> DataFrame:
    """Chunks with a vector of articles published in the window."""
    inside = index.where(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    if language:
        inside = inside.where(F.col("language") == language)
    return chunks.where("embedding IS NOT NULL").join(inside.select("article_id", "source", "status"), "article_id")


def first_chunk_per_article(chunks: DataFrame) -> DataFrame:
    """Of each article the chunk with a vector and the lowest index."""
    own = chunks.where("embedding IS NOT NULL").groupBy("article_id").agg(F.min("chunk_index").alias("chunk_index"))
    return chunks.join(own, ["article_id", "chunk_index"], "left_semi")


def seen(batch: DataFrame, target: DataFrame, key: str, id_col: str) -> DataFrame:
    """``batch`` with the smallest id that the target has for its key, null if none; an empty key never matches."""
    known = target.where(F.col(key) != "").groupBy(key).agg(F.min(id_col).alias("seen_id"))
    return batch.join(known, key, "left")


def with_domain_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Score, level and counters of a row's domain; 0.5, standard and zeros without a profile."""
    joined = df.join(profiles, "source_domain", "left")
    return joined.withColumns({"source_score": F.coalesce("source_score", F.lit(0.5)), "level": F.coalesce("level", F.lit("standard")), "clicks": F.coalesce("clicks", F.lit(0)), "impressions": F.coalesce("impressions", F.lit(0))})


def source_score(domain: Column, given: Column) -> Column:
    """The given score within [0, 1], else the domain's authority, else 0.5."""
    table = F.create_map(*(F.lit(v) for pair in AUTHORITY.items() for v in pair))
    return F.coalesce(F.when(given.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), given))), F.try_element_at(table, domain), F.lit(0.5))


def latest_metric_as_of(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """Of each rule the latest value of its metric and user within its hours before its ``at``; null without any."""
    m = metrics.select(F.col("metric").alias("m"), F.col("user_id").alias("u"), "ts", "value", "event_id")
    age = F.col("at").cast("double") - F.col("ts").cast("double")
    met = rules.join(m, (F.col("metric") == F.col("m")) & (F.col("user_id") == F.col("u")) & (age >= 0) & (age <= F.col("hours") * 3600), "left")
    return met.groupBy(*rules.columns).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def entity_cooccurrence(mentions: DataFrame) -> DataFrame:
    """Unordered pairs of entities (doc_id, entity, relation) in the same document: documents, weight min(1, n / 5), and the least relation.

    All entities of a document meet, as numbers; about ``PAIRS`` pairs are counted together in a task, and only counts are shuffled. An entity meets
    those that follow it in its document, so one with very many is worked on in parts.
    """
    own = mentions.groupBy("doc_id").agg(F.collect_set("entity").alias("e"), F.min("relation").alias("relation"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code = _by_bytes(batch.column(0).flatten())
            kinds, kind = _by_bytes(batch.column(1))
            kind = np.where(kind < 0, len(kinds), kind)  # none comes last
            doc = np.repeat(np.arange(len(batch)), np.asarray(pc.fill_null(pc.list_value_length(batch.column(0)), 0)))
            order = np.lexsort((code, doc))
            code, kind = code[order], kind[doc]
            later = np.searchsorted(doc, doc, "right") - np.arange(len(doc)) - 1
            total, low = np.cumsum(later), 0
            while low < len(doc):
                high = max(low + 1, np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right"))
                n = later[low:high]
                x = np.repeat(np.arange(low, high), n)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                pairs, docs = np.unique((code[x] * len(names) + code[y]) * (len(kinds) + 1) + kind[x], return_counts=True)
                pair, first = np.unique(pairs // (len(kinds) + 1), return_index=True)
                least = pairs[first] % (len(kinds) + 1)
                docs = np.add.reduceat(docs, first) if len(first) else docs
                yield pa.RecordBatch.from_arrays([names.take(pa.array(pair // max(len(names), 1))), names.take(pa.array(pair % max(len(names), 1))), pa.array(docs.astype(np.int64)), kinds.take(pa.array(least, mask=least == len(kinds)))], ["a", "b", "n", "relation"])
                low = high

    pairs = own.select("e", "relation").mapInArrow(run, "a string, b string, n long, relation string").groupBy("a", "b").agg(F.sum("n").alias("docs"), F.min("relation").alias("relation"))
    return pairs.withColumn("weight", F.least(F.lit(1.0), F.col("docs") / 5))


def _by_bytes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings of a column in the order of their bytes, as Spark compares them, and each row's place among them, -1 for null."""
    coded = column.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = np.asarray(coded.indices.fill_null(-1), np.int64)
    return coded.dictionary.take(pa.array(order)).cast(pa.string()), np.where(code >= 0, place[code], -1) if len(order) else code


def word_cooccurrence(texts: DataFrame, window: int = 4, min_weight: int = 2) -> DataFrame:
    """Pairs of unequal words of texts (words: an array): how many windows of ``window`` words hold both, counted once for each window.

    A word meets the few that follow it, inside its own row, as numbers; the pairs of about ``WORDS`` words are counted together in a task, and only
    counts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(0)), 0), np.int64)
            part = np.cumsum(sizes) // WORDS
            for low, high in zip(*(lambda c: (c[:-1], c[1:]))([0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]), strict=True):
                yield counted(batch.column(0).slice(low, high - low), sizes[low:high])

    def counted(rows: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        words, code = _by_bytes(rows.flatten())
        n = np.repeat(sizes, sizes)
        i = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, window):
            at = np.flatnonzero(i + d < n)
            at = at[(code[at] != code[at + d]) & (code[at] >= 0) & (code[at + d] >= 0)]
            x, y = code[at], code[at + d]
            keys.append(np.minimum(x, y) * len(words) + np.maximum(x, y))
            weights.append(np.maximum(0, np.minimum(i[at], n[at] - window) - np.maximum(0, i[at] + d - (window - 1)) + 1))
        pairs, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate(weights), len(pairs)).astype(np.int64)
        name = lambda k: words.take(pa.array(k))
        return pa.RecordBatch.from_arrays([name(pairs // max(len(words), 1)), name(pairs % max(len(words), 1)), pa.array(total)], ["a", "b", "w"])

    return texts.select("words").mapInArrow(run, "a string, b string, w long").groupBy("a", "b").agg(F.sum("w").alias("weight")).where(F.col("weight") >= min_weight)


def domain_overlap(terms: DataFrame) -> DataFrame:
    """Pairs of domains (domain, term): shared terms and the Jaccard similarity of their sets, by way of the terms."""
    t = terms.distinct()
    n = t.groupBy("domain").agg(F.count("*").alias("n"))
    a, b = t.select(F.col("domain").alias("a"), "term"), t.select(F.col("domain").alias("b"), "term")
    shared = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = shared.join(n.select(F.col("domain").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("domain").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def event_timeline(events: DataFrame) -> DataFrame:
    """Each event of a topic with the one before it by start: whether it comes after its end or overlaps."""
    w = Window.partitionBy("topic").orderBy("start", "event_id")
    prior = events.withColumns({"prior_id": F.lag("event_id").over(w), "prior_end": F.lag("end").over(w)}).where("prior_id IS NOT NULL")
    return prior.withColumn("relation", F.when(F.col("start") > F.col("prior_end"), "after").otherwise("overlap")).drop("prior_end")


def causal_candidates(events: DataFrame, days: int = 7) -> DataFrame:
    """Pairs of events of a topic where the effect starts within ``days`` after the end of the cause; confidence 0.4.

    Events meet by topic and stretch of ``days`` + 1 days: what starts within ``days`` of an end is in the end's stretch or in the next.
    """
    stretch = lambda day: F.floor(F.unix_date(day) / (days + 1))
    cause = events.select("topic", F.col("event_id").alias("cause"), F.col("end").alias("cause_end"), F.explode(F.array(stretch("end"), stretch("end") + 1)).alias("stretch"))
    effect = events.select("topic", F.col("event_id").alias("effect"), F.col("start").alias("effect_start"), stretch("start").alias("stretch"))
    gap = F.date_diff("effect_start", "cause_end")
    return cause.join(effect, ["topic", "stretch"]).where((F.col("cause") != F.col("effect")) & gap.between(0, days)).select("topic", "cause", "effect", F.lit(0.4).alias("confidence"))


def causal_evidence(links: DataFrame, members: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` documents (event_id, doc_id) of either event of each link."""
    ends = links.select("cause", "effect", F.explode(F.array("cause", "effect")).alias("event_id"))
    docs = ends.join(members, "event_id").select("cause", "effect", "doc_id").distinct()
    n = F.row_number().over(Window.partitionBy("cause", "effect").orderBy("doc_id"))
    return docs.withColumn("n", n).where(F.col("n") <= most)


def topic_conflicts(topics: DataFrame, most: int = 3) -> DataFrame:
    """Where sentiment and direction of a topic (topic, sentiment, direction) disagree, at most ``most`` of each kind."""
    kind = F.when((F.col("sentiment") < -0.2) & (F.col("direction") == "up"), "negative_rising").when((F.col("sentiment") > 0.2) & (F.col("direction") == "down"), "positive_falling")
    n = F.row_number().over(Window.partitionBy("kind").orderBy(F.abs("sentiment").desc(), "topic"))
    return topics.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("n", n).where(F.col("n") <= most).drop("n")


def match_subscriptions(terms: DataFrame, subs: DataFrame) -> DataFrame:
    """Subscriptions (sub_id, term, language_filter, required_domain, excluded_domain, since, min_results) whose matches among article terms are enough.

    A null language, domain or ``since`` asks for nothing; an article without date is in no window that a ``since`` opens.
    """
    met = terms.join(subs, "term")
    met = met.where((F.col("language_filter").isNull() | (F.col("language") == F.col("language_filter"))) & ~F.col("source_domain").eqNullSafe(F.col("excluded_domain")))
    met = met.where((F.col("required_domain").isNull() | (F.col("source_domain") == F.col("required_domain"))) & (F.col("since").isNull() | (F.col("published_at") >= F.col("since"))))
    fired = met.groupBy("sub_id", "min_results").agg(F.countDistinct("article_id").alias("matches"), F.max("published_at").alias("newest"))
    return fired.where(F.col("matches") >= F.col("min_results"))


def merge_docs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` and those of ``new`` whose id and url are both unknown; among themselves the first of an id, then of a url, stays."""
    fresh = new.join(existing.select("article_id").distinct(), "article_id", "left_anti").join(existing.select("url").distinct(), "url", "left_anti")
    for key in ("article_id", "url"):
        fresh = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("__n = 1").drop("__n")
    return existing.unionByName(fresh.select(*existing.columns))
