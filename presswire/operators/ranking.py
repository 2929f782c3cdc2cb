"""Ranking of results (query_id, article_id, ...) for many queries at once: everything is a window over a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswire.functions.text import contains_any, freshness, is_evergreen
from presswire.functions.urls import registered_domain

#: Fixed values.
DOMAIN_PRIORITY = {"reuters.com": 10, "ap.org": 10, "bbc.com": 9, "nytimes.com": 8, "theguardian.com": 8, "washingtonpost.com": 8, "bloomberg.com": 8, "wsj.com": 8, "cnn.com": 7, "economist.com": 9, "npr.org": 8, "abcnews.go.com": 7, "cbsnews.com": 7, "nbcnews.com": 7}
WEIGHTS = {"semantic": 0.45, "fts": 0.30, "freshness": 0.20, "source": 0.05, "tau": 72}
EVERGREEN_WEIGHTS = {"semantic": 0.62, "fts": 0.30, "freshness": 0.04, "source": 0.04, "tau": 240}
CATEGORIES = {
    "sports": (0.5, ("game", "match", "score", "playoff", "championship", "league", "football", "basketball", "baseball", "soccer", "tennis", "nfl", "nba", "mlb", "uefa", "fifa")),
    "entertainment": (0.6, ("celebrity", "movie", "film", "actor", "actress", "hollywood", "oscars", "grammy", "emmy", "music video", "album", "concert")),
    "crime": (0.7, ("arrest", "charged", "suspect", "robbery", "theft", "murder", "shooting", "stabbing", "assault", "police arrest")),
    "weather": (0.8, ("forecast", "temperature", "rain", "snow", "storm warning", "weather alert", "high of", "low of")),
}
MISSING_RANK = 1_000_000


def _by_query() -> Window:
    return Window.partitionBy("query_id")


def best_first(score: str = "score") -> Window:
    return _by_query().orderBy(F.col(score).desc(), "article_id")


def canonical_score(as_of: Column, source_score: Column | None = None) -> Column:
    """Dated and older, from a better domain, longer, with a title of a fair length: the higher, the more canonical."""
    hours = (as_of.cast("double") - F.col("published_at").cast("double")) / 3600
    dated = F.when(F.col("published_at").isNull(), F.lit(-10.0)).otherwise(20 + F.when(hours > 0, F.least(F.lit(5.0), hours / 24)).otherwise(0.0))
    table = F.create_map(*(F.lit(v) for pair in DOMAIN_PRIORITY.items() for v in pair))
    of = lambda d: F.try_element_at(table, F.lower(d))
    domain = F.coalesce(of(F.col("source_domain")), of(registered_domain(F.col("source_domain"))), F.lit(0))
    length = F.least(F.lit(3.0), F.length(F.coalesce("clean_text", F.lit(""))) / 1000)
    title = F.when(F.length("title_norm").between(20, 150), 1).otherwise(0)
    return dated + domain + (source_score * 10 if source_score is not None else F.lit(0.0)) + length + title


def canonicalize(articles: DataFrame, group: str, as_of: Column) -> DataFrame:
    """(article_id, group, canonical_id, is_canonical, alternatives): the best of each group, ties to the smallest id; only a maximum travels, not the group."""
    scored = articles.withColumn("__s", F.round(canonical_score(as_of), 9))
    best = scored.groupBy(group).agg(F.max_by("article_id", F.struct("__s", (-F.col("article_id")).alias("i"))).alias("canonical_id"), (F.count("*") - 1).alias("alternatives"))
    return scored.join(best, group).select("article_id", group, "canonical_id", (F.col("article_id") == F.col("canonical_id")).alias("is_canonical"), "alternatives")


def canonical_refs(canonicalized: DataFrame) -> DataFrame:
    """(article_id, canonical_id): a row for each article that isn't its group's canonical one, to be written back as a map."""
    return canonicalized.where(~F.col("is_canonical")).select("article_id", "canonical_id")


def alternatives(canonicalized: DataFrame, most: int = 10_000) -> DataFrame:
    """(canonical_id, part, alternative_ids): the others of each group, in order, in parts of about ``most``."""
    others = canonicalized.where(~F.col("is_canonical"))
    part = F.pmod(F.xxhash64("article_id"), F.ceil(F.col("alternatives") / most)).cast("int")
    return others.groupBy("canonical_id", part.alias("part")).agg(F.array_sort(F.collect_list("article_id")).alias("alternative_ids"))


def minmax_normalize(results: DataFrame, column: str) -> DataFrame:
    """Within [0, 1] per query; 0.5 where all are equal; a single row stays as it is."""
    w = _by_query()
    lo, hi, n = F.min(column).over(w), F.max(column).over(w), F.count("*").over(w)
    return results.withColumn(column, F.when(n == 1, F.col(column)).when(hi == lo, 0.5).otherwise((F.col(column) - lo) / (hi - lo)))


def score_results(results: DataFrame, as_of: Column, source: Column | None = None) -> DataFrame:
    """``score`` to four places: weighted similarity, text score, freshness and source; other weights for evergreen queries."""
    ever = is_evergreen(F.col("query"))
    pick = lambda k: F.when(ever, EVERGREEN_WEIGHTS[k]).otherwise(WEIGHTS[k])
    fresh = F.when(ever, freshness(F.col("published_at"), as_of, 240)).otherwise(freshness(F.col("published_at"), as_of, 72))
    total = pick("semantic") * F.coalesce("similarity", F.lit(0.5)) + pick("fts") * F.coalesce("fts_score", F.lit(0.5)) + pick("freshness") * fresh + pick("source") * (source if source is not None else F.lit(0.5))
    return results.withColumn("score", F.bround(total, 4))


def category_penalty(title: Column, snippet: Column, query: Column) -> Column:
    """The factor of the first category with two terms in the title or the first 200 characters, unless the query names it; else 1."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(snippet, F.lit("")), 1, 200)))
    out = F.when(F.lit(False), F.lit(1.0))
    for factor, terms in CATEGORIES.values():
        n = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: text.contains(t)))
        out = out.when(~contains_any(F.lower(query), terms) & (n >= 2), factor)
    return out.otherwise(1.0)


def duplicate_penalty(results: DataFrame) -> DataFrame:
    """In the order of scores: a title seen before counts 0.8, a content hash seen before 0.6."""
    order = [F.col("score").desc(), F.col("article_id")]
    again = lambda key: F.row_number().over(Window.partitionBy("query_id", key).orderBy(*order)) > 1
    marked = results.withColumn("__title", F.lower("title_norm"))
    factor = F.when(again("__title"), 0.8).otherwise(1.0) * F.when(again("content_hash"), 0.6).otherwise(1.0)
    return marked.withColumn("score", F.col("score") * factor).drop("__title")


def cap_per_domain_article(results: DataFrame, per_domain: int = 3, per_article: int = 2) -> DataFrame:
    """In the order of scores at most so many of an article, then of a domain."""
    out = results
    for key, most in (("article_id", per_article), ("source_domain", per_domain)):
        n = F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.col("score").desc(), "article_id"))
        out = out.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")
    return out


def cap_per_etld1(results: DataFrame, most: int = 2) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id", registered_domain(F.col("source_domain"))).orderBy(F.col("score").desc(), "article_id"))
    return results.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def rrf_fuse(text: DataFrame, vector: DataFrame, k: int = 60, alpha: float = 0.5, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, article_id, rank), each cut at twice the limit."""
    cut = lambda df, name: df.where(F.col("rank") <= 2 * limit).select("query_id", "article_id", F.col("rank").alias(name))
    met = cut(text, "rt").join(cut(vector, "rv"), ["query_id", "article_id"], "full")
    part = lambda w, name: w / (k + F.coalesce(name, F.lit(MISSING_RANK)))
    fused = met.select("query_id", "article_id", F.round(part(alpha, "rt") + part(1 - alpha, "rv"), 12).alias("score"))
    return fused.withColumn("rank", F.row_number().over(best_first())).where(F.col("rank") <= limit)


def page(results: DataFrame, offset: int, k: int) -> DataFrame:
    """Rows offset + 1 to offset + k of each query, and the next offset if there is more."""
    w = best_first()
    numbered = results.withColumns({"rank": F.row_number().over(w), "__n": F.count("*").over(_by_query())})
    return numbered.where(F.col("rank").between(offset + 1, offset + k)).withColumn("next_offset", F.when(F.col("__n") > offset + k, offset + k)).drop("__n")


def latest_per_cluster(members: DataFrame, most: int = 3, width: int = 140) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("published_at").desc_nulls_last(), "article_id"))
    return members.withColumn("n", n).where(F.col("n") <= most).select("cluster", "n", "article_id", F.substring("title_norm", 1, width).alias("title"))


def rank_trends(topics: DataFrame, k: int) -> DataFrame:
    """(cluster, size, momentum, burst): 0.5 burst {0, 0.6, 1} + 0.3 momentum within [-1, 3] + 0.2 size over the largest."""
    most = topics.agg(F.max("size").alias("most"))
    burst = F.when(F.col("burst") >= 2, 1.0).when(F.col("burst") == 1, 0.6).otherwise(0.0)
    score = 0.5 * burst + 0.3 * F.greatest(F.lit(-1.0), F.least(F.lit(3.0), F.col("momentum"))) + 0.2 * F.col("size") / F.col("most")
    return topics.join(F.broadcast(most)).withColumn("score", F.round(score, 9)).drop("most").orderBy(F.col("score").desc(), "cluster").limit(k)


def topic_gaps(terms: DataFrame, focal: str, per_domain: int = 2, most: int = 5) -> DataFrame:
    """Terms (domain, term) of other domains that the focal one lacks, at most two of each and five in all."""
    own = terms.where(F.col("domain") == focal).select("term")
    gaps = terms.where(F.col("domain") != focal).join(own, "term", "left_anti").distinct()
    n = F.row_number().over(Window.partitionBy("domain").orderBy("term"))
    return gaps.withColumn("n", n).where(F.col("n") <= per_domain).orderBy("domain", "term").limit(most).select("domain", "term")


def common_topics(terms: DataFrame, a: str, b: str) -> DataFrame:
    of = lambda d: terms.where(F.col("domain") == d).select("term")
    return of(a).intersect(of(b))


def rank_pipeline(candidates: DataFrame, as_of: Column, threshold: float = 0.28) -> DataFrame:
    """Off-topic results out, then score, category, date and duplicate penalties, caps, and the final rank."""
    kept = candidates.where(F.coalesce("similarity", F.lit(1.0)) >= threshold)
    scored = score_results(kept, as_of)
    factor = category_penalty(F.col("title_norm"), F.col("clean_text"), F.col("query")) * F.when(F.col("published_at").isNull(), 0.3).otherwise(1.0)
    scored = duplicate_penalty(scored.withColumn("score", F.col("score") * factor))
    capped = cap_per_domain_article(scored.withColumn("score", F.round("score", 9)))
    return capped.withColumn("rank", F.row_number().over(best_first()))


def related_queries(results: DataFrame, top: int = 5, most: int = 6) -> DataFrame:
    """Suggestions from the first results of a query: the first three title words longer than four characters, in order of rank."""
    first = results.where(F.col("rank") <= top)
    words = first.select("query_id", "rank", F.posexplode(F.slice(F.filter(F.split("title_norm", " "), lambda w: F.length(w) > 4), 1, 3)).alias("pos", "suggestion"))
    once = words.groupBy("query_id", "suggestion").agg(F.min(F.struct("rank", "pos")).alias("at"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "suggestion"))
    return once.withColumn("n", n).where(F.col("n") <= most).select("query_id", "suggestion", "n")


def top_n(results: DataFrame, n: int) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(best_first())).where(F.col("rank") <= n)


#: Rows whose vectors are spread out at once.
MMR_ROWS = 20_000


class _Similar:
    """Of rows (source_domain, published_at, embedding) the similarity with one of them. Vectors stay as they came, a few are spread out at once."""

    def __init__(self, rows: pa.Table) -> None:
        domain = pc.fill_null(rows["source_domain"].combine_chunks(), "").dictionary_encode()
        self.domain = domain.indices.to_numpy()
        names = ["".join(d.split(".")[-2:-1]) for d in domain.dictionary.to_pylist()]
        self.name = np.unique(names, return_inverse=True)[1][self.domain]
        at = rows["published_at"].combine_chunks()
        self.dated, self.at = at.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(at.cast(pa.int64()), 0).to_numpy()
        vectors = rows["embedding"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        self.dim = int(sizes.max(initial=0))
        good = sizes == self.dim
        if vectors.flatten().null_count:
            good[np.repeat(np.arange(len(sizes)), sizes)[vectors.flatten().is_null().to_numpy(zero_copy_only=False)]] = False
        self.place = np.where(good, np.cumsum(good) - 1, -1)
        kept = vectors if good.all() else vectors.filter(pa.array(good))
        self.vectors = kept.flatten().to_numpy(zero_copy_only=False).reshape(int(good.sum()), self.dim) if self.dim else np.zeros((int(good.sum()), 0))

    def _unit(self, low: int, high: int) -> np.ndarray:
        x = self.vectors[low:high].astype(np.float64)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def to(self, i: int) -> np.ndarray:
        """The largest of cosine, 0.3 for a domain in common (0.8 of it for its name alone) and 0.2 for closeness in time."""
        out = 0.3 * np.where(self.domain == self.domain[i], 1.0, np.where(self.name == self.name[i], 0.8, 0.0))
        if self.dated[i]:
            out = np.maximum(out, np.where(self.dated, 0.2 * np.exp(-np.abs(self.at - self.at[i]) / 3_600_000_000 / 12), 0.0))
        if self.place[i] >= 0 and self.dim:
            own = self._unit(self.place[i], self.place[i] + 1)[0]
            cosine = np.concatenate([np.einsum("ij,j->i", self._unit(n, n + MMR_ROWS), own) for n in range(0, len(self.vectors), MMR_ROWS)])
            have = np.flatnonzero(self.place >= 0)
            out[have] = np.maximum(out[have], cosine)
        return out


def mmr_rows(rows: pa.Table, k: int, weight: float) -> np.ndarray:
    """Places chosen by maximal marginal relevance among rows with ``rank``, the least of which wins a tie; all of them if there are k or fewer."""
    rank = rows["rank"].to_numpy()
    if len(rows) <= k:
        return np.argsort(rank)
    similar = _Similar(rows)
    score, left = weight * rows["score"].to_numpy(), np.ones(len(rows), bool)
    chosen = [int(np.argmin(rank))]
    left[chosen[0]] = False
    closest = similar.to(chosen[0])
    while left.any() and len(chosen) < k:
        value = np.where(left, score - (1 - weight) * closest, -np.inf)
        most = np.flatnonzero(left & (value == value[left].max()))
        best = int(most[np.argmin(rank[most])])
        chosen.append(best)
        left[best] = False
        closest = np.maximum(closest, similar.to(best))
    return np.array(chosen)


def mmr_select(results: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, article_id, rank): k diverse results of each query.

    A similarity is at most 1, so a row more than (1 - weight) / weight below the k-th score can never be chosen: those go before
    the choice, which they can't change. What is left of a query is worked on in one place, its
    vectors as Arrow has them: 4 bytes for a float, and some 60 bytes a row besides.
    """
    ranked = results.withColumn("rank", F.row_number().over(best_first()))
    kth = F.min(F.when(F.col("rank") <= k, F.col("score"))).over(_by_query())
    cut = ranked.withColumn("kth", kth).where((F.col("rank") <= k) | (F.col("score") >= F.col("kth") - (1 - weight) / weight))

    def one(rows: pa.Table) -> pa.Table:
        at = mmr_rows(rows, k, weight)
        return pa.table({"query_id": rows["query_id"].take(at), "article_id": rows["article_id"].take(at), "rank": np.arange(1, len(at) + 1)})

    return cut.select("query_id", "article_id", F.col("score").cast("double").alias("score"), "rank", "source_domain", "published_at", "embedding").groupBy("query_id").applyInArrow(one, "query_id long, article_id long, rank long")


def temporal_gap(results: DataFrame, hours: float = 2.0) -> DataFrame:
    """In the order of rank, rows closer than ``hours`` to a row kept before go; undated rows stay.

    Rows with a gap of ``hours`` or more between them have no bearing on each other, so each run of closer rows is worked on by itself.
    """
    ranked = results.withColumn("rank", F.row_number().over(best_first()).cast("long")).select("query_id", "article_id", "rank", "published_at")
    in_time = _by_query().orderBy("published_at", "rank")
    seconds = F.col("published_at").cast("double")
    far = F.coalesce((seconds - F.lag(seconds).over(in_time) >= hours * 3600).cast("int"), F.lit(1))
    dated = ranked.where("published_at IS NOT NULL").withColumn("far", far).withColumn("run", F.sum("far").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        kept, stays = [], []
        for t in rows["published_at"].map(pd.Timestamp.timestamp):
            stays.append(all(abs(t - o) >= hours * 3600 for o in kept))
            if stays[-1]:
                kept.append(t)
        return rows[stays][["query_id", "article_id", "rank"]]

    chosen = dated.groupBy("query_id", "run").applyInPandas(one, "query_id long, article_id long, rank long")
    return chosen.unionByName(ranked.where("published_at IS NULL").drop("published_at"))


def ensure_min_domains(results: DataFrame, want: int = 3, top: int = 5) -> DataFrame:
    """The first ``top`` rows of each query; while they show fewer than ``want`` domains, from the end a repeated one gives way to the best row of a new domain.

    Besides the first rows only the best row of each domain can come in, and no more than ``want`` of those.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        head, rest = list(range(min(top, len(rows)))), list(range(min(top, len(rows)), len(rows)))
        domain = rows["source_domain"]
        for place in reversed(range(len(head))):
            shown = [domain[i] for i in head]
            if len(set(shown)) >= want:
                break
            new = next((i for i in rest if domain[i] not in shown), None)
            if shown.count(domain[head[place]]) > 1 and new is not None:
                rest.remove(new)
                head[place] = new
        return pd.DataFrame({"query_id": rows["query_id"].iloc[head].to_numpy(), "article_id": rows["article_id"].iloc[head].to_numpy(), "rank": range(1, len(head) + 1)})

    ranked = results.withColumn("rank", F.row_number().over(best_first())).select("query_id", "article_id", "rank", "source_domain")
    of_domain = F.row_number().over(Window.partitionBy("query_id", "source_domain").orderBy("rank"))
    first = ranked.withColumn("n", of_domain).where((F.col("rank") <= top) | (F.col("n") == 1)).drop("n")
    near = F.sum((F.col("rank") > top).cast("int")).over(_by_query().orderBy("rank"))
    return first.withColumn("n", near).where(F.col("n") <= top + want).drop("n").groupBy("query_id").applyInPandas(one, "query_id long, article_id long, rank long")
