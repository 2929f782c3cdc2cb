"""Queries of ranking, text search and duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswire.functions import text as t
from presswire.operators import ranking as r
from presswire.operators import textindex as ti
from presswire.plans import fixtures as x
from presswire.plans.fixtures import AS_OF
from presswire.plans.registry import Registry
from presswire.sources.scratch import new_path

R = Registry()
c = F.col
TS = f"TIMESTAMP '{AS_OF}'"

_CANON = f"round(CASE WHEN published_at IS NULL THEN -10 ELSE 20 + CASE WHEN {TS} > published_at THEN least(5, (epoch({TS}) - epoch(published_at)) / 3600 / 24) ELSE 0 END END + least(3, length(coalesce(clean_text, '')) / 1000) + CASE WHEN length(title_norm) BETWEEN 20 AND 150 THEN 1 ELSE 0 END, 9)"


@R.add(f"SELECT article_id, round({_CANON}, 6) AS score FROM articles", "articles")
def w1_canonical_score(spark, sf_dir):
    return x.articles(spark, sf_dir).select("article_id", F.round(r.canonical_score(x.as_of()), 6).alias("score"))


@R.add(
    f"WITH s AS (SELECT article_id, url, {_CANON} AS s FROM articles) SELECT article_id, url, first_value(article_id) OVER w AS canonical_id, article_id = first_value(article_id) OVER w AS is_canonical, count(*) OVER (PARTITION BY url) - 1 AS alternatives FROM s WINDOW w AS (PARTITION BY url ORDER BY s DESC, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "articles",
)
def w2_canonicalize(spark, sf_dir):
    return r.canonicalize(x.articles(spark, sf_dir), "url", x.as_of())


@R.add(
    f"WITH s AS (SELECT article_id, url, {_CANON} AS s FROM articles), m AS (SELECT article_id, first_value(article_id) OVER (PARTITION BY url ORDER BY s DESC, article_id) AS canonical_id FROM s) SELECT article_id, canonical_id FROM m WHERE article_id <> canonical_id",
    "articles",
)
def w2_canonical_refs(spark, sf_dir):
    return r.canonical_refs(r.canonicalize(x.articles(spark, sf_dir), "url", x.as_of()))


@R.add(
    f"WITH s AS (SELECT article_id, url, {_CANON} AS s FROM articles), m AS (SELECT article_id, first_value(article_id) OVER (PARTITION BY url ORDER BY s DESC, article_id) AS canonical_id FROM s) SELECT canonical_id, list_sort(list(article_id)) AS alternative_ids FROM m WHERE article_id <> canonical_id GROUP BY 1",
    "articles",
)
def w2_alternatives(spark, sf_dir):
    return r.alternatives(r.canonicalize(x.articles(spark, sf_dir), "url", x.as_of())).select("canonical_id", "alternative_ids")


@R.add(
    "SELECT query_id, article_id, round(CASE WHEN n = 1 THEN fts_score WHEN hi = lo THEN 0.5 ELSE (fts_score - lo) / (hi - lo) END, 6) AS fts_score FROM (SELECT *, min(fts_score) OVER w AS lo, max(fts_score) OVER w AS hi, count(*) OVER w AS n FROM candidates WINDOW w AS (PARTITION BY query_id))",
    "candidates",
)
def w3_minmax_normalize(spark, sf_dir):
    return r.minmax_normalize(x.candidates(spark, sf_dir), "fts_score").select("query_id", "article_id", F.round("fts_score", 6).alias("fts_score"))


_EVER = f"len(list_filter({list(t.EVERGREEN)}, lambda w: contains(lower(query), w))) > 0"
_AGE = f"(epoch({TS}) - epoch(published_at)) / 3600"
_SCORED = f"""SELECT *, CASE WHEN e THEN 0.62 * s + 0.3 * fts_score + 0.04 * coalesce(exp(-age / 240), 0) + 0.04 * 0.5 ELSE 0.45 * s + 0.3 * fts_score + 0.2 * coalesce(exp(-age / 72), 0) + 0.05 * 0.5 END AS score
 FROM (SELECT *, {_EVER} AS e, coalesce(similarity, 0.5) AS s, {_AGE} AS age FROM candidates)"""


@R.add(f"SELECT query_id, article_id, round(round_even(score, 4) + 1e-9, 3) AS score FROM ({_SCORED})", "candidates")
def w4_score_results(spark, sf_dir):
    scored = r.score_results(x.candidates(spark, sf_dir), x.as_of())
    return scored.select("query_id", "article_id", F.round(c("score") + 1e-9, 3).alias("score"))


@R.add(
    "SELECT query_id, article_id, round(fts_score * CASE WHEN a > 1 THEN 0.8 ELSE 1 END * CASE WHEN b > 1 THEN 0.6 ELSE 1 END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(title_norm) ORDER BY fts_score DESC, article_id) AS a, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY fts_score DESC, article_id) AS b FROM candidates)",
    "candidates",
)
def w5_duplicate_penalty(spark, sf_dir):
    return r.duplicate_penalty(x.candidates(spark, sf_dir).withColumn("score", c("fts_score"))).select("query_id", "article_id", F.round("score", 6).alias("score"))


@R.add("SELECT query_id, article_id FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id, source_domain ORDER BY fts_score DESC, article_id) <= 3", "candidates")
def w6_cap_per_domain_article(spark, sf_dir):
    return r.cap_per_domain_article(x.candidates(spark, sf_dir).withColumn("score", c("fts_score"))).select("query_id", "article_id")


@R.add("SELECT query_id, article_id FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, article_id) <= 2", "candidates")
def w7_cap_per_etld1(spark, sf_dir):
    return r.cap_per_etld1(x.candidates(spark, sf_dir).withColumn("score", c("fts_score"))).select("query_id", "article_id")


def _ranked(k, column):
    return k.select("query_id", "article_id", F.row_number().over(Window.partitionBy("query_id").orderBy(c(column).desc_nulls_last(), "article_id")).alias("rank"))


@R.add(
    """WITH a AS (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, article_id) AS ra FROM candidates QUALIFY ra <= 20), b AS (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, article_id) AS rb FROM candidates QUALIFY rb <= 20),
f AS (SELECT query_id, article_id, round(0.5 / (60 + coalesce(ra, 1000000)) + 0.5 / (60 + coalesce(rb, 1000000)), 12) AS score FROM a FULL JOIN b USING (query_id, article_id))
SELECT query_id, article_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, article_id) AS rank FROM f QUALIFY rank <= 10""",
    "candidates",
)
def w8_rrf_fuse(spark, sf_dir):
    k = x.candidates(spark, sf_dir)
    return r.rrf_fuse(_ranked(k, "fts_score"), _ranked(k, "similarity")).withColumn("score", F.round("score", 9))


@R.add("SELECT query_id, article_id, rank, CASE WHEN n > 20 THEN 20 END AS next_offset FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, article_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM candidates) WHERE rank BETWEEN 11 AND 20", "candidates")
def w9_page(spark, sf_dir):
    return r.page(x.candidates(spark, sf_dir).withColumn("score", c("fts_score")), 10, 10).select("query_id", "article_id", "rank", "next_offset")


@R.add("SELECT article_id % 50 AS cluster, article_id, substring(title_norm, 1, 140) AS title, row_number() OVER (PARTITION BY article_id % 50 ORDER BY published_at DESC NULLS LAST, article_id) AS n FROM articles QUALIFY n <= 3", "articles")
def w10_latest_per_cluster(spark, sf_dir):
    return r.latest_per_cluster(x.articles(spark, sf_dir).withColumn("cluster", c("article_id") % 50))


@R.add(
    "WITH c AS (SELECT source AS cluster, count(*) AS size, min(article_id) % 3 AS burst, (max(article_id) % 7 - 2) / 2 AS momentum FROM articles GROUP BY source) SELECT cluster, size, round(0.5 * CASE burst WHEN 2 THEN 1 WHEN 1 THEN 0.6 ELSE 0 END + 0.3 * greatest(-1, least(3, momentum)) + 0.2 * size / (SELECT max(size) FROM c), 6) AS score FROM c ORDER BY score DESC, cluster LIMIT 10",
    "articles",
)
def w11_rank_trends(spark, sf_dir):
    g = x.articles(spark, sf_dir).groupBy(c("source").alias("cluster")).agg(F.count("*").alias("size"), (F.min("article_id") % 3).alias("burst"), ((F.max("article_id") % 7 - 2) / 2).alias("momentum"))
    return r.rank_trends(g, 10).select("cluster", "size", F.round("score", 6).alias("score"))


def _with_vectors(spark, sf_dir):
    v = x.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    k = x.candidates(spark, sf_dir)
    return k.join(v, c("article_id") % 500 == c("vec_id"), "left").withColumn("score", c("fts_score"))


@R.add()
def w12_mmr_select(spark, sf_dir):
    return r.mmr_select(_with_vectors(spark, sf_dir), 10)


@R.add()
def w13_temporal_gap(spark, sf_dir):
    return r.temporal_gap(x.candidates(spark, sf_dir).withColumn("score", c("fts_score")))


@R.add()
def w14_ensure_min_domains(spark, sf_dir):
    return r.ensure_min_domains(x.candidates(spark, sf_dir).withColumn("score", c("fts_score")))


_TERMS = "SELECT DISTINCT source_domain AS domain, unnest(regexp_extract_all(lower(title_norm), '[a-z]{5,}')) AS term FROM articles"


def _terms(spark, sf_dir):
    a = x.articles(spark, sf_dir)
    return a.select(c("source_domain").alias("domain"), F.explode(F.regexp_extract_all(F.lower("title_norm"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term")).distinct()


@R.add(f"WITH t AS ({_TERMS}), g AS (SELECT domain, term FROM t WHERE domain <> 'src0.example.com' AND term NOT IN (SELECT term FROM t WHERE domain = 'src0.example.com') QUALIFY row_number() OVER (PARTITION BY domain ORDER BY term) <= 2) SELECT * FROM g ORDER BY domain, term LIMIT 5", "articles")
def w15_topic_gaps(spark, sf_dir):
    return r.topic_gaps(_terms(spark, sf_dir), "src0.example.com")


@R.add(f"WITH t AS ({_TERMS}) SELECT term FROM t WHERE domain = 'src0.example.com' INTERSECT SELECT term FROM t WHERE domain = 'src1.example.com'", "articles")
def w16_common_topics(spark, sf_dir):
    return r.common_topics(_terms(spark, sf_dir), "src0.example.com", "src1.example.com")


def _category_sql() -> str:
    whens = []
    for factor, terms in r.CATEGORIES.values():
        whens.append(f"WHEN len(list_filter({list(terms)}, lambda w: contains(lower(query), w))) = 0 AND len(list_filter({list(terms)}, lambda w: contains(lower(title_norm || ' ' || substring(clean_text, 1, 200)), w))) >= 2 THEN {factor}::DOUBLE")
    return f"CASE {' '.join(whens)} ELSE 1.0 END"


@R.add(f"SELECT query_id, article_id, {_category_sql()} AS factor FROM candidates", "candidates")
def x17_category_penalty(spark, sf_dir):
    return x.candidates(spark, sf_dir).select("query_id", "article_id", r.category_penalty(c("title_norm"), c("clean_text"), c("query")).alias("factor"))


@R.add(
    f"""WITH s AS (SELECT * REPLACE (round_even(score, 4) * {_category_sql()} * CASE WHEN published_at IS NULL THEN 0.3 ELSE 1 END AS score) FROM ({_SCORED}) WHERE coalesce(similarity, 1) >= 0.28),
d AS (SELECT * REPLACE (round(score * CASE WHEN a > 1 THEN 0.8 ELSE 1 END * CASE WHEN b > 1 THEN 0.6 ELSE 1 END, 9) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(title_norm) ORDER BY score DESC, article_id) AS a, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY score DESC, article_id) AS b FROM s)),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, source_domain ORDER BY score DESC, article_id) <= 3)
SELECT query_id, article_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY k.score DESC, article_id) AS rank FROM k""",
    "candidates",
)
def w17_rank_pipeline(spark, sf_dir):
    return r.rank_pipeline(x.candidates(spark, sf_dir), x.as_of()).select("query_id", "article_id", F.round("score", 6).alias("score"), "rank")


@R.add(
    """WITH k AS (SELECT query_id, title_norm, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, article_id) AS rank FROM candidates QUALIFY rank <= 5),
w AS (SELECT query_id, rank, unnest(l) AS suggestion, unnest(range(len(l))) AS pos FROM (SELECT *, list_slice(list_filter(string_split(title_norm, ' '), lambda v: length(v) > 4), 1, 3) AS l FROM k)),
o AS (SELECT query_id, suggestion, min(rank * 10 + pos) AS first FROM w GROUP BY 1, 2)
SELECT query_id, suggestion, row_number() OVER (PARTITION BY query_id ORDER BY first, suggestion) AS n FROM o QUALIFY n <= 6""",
    "candidates",
)
def w18_related_queries(spark, sf_dir):
    ranked = r.top_n(x.candidates(spark, sf_dir).withColumn("score", c("fts_score")), 5)
    return r.related_queries(ranked)


# ---- text index and duplicates

_STOPS = sorted({w for v in ti.STOP.values() for w in v})
_INDEX = f"SELECT article_id AS id, language, len(w) AS length, unnest(w) AS term FROM (SELECT *, list_filter(regexp_extract_all(lower(clean_text), '{ti.WORD}'), lambda v: NOT list_contains(CASE language " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in ti.STOP.items()) + " ELSE [] END, v)) AS w FROM articles)"


_KEPT: dict[tuple[str, str], ti.TextIndex] = {}


def kept_index(spark, sf_dir) -> ti.TextIndex:
    """The index of all articles, built when a session first asks for it and kept for its later queries, as an index is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = ti.TextIndex(spark, new_path(spark, "index")).add(x.articles(spark, sf_dir), "article_id", "clean_text", "language")
    return _KEPT[key]


@R.add(f"SELECT language, term, count(*) AS postings, sum(tf)::BIGINT AS tf FROM (SELECT language, term, id, count(*) AS tf FROM ({_INDEX}) GROUP BY 1, 2, 3) GROUP BY 1, 2", "articles")
def i1_build_text_index(spark, sf_dir):
    index = ti.build_text_index(x.articles(spark, sf_dir), "article_id", "clean_text", "language")
    return index.groupBy("language", "term").agg(F.count("*").alias("postings"), F.sum("tf").alias("tf"))


@R.add(
    f"""WITH p AS (SELECT id, term, length, count(*) AS tf FROM ({_INDEX}) GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n, avg(length) AS al FROM (SELECT DISTINCT id, length FROM p)),
q AS (SELECT query_id, len(t) AS need, unnest(t) AS term FROM (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(query), '{ti.WORD}'), lambda v: NOT list_contains({_STOPS}, v))) AS t FROM queries)),
df AS (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, id, need, count(*) AS have, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score FROM p JOIN q USING (term) JOIN df USING (term), n GROUP BY 1, 2, 3)
SELECT query_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, id) AS rank FROM s WHERE have = need QUALIFY rank <= 10""",
    "articles",
    "queries",
)
def i2_search_text(spark, sf_dir):
    index = kept_index(spark, sf_dir)
    return ti.search_text(index.postings(), x.queries(spark, sf_dir), stats=index.stats()).withColumn("score", F.round("score", 4))


@R.add(
    f"""WITH p AS (SELECT id, term, length, count(*) AS tf FROM ({_INDEX}) GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n, avg(length) AS al FROM (SELECT DISTINCT id, length FROM p)),
f AS (SELECT p.* FROM p JOIN articles ON article_id = id WHERE source IN ('src0', 'src1', 'src2') AND published_at >= {TS} - to_days(20)),
q AS (SELECT query_id, unnest(t) AS term FROM (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(query), '{ti.WORD}'), lambda v: NOT list_contains({_STOPS}, v))) AS t FROM queries)),
b AS (SELECT query_id, list_last(string_split(lower(query), ' ')) AS term FROM queries), g AS (SELECT DISTINCT query_id, id FROM b JOIN f USING (term)), df AS (SELECT term, count(DISTINCT id) AS df FROM f GROUP BY 1),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score FROM f JOIN q USING (term) JOIN df USING (term), n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = q.query_id AND g.id = f.id) GROUP BY 1, 2)
SELECT query_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "articles",
    "queries",
)
def i2_search_text_any(spark, sf_dir):
    """Any term is enough, the query's last word must be absent; of three sources and the last 20 days."""
    a, index = x.articles(spark, sf_dir), kept_index(spark, sf_dir)
    recent = a.where(c("source").isin("src0", "src1", "src2") & (c("published_at") >= x.hours_ago(F.lit(480)))).select(c("article_id").alias("id"))
    q = x.queries(spark, sf_dir).withColumns({"any": F.lit(True), "without": F.slice(F.split("query", " "), -1, 1)})
    return ti.search_text(index.postings().join(recent, "id", "left_semi"), q, stats=index.stats()).withColumn("score", F.round("score", 4))


_PARTS = "article_id % 3 <> 0", "article_id % 3 = 0 OR article_id % 5 = 0", "article_id % 10 = 0"


@R.add(
    f"""WITH f AS (SELECT article_id, language, CASE WHEN article_id % 5 = 0 AND article_id % 10 <> 0 THEN clean_text || ' edited again' ELSE clean_text END AS clean_text FROM articles WHERE article_id % 7 <> 0 OR article_id % 10 = 0)
SELECT language, term, count(*) AS postings, sum(tf)::BIGINT AS tf FROM (SELECT language, term, id, count(*) AS tf FROM ({_INDEX.replace("FROM articles", "FROM f")}) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "articles",
)
def i1_index_batches(spark, sf_dir):
    """Three batches: two thirds of the articles; the rest, and every fifth with its text changed; every tenth as it was before, while every seventh goes."""
    a = x.articles(spark, sf_dir).select("article_id", "language", "clean_text")
    edited = F.when(c("article_id") % 5 == 0, F.concat("clean_text", F.lit(" edited again"))).otherwise(c("clean_text"))
    batches = a.where(_PARTS[0]), a.where(_PARTS[1]).withColumn("clean_text", edited), a.where(_PARTS[2])
    index = ti.TextIndex(spark, new_path(spark, "index"))
    for batch, gone in zip(batches, (None, None, a.where("article_id % 7 = 0").select(c("article_id").alias("id"))), strict=True):
        index = index.add(batch, "article_id", "clean_text", "language", gone)
    return index.postings().groupBy("language", "term").agg(F.count("*").alias("postings"), F.sum("tf").alias("tf"))


@R.add(
    f"""WITH q AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '{ti.WORD}'), lambda v: NOT list_contains({_STOPS}, v)) AS t FROM benchmark),
w AS (SELECT article_id AS id, regexp_extract_all(lower(clean_text), '{ti.WORD}') AS w FROM articles), p AS (SELECT id, list_zip(w, w[2:]) AS p, w FROM w)
SELECT query_id, id FROM q, p WHERE len(t) >= 5 AND list_contains(w, t[1]) AND (list_contains(w, t[2]) OR list_contains(p, (t[3], t[4]))) AND NOT list_contains(w, t[5])""",
    "articles",
)
def i2_search_expressions(spark, sf_dir):
    """The first words of each benchmark item as an expression with AND, OR, NOT, brackets and a phrase; all hits."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(ti.WORD), F.lit(0)), lambda v: ~v.isin(_STOPS))
    q = x.table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), w.alias("t")).where(F.size("t") >= 5)
    index = kept_index(spark, sf_dir)
    return ti.search_expressions(index.postings(), q.select("query_id", F.format_string('%s AND (%s OR "%s %s") AND NOT %s', *(c("t")[i] for i in range(5))).alias("query")), 1 << 30, index.stats()).select("query_id", "id")


@R.add()
def i2_search_stemmed(spark, sf_dir):
    """The first four words of each benchmark item, found by their stems, by cover density."""
    a = x.articles(spark, sf_dir)
    index = ti.TextIndex(spark, new_path(spark, "index"), stems=True).add(a, "article_id", "clean_text", "language")
    return ti.search_expressions(index.postings(), x.queries(spark, sf_dir), stats=index.stats(), stems=True, order="cover")


@R.add(
    "WITH w AS (SELECT doc_id AS id, unnest(range(len(l))) AS pos, unnest(l) AS word FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda v: regexp_full_match(v, '[a-z]{4,}')) AS l FROM documents WHERE lang = 'en')) SELECT id, word, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos)) AS rank FROM w WHERE word NOT IN ('with', 'that', 'this', 'from') GROUP BY id, word QUALIFY rank <= 10"
)
def x11_keywords(spark, sf_dir):
    return ti.keywords(x.table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "text", ("with", "that", "this", "from"))


_HASHED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://\\S+', '', 'g'), '\\S+@\\S+', '', 'g'), '\\s+', ' ', 'g')), '\\(.*?reuters.*?\\)|\\(.*?breaking.*?\\)|\\(.*?updating.*?\\)', '', 'g'), '\\(.*?ap.*?\\)', '', 'g'), 'this story is developing.*|this is a breaking news.*', '', 'g'), 'more details to follow.*', '', 'g'))"
_COPIED_SQL = "SELECT article_id, source || '.co.uk' AS site, (article_id % 40)::VARCHAR AS path, " + _HASHED.format("substring(CASE WHEN article_id % 2 = 0 THEN language ELSE title_norm END, 1, 100)") + " AS title FROM articles"


def copied(spark, sf_dir):
    """Articles under urls that several have: http or https, with or without www, a page suffix and a tracking parameter; half titled by their language."""
    a = x.articles(spark, sf_dir)
    head = F.when(c("article_id") % 3 == 0, "https://www.").when(c("article_id") % 3 == 1, "http://m.").otherwise("https://")
    url = F.concat(head, "source", F.lit(".co.uk/"), (c("article_id") % 40).cast("string"), F.lit(".html?utm_source=x"))
    return a.select("article_id", url.alias("url"), F.when(c("article_id") % 2 == 0, c("language")).otherwise(c("title_norm")).alias("title_norm"), "clean_text", "published_at")


@R.add(f"SELECT site, path, title, count(*) AS n, min(article_id) AS first_id FROM ({_COPIED_SQL}) GROUP BY 1, 2, 3 HAVING count(*) > 1", "articles")
def d1_url_title_groups(spark, sf_dir):
    return ti.url_title_groups(copied(spark, sf_dir))


_SETS = "SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda v: v <> ''))) AS s FROM documents"


@R.add(
    f"""WITH d AS ({_SETS}), k AS (SELECT s, min(id) AS rep FROM d WHERE len(s) > 0 GROUP BY s), same AS (SELECT rep AS a, id AS b, 1.0 AS jaccard FROM d JOIN k USING (s) WHERE id <> rep),
w AS (SELECT rep AS id, len(s) AS n, unnest(s) AS word FROM k), p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS i FROM w x JOIN w y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2, 3, 4)
SELECT a, b, round(i / (na + nb - i), 6) AS jaccard FROM p WHERE 100 * i >= 80 * (na + nb - i) UNION ALL SELECT a, b, jaccard FROM same"""
)
def d2_near_dup_pairs(spark, sf_dir):
    return ti.near_dup_pairs(x.table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("jaccard", F.round("jaccard", 6))


@R.add("SELECT article_id AS id, m AS duplicate_of FROM (SELECT article_id, min(article_id) OVER (PARTITION BY text_hash) AS m FROM raw) WHERE article_id <> m", "raw")
def d4_exact_text_duplicates(spark, sf_dir):
    return ti.exact_text_duplicates(x.raw(spark, sf_dir), "article_id", "text_hash")
