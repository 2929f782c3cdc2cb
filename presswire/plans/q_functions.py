"""Queries of the scalar functions and of work selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.functions import text as t
from presswire.functions import urls as u
from presswire.operators import select as s
from presswire.plans import fixtures as x
from presswire.plans.fixtures import AS_OF
from presswire.plans.registry import Registry

R = Registry()
c = F.col
TS = f"TIMESTAMP '{AS_OF}'"
_NORM = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), 'https?://\\S+|www\\.\\S+', '', 'g'), '@\\w+|#\\w+', '', 'g'), '\\S+@\\S+', '', 'g'), '\\[.*?\\]|\\(.*?\\)', '', 'g'), '\\s*[-–—]\\s*', ' - ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = "len(list_filter(string_split(" + _NORM + ", ' '), lambda w: w <> ''))"


@R.add("SELECT article_id, regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www[.]', '') AS host, 'example.com' AS etld1, lower(regexp_extract(url, '^https?://[^/]*/(.*)$', 1)) AS path, true AS valid FROM articles", "articles")
def x4_x5_x6_article_urls(spark, sf_dir):
    a = x.articles(spark, sf_dir)
    return a.select("article_id", u.host(c("url")).alias("host"), u.registered_domain(c("url")).alias("etld1"), u.dedup_path(c("url")).alias("path"), u.is_valid_url(c("url")).alias("valid"))


@R.add()
def x6_resolved_links(spark, sf_dir):
    """Every link of the pages, as it stands and resolved."""
    p = x.table(spark, sf_dir, "pages")
    links = p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]*)"'))).alias("pos", "link"))
    return links.select("page_id", "pos", "link", u.resolve_relative_url(c("url"), c("link")).alias("resolved"))


@R.add()
def x1_x2_x3_page_urls(spark, sf_dir):
    p = x.table(spark, sf_dir, "pages")
    return p.select("page_id", u.canonicalize_url("url").alias("canonical"), u.normalize_url("url").alias("normal"), u.url_hash(c("url")).alias("url_hash"), u.registered_domain(c("url")).alias("etld1"))


@R.add(f"SELECT doc_id, sha256({_NORM.format('text')}) AS text_hash, {_WORDS.format('text')} AS words, CASE WHEN {_WORDS.format('text')} = 0 THEN 0 ELSE greatest(1, round_even({_WORDS.format('text')} / 200, 0)::INT) END AS minutes FROM documents WHERE {_NORM.format('text')} <> ''")
def x7_x10_text_hash_counts(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents")
    return d.where(t.normalize_text(c("text")) != "").select("doc_id", t.text_hash(c("text")).alias("text_hash"), t.word_count(c("text")).alias("words"), t.reading_time(c("text")).alias("minutes"))


@R.add(f"SELECT doc_id, sha256({_CLEAN.format('text')}) AS clean_sha, length({_CLEAN.format('text')}) AS clean_chars FROM documents")
def x8_clean_text(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(t.clean_text(c("text")), 256).alias("clean_sha"), F.length(t.clean_text(c("text"))).alias("clean_chars"))


_HASHED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://\\S+', '', 'g'), '\\S+@\\S+', '', 'g'), '\\s+', ' ', 'g')), '\\(.*?reuters.*?\\)|\\(.*?breaking.*?\\)|\\(.*?updating.*?\\)', '', 'g'), '\\(.*?ap.*?\\)', '', 'g'), 'this story is developing.*|this is a breaking news.*', '', 'g'), 'more details to follow.*', '', 'g'))"


@R.add(f"SELECT article_id, sha256({_HASHED.format('title_norm')} || '|' || {_HASHED.format('clean_text')}) AS content_hash FROM articles", "articles")
def x9_content_hash(spark, sf_dir):
    return x.articles(spark, sf_dir).select("article_id", t.content_hash(c("title_norm"), c("clean_text")).alias("content_hash"))


@R.add(
    f"""SELECT doc_id, list_sort(list_filter({list(t.PAYWALL_PHRASES)}, lambda p: contains(lower(text), p))) AS phrases, n < 50 AS very_short, CASE WHEN length(trim(split_part(text, chr(10), 1))) = 0 THEN 'error'
 WHEN len(list_filter(string_split({_NORM.format(_CLEAN.format('text'))}, ' '), lambda w: w <> '')) < 200 THEN 'partial' ELSE 'stored' END AS status FROM (SELECT *, {_WORDS.format('text')} AS n FROM documents) WHERE text <> ''"""
)
def x12_x13_paywall_status(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents").where("text <> ''")
    sig = t.paywall_signals(c("text"))["signals"]
    phrases = F.array_sort(F.transform(F.filter(sig, lambda v: v.startswith("paywall_phrase_")), lambda v: F.replace(F.replace(v, F.lit("paywall_phrase_"), F.lit("")), F.lit("_"), F.lit(" "))))
    return d.select("doc_id", phrases.alias("phrases"), F.array_contains(sig, "very_short_content").alias("very_short"), t.article_status(F.split_part("text", F.lit("\n"), F.lit(1)), c("text")).alias("status"))


_SET = "list_distinct(list_filter(string_split(" + _HASHED + ", ' '), lambda w: w <> ''))"
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct({0} || {1})) END"


@R.add(
    f"""WITH s AS (SELECT article_id, {_SET.format('title_norm')} AS x, {_SET.format('clean_text')} AS y, {_HASHED.format('title_norm')} || '|' || {_HASHED.format('clean_text')} AS h FROM articles),
k AS (SELECT article_id, row_number() OVER (PARTITION BY source, length(clean_text) // 50 ORDER BY article_id) AS n, source, length(clean_text) // 50 AS size FROM articles),
p AS (SELECT a.article_id AS a, b.article_id AS b FROM articles a JOIN articles b ON b.article_id = a.article_id + 1 UNION SELECT a.article_id, b.article_id FROM k a JOIN k b ON a.source = b.source AND a.size = b.size AND b.n = a.n + 1)
SELECT a, b, round({_JACCARD.format('i.x', 'j.x')}, 6) AS jaccard, i.h = j.h OR {_JACCARD.format('i.x', 'j.x')} >= 0.7 OR {_JACCARD.format('i.y', 'j.y')} >= 0.8 AS duplicate FROM p JOIN s i ON i.article_id = a JOIN s j ON j.article_id = b""",
    "articles",
)
def x14_title_jaccard(spark, sf_dir):
    """Articles of neighbouring ids, and neighbours among those of one source and about one length."""
    from pyspark.sql import Window

    from presswire.operators.textindex import alike, duplicate_marks, marked_duplicate
    from presswire.sources.scratch import written

    a = x.articles(spark, sf_dir)
    size = F.floor(F.length("clean_text") / 50)
    nexts = a.select(c("article_id").alias("a"), F.lead("article_id").over(Window.partitionBy("source", size).orderBy("article_id")).alias("b")).where("b IS NOT NULL")
    pairs = a.select(c("article_id").alias("a"), (c("article_id") + 1).alias("b")).union(nexts).distinct()
    clean = a.select("article_id", t.clean_for_hash(c("title_norm")).alias("title"), t.clean_for_hash(c("clean_text")).alias("body"))
    marks = written(clean.select("article_id", duplicate_marks(c("title"), c("body")).alias("m")), "marks")
    found = pairs.join(marks.select(c("article_id").alias("a"), c("m").alias("ma")), "a").join(marks.select(c("article_id").alias("b"), c("m").alias("mb")), "b")
    return found.select("a", "b", F.round(alike(c("ma.title"), c("mb.title")), 6).alias("jaccard"), marked_duplicate(c("ma"), c("mb")).alias("duplicate"))


@R.add(f"SELECT article_id, round(coalesce(least(1.0, greatest(0.0, exp(-(epoch({TS}) - epoch(published_at)) / 3600 / 72))), 0.0), 6) AS freshness, CASE WHEN published_at IS NULL THEN 0.3::DOUBLE ELSE 1.0 END AS date_factor FROM articles", "articles")
def x15_x18_freshness(spark, sf_dir):
    return x.articles(spark, sf_dir).select("article_id", F.round(t.freshness(c("published_at"), x.as_of()), 6).alias("freshness"), F.when(c("published_at").isNull(), 0.3).otherwise(1.0).alias("date_factor"))


@R.add(f"SELECT conv_id, turn, len(list_filter({list(t.EVERGREEN)}, lambda w: contains(lower(text), w))) > 0 AS evergreen FROM conversations")
def x16_is_evergreen(spark, sf_dir):
    return x.table(spark, sf_dir, "conversations").select("conv_id", "turn", t.is_evergreen(c("text")).alias("evergreen"))


@R.add()
def x19_mask_pii(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(t.mask_pii(c("text")), 256).alias("masked_sha"), F.array_join(t.detect_pii(c("text")), ",").alias("kinds"))


@R.add(
    "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%'))) AS percents, len(list_distinct(regexp_extract_all(text, '\\$[\\d,]+(?:\\.\\d{2})?(?:\\s?(?:million|billion|trillion))?'))) AS sums FROM documents"
)
def x20_regex_entities(spark, sf_dir):
    e = t.regex_entities(c("text"), 1_000_000)
    return x.table(spark, sf_dir, "documents").select("doc_id", F.size(e["percent"]).alias("percents"), F.size(e["money"]).alias("sums"))


@R.add("SELECT doc_id, CASE WHEN regexp_matches(text, 'invest|fund|acqui') THEN 'influences' WHEN regexp_matches(text, 'partner|collaborat') THEN 'relates_to' WHEN regexp_matches(text, 'mention|discuss|said') THEN 'mentions' ELSE 'relates_to' END AS relation FROM documents")
def x23_relation_type(spark, sf_dir):
    return x.table(spark, sf_dir, "documents").select("doc_id", t.relation_type(c("text")).alias("relation"))


@R.add("SELECT article_id, length(substring(clean_text, 1, 2000)) AS chars, sha256(CASE WHEN title_norm <> '' AND l <> '' THEN title_norm || '. ' || l ELSE title_norm || l END) AS embed_sha FROM (SELECT *, substring(split_part(trim(clean_text), chr(10), 1), 1, 280) AS l FROM articles)", "articles")
def x26_x27_model_inputs(spark, sf_dir):
    return x.articles(spark, sf_dir).select("article_id", F.length(t.truncate_for_model(c("clean_text"), 500)).alias("chars"), F.sha2(t.embed_input_text(c("title_norm"), c("clean_text")), 256).alias("embed_sha"))


@R.add(
    "SELECT conv_id, turn, trim(concat_ws(' ', trim(text), "
    + ", ".join(f"CASE WHEN contains(lower(trim(text)), '{k}') AND NOT contains(lower(trim(text)), '{v}') THEN '{v}' END" for k, vs in t.SYNONYMS.items() for v in vs)
    + ")) AS expanded FROM conversations"
)
def x29_expand_query(spark, sf_dir):
    return x.table(spark, sf_dir, "conversations").select("conv_id", "turn", t.expand_query(c("text")).alias("expanded"))


@R.add(
    """SELECT user_id, CASE WHEN list_reduce(list_prepend(0, list_transform(range(1, 33), lambda i: (strpos('0123456789abcdef', md5(user_id || ':exp1')[i]) - 1)::BIGINT)), lambda a, b: (a * 16 + b) % 10000) < 5000 THEN 'control' ELSE 'variant' END AS arm
 FROM (SELECT DISTINCT user_id FROM events)"""
)
def x30_assign_arm(spark, sf_dir):
    e = x.table(spark, sf_dir, "events").select("user_id").distinct()
    return e.select("user_id", t.assign_arm(c("user_id"), "exp1", [("control", 0.5), ("variant", 0.5)]).alias("arm"))


def _trend_case(expr: str) -> str:
    whens = " ".join(f"WHEN len(list_filter({list(terms)}, lambda w: contains({expr}, w))) > 0 THEN '{topic}'" for topic, terms in t.TREND_TERMS.items())
    return f"CASE {whens} ELSE 'general' END"


@R.add(f"SELECT doc_id, {_trend_case('k')} AS category FROM (SELECT doc_id, lower(text) AS k FROM documents)")
def x32_categorize_trend(spark, sf_dir):
    return x.table(spark, sf_dir, "documents").select("doc_id", t.categorize_trend(F.split("text", " ")).alias("category"))


@R.add(
    """SELECT event_id, w, CASE u WHEN 'h' THEN CASE WHEN n BETWEEN 1 AND 24 THEN n END WHEN 'd' THEN CASE WHEN n BETWEEN 1 AND 365 THEN n * 24 END WHEN 'w' THEN CASE WHEN n BETWEEN 1 AND 52 THEN n * 168 END
 WHEN 'm' THEN CASE WHEN n BETWEEN 1 AND 12 THEN n * 720 END WHEN 'mo' THEN CASE WHEN n BETWEEN 1 AND 12 THEN n * 720 END WHEN 'y' THEN CASE WHEN n BETWEEN 1 AND 5 THEN n * 8760 END END::INT AS hours
 FROM (SELECT event_id, (props->>'$.k')::INT AS n, ['h', 'd', 'w', 'm', 'mo', 'y', 'q'][event_id % 7 + 1] AS u, n || u AS w FROM events)"""
)
def f6_parse_window(spark, sf_dir):
    e = x.table(spark, sf_dir, "events")
    unit = F.element_at(F.array(*map(F.lit, ["h", "d", "w", "m", "mo", "y", "q"])), (c("event_id") % 7 + 1).cast("int"))
    w = e.select("event_id", F.concat(F.get_json_object("props", "$.k"), unit).alias("w"))
    return w.select("event_id", "w", t.parse_window(c("w")).alias("hours"))


@R.add(
    """SELECT event_id, CASE op WHEN '>' THEN value > th WHEN '<' THEN value < th WHEN '>=' THEN value >= th WHEN '<=' THEN value <= th WHEN '==' THEN abs(value - th) < 1e-4 ELSE NOT abs(value - th) < 1e-4 END AS fired, op, th::DOUBLE AS threshold
 FROM (SELECT event_id, value, ['>', '<', '>=', '<=', '==', '!='][event_id % 6 + 1] AS op, event_id % 100 AS th FROM events)"""
)
def x31_conditions(spark, sf_dir):
    e = x.table(spark, sf_dir, "events")
    op = F.element_at(F.array(*map(F.lit, [">", "<", ">=", "<=", "==", "!="])), (c("event_id") % 6 + 1).cast("int"))
    p = e.select("event_id", "value", t.parse_condition(F.concat_ws(" ", F.lit("ctr"), op, (c("event_id") % 100).cast("string"))).alias("p"))
    return p.select("event_id", t.eval_condition(c("value"), c("p.op"), c("p.threshold")).alias("fired"), "p.op", "p.threshold")


@R.add("SELECT user_id, CASE WHEN s > 0.1 THEN 'up' WHEN s < -0.1 THEN 'down' ELSE 'flat' END AS direction, round(greatest(0, 0.5 - w), 6) AS lo, round(least(1, 0.5 + w), 6) AS hi FROM (SELECT user_id, s, least(abs(s) / 2, 0.4) * least(n / 20, 1.0) AS w FROM (SELECT user_id, avg(value) / 100 - 0.1 AS s, count(*) AS n FROM events GROUP BY user_id))")
def x33_direction_interval(spark, sf_dir):
    e = x.table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 100 - 0.1).alias("s"), F.count("*").alias("n"))
    i = t.confidence_interval(c("s"), c("n"))
    return e.select("user_id", t.direction(c("s")).alias("direction"), F.round(i[0], 6).alias("lo"), F.round(i[1], 6).alias("hi"))


# ---- work selection


@R.add("SELECT feed_id, status, last_entry_date FROM feeds WHERE status = 'active'", "feeds")
def f1_feeds_due(spark, sf_dir):
    return s.feeds_due(x.feeds(spark, sf_dir)).select("feed_id", "status", "last_entry_date")


@R.add("SELECT article_id, created_at FROM raw WHERE status = 'pending'", "raw")
def f2_pending_articles(spark, sf_dir):
    return s.pending_articles(x.raw(spark, sf_dir)).select("article_id", "created_at")


@R.add("SELECT article_id, published_at FROM articles_index WHERE ready_for_chunking AND chunking_completed IS DISTINCT FROM TRUE", "articles_index")
def f3_ready_for_chunking(spark, sf_dir):
    return s.ready_for_chunking(x.articles_index(spark, sf_dir)).select("article_id", "published_at")


@R.add("SELECT chunk_id, fts_length IS NULL AS needs_fts, embedding IS NULL AS needs_vector FROM chunks WHERE fts_length IS NULL OR embedding IS NULL", "chunks")
def f4_chunks_to_index(spark, sf_dir):
    return s.chunks_to_index(x.chunks(spark, sf_dir)).select("chunk_id", c("fts_length").isNull().alias("needs_fts"), c("embedding").isNull().alias("needs_vector"))


@R.add(f"SELECT article_id, published_at FROM articles WHERE published_at BETWEEN {TS} - to_hours(168) AND {TS} AND language = 'en'", "articles")
def f5_recent(spark, sf_dir):
    return s.recent(x.articles(spark, sf_dir), x.as_of(), 168, language="en").select("article_id", "published_at")


@R.add("SELECT article_id FROM articles WHERE contains(lower(source), 'src1')", "articles")
def f8_smart_filter(spark, sf_dir):
    return s.smart_filter(x.articles(spark, sf_dir), "source", "SRC1").select("article_id")


@R.add("SELECT query_id, article_id, dropped::BIGINT AS dropped FROM (SELECT *, sum((coalesce(similarity, 1) < 0.28)::INT) OVER (PARTITION BY query_id) AS dropped FROM candidates) WHERE coalesce(similarity, 1) >= 0.28", "candidates")
def f9_filter_offtopic(spark, sf_dir):
    return s.filter_offtopic(x.candidates(spark, sf_dir)).select("query_id", "article_id", "dropped")


@R.add("SELECT request_id, pos::INT AS pos, chunk_id, chunk_text FROM (SELECT article_id AS request_id, row_number() OVER (PARTITION BY article_id ORDER BY chunk_id DESC) AS pos, chunk_id, chunk_text FROM chunks)", "chunks")
def f11_chunks_by_ids(spark, sf_dir):
    """Each article asks for an id that isn't there and for its chunks, the last first."""
    k = x.chunks(spark, sf_dir)
    r = k.groupBy(c("article_id").alias("request_id")).agg(F.reverse(F.array_sort(F.collect_list("chunk_id"))).alias("ids"))
    return s.chunks_by_ids(k, r.select("request_id", F.concat(F.array(F.lit(-1).cast("long")), "ids").alias("chunk_ids"))).select("request_id", "pos", "chunk_id", "chunk_text")


@R.add(f"SELECT feed_id FROM feeds WHERE last_entry_date IS NOT NULL AND date_diff('day', last_entry_date::DATE, {TS}::DATE) < 7 AND lang LIKE 'de%'", "feeds")
def f12_feed_quality_gate(spark, sf_dir):
    return s.feed_quality_gate(x.feeds(spark, sf_dir), x.as_of(), language="de").select("feed_id")


@R.add(
    f"""SELECT query_id, article_id FROM candidates JOIN (SELECT query_id AS q, CASE WHEN query_id % 3 > 0 THEN {TS} - to_hours(query_id * 10) END AS after, CASE WHEN query_id % 2 = 0 THEN {TS} - to_hours(24) END AS before,
 CASE WHEN query_id % 5 = 0 THEN '1.example.com' END AS site FROM queries) b ON q = query_id
 WHERE coalesce(published_at >= after, after IS NULL) AND coalesce(published_at <= before, before IS NULL) AND coalesce(suffix(source_domain, site), site IS NULL)""",
    "candidates",
)
def f14_date_range_filter(spark, sf_dir):
    q = x.queries(spark, sf_dir)
    bounds = q.select("query_id", F.when(c("query_id") % 3 > 0, x.hours_ago(c("query_id") * 10)).alias("after"), F.when(c("query_id") % 2 == 0, x.hours_ago(F.lit(24))).alias("before"), F.when(c("query_id") % 5 == 0, "1.example.com").alias("site"))
    return s.date_range_filter(x.candidates(spark, sf_dir), bounds).select("query_id", "article_id")


_DOMAINS = [*s.BLACKLIST, *s.WHITELIST, *(f"site{i}.example.org" for i in range(12))]


@R.add(
    f"""WITH a AS (SELECT language, 'www.' || {_DOMAINS}[article_id % {len(_DOMAINS)} + 1] AS d FROM articles),
b AS (SELECT language, len(list_filter({list(s.BLACKLIST)}, lambda n: contains(d, n))) > 0 AS bad, len(list_filter({list(s.WHITELIST)}, lambda n: contains(d, n))) > 0 AS good FROM a)
SELECT language, round(avg(CASE WHEN good THEN 1 ELSE 0.7 END::DOUBLE), 6) AS trust, count(*) AS n FROM b WHERE NOT bad GROUP BY language""",
    "articles",
)
def f15_domain_trust(spark, sf_dir):
    """Articles as of listed domains and others, in turn."""
    named = F.get(F.array(*map(F.lit, _DOMAINS)), (c("article_id") % len(_DOMAINS)).cast("int"))
    a = s.drop_unsafe_domains(x.articles(spark, sf_dir).withColumn("source_domain", F.concat(F.lit("www."), named)))
    return a.groupBy("language").agg(F.round(F.avg(s.domain_trust(c("source_domain"))), 6).alias("trust"), F.count("*").alias("n"))


@R.add(
    f"""WITH h AS (SELECT *, (epoch({TS}) - epoch(published_at)) / 3600 AS age FROM candidates WHERE language = 'en' AND source_domain IN ('src1.example.com', 'src2.example.com', 'src3.example.com')),
s AS (SELECT *, CASE WHEN age BETWEEN 0 AND 6 THEN 6 WHEN age BETWEEN 0 AND 12 THEN 12 WHEN age BETWEEN 0 AND 24 THEN 24 WHEN age BETWEEN 0 AND 72 THEN 72 WHEN age BETWEEN 0 AND 168 THEN 168 END AS w FROM h),
m AS (SELECT * FROM s WHERE w IS NOT NULL QUALIFY w = min(w) OVER (PARTITION BY query_id))
SELECT query_id, article_id, w AS window_hours, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, article_id) AS rank FROM m QUALIFY rank <= 10
UNION ALL SELECT query_id, article_id, NULL, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, article_id) AS rank FROM candidates WHERE query_id NOT IN (SELECT query_id FROM m) QUALIFY rank <= 10""",
    "candidates",
)
def f16_retrieve_with_fallback(spark, sf_dir):
    every = x.candidates(spark, sf_dir)
    own = every.where((c("language") == "en") & c("source_domain").isin("src1.example.com", "src2.example.com", "src3.example.com"))
    return s.retrieve_with_fallback(own, x.as_of(), wide=every).select("query_id", "article_id", "window_hours", "rank")


@R.add(f"SELECT count(*) FILTER (ts >= {TS} - to_days(14)) AS kept, count(*) FILTER (ts < {TS} - to_days(14)) AS deleted FROM search_logs", "search_logs")
def f17_retention_counts(spark, sf_dir):
    return s.retention_counts(x.search_logs(spark, sf_dir), x.as_of(), 14)


@R.add("SELECT article_id FROM articles WHERE NOT contains(url, 'src1') AND NOT contains(url, '/de/')", "articles")
def f17_delete_by_domain(spark, sf_dir):
    return s.delete_by_domain(x.articles(spark, sf_dir), ("SRC1", "/de/"), "url").select("article_id")


@R.add(f"SELECT event_id FROM search_logs WHERE ts >= {TS} - to_days(14)", "search_logs")
def f17_apply_retention(spark, sf_dir):
    return s.apply_retention(x.search_logs(spark, sf_dir), x.as_of(), 14).select("event_id")
