"""Odd rows: nulls, ties, single rows, zero vectors, late files, handmade pages and feeds."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire import queries as own
from presswire.functions import queries as q
from presswire.functions import text as t
from presswire.functions import urls as u
from presswire.operators import graph, joins, pages, ranking, textindex, trends, vectors
from presswire.sources import tables
from presswire.streaming import jobs

c = F.col


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(c("v"))).collect()]


def test_urls(spark):
    assert column(spark, lambda v: u.canonicalize_url(v), ["HTTP://Example.com:80/a/?utm_source=x&b=2&a=1#top", "example.com", None]) == ["http://example.com/a?a=1&b=2", "http://example.com/", None]
    assert column(spark, lambda v: u.normalize_url(v), ["http://Ex.com/a?b=1&ref=2&a=3#f", "ftp://x.y/"]) == ["https://ex.com/a?b=1&a=3", ""]
    assert column(spark, u.registered_domain, ["https://www.news.example.co.uk:8080/x", "a.b.c.com", "localhost", None]) == ["example.co.uk", "c.com", "localhost", None]
    assert column(spark, u.dedup_path, ["https://x.com/A/b.html?utm_source=1&z=1&b=2", "https://x.com"]) == ["a/b?b=2&z=1", ""]
    assert column(spark, u.is_valid_url, ["https://a.b", "ftp://a.b", "https://ab", None]) == [True, False, False, False]


def test_texts(spark):
    assert column(spark, t.text_hash, [None, "  ", "a  b"])[:2] == ["", ""]
    assert column(spark, t.reading_time, ["", "a", "w " * 300, "w " * 500]) == [0, 1, 2, 2]
    assert column(spark, t.mask_pii, ["call 123-45-6789"]) == ["call [REDACTED]_SSN"]
    assert column(spark, t.parse_window, ["6h", "25h", "1mo", "0d", "x", None, "2W", "6y"]) == [6, None, 720, None, None, None, 336, None]
    assert column(spark, lambda v: t.parse_condition(v)["op"], ["ctr >= 0.5", "nonsense"]) == [">=", None]


def test_arms_share_and_match_python(spark):
    import hashlib

    got = column(spark, lambda v: t.assign_arm(v, "e", [("a", 0.8), ("b", 0.2)]), [f"user{i}" for i in range(1000)])
    want = ["a" if int(hashlib.md5(f"user{i}:e".encode()).hexdigest(), 16) % 10000 / 10000 < 0.8 else "b" for i in range(1000)]
    assert got == want and 700 < got.count("a") < 900


def test_intents(spark):
    # names are looked for whatever the case, so any two words count as one
    texts = ["site:x.com foo", "what is photosynthesis", "latest news about Ukraine", "Foo", "why", "nothing"]
    assert [tuple(r) for r in column(spark, q.intent, texts)] == [("news_current_events", 1.0), ("news_current_events", 0.7), ("news_current_events", 0.9), ("news_current_events", 0.6), ("general_qa", 0.9), ("general_qa", 0.5)]


def test_minmax_single_and_equal(spark):
    df = spark.createDataFrame([(1, 1, 7.0), (2, 1, 3.0), (2, 2, 3.0)], "query_id int, article_id int, s double")
    assert sorted(tuple(r) for r in ranking.minmax_normalize(df, "s").collect()) == [(1, 1, 7.0), (2, 1, 0.5), (2, 2, 0.5)]


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id long, article_id long, score double, source_domain string, published_at timestamp, embedding array<float>")


def test_mmr_prefers_the_different(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 1.0, "a.com", at, [1.0, 0.0]), (1, 2, 0.95, "a.com", at, [1.0, 0.0]), (1, 3, 0.6, "b.com", None, [0.0, 1.0]), (2, 4, 0.5, "a.com", None, None)]
    got = {(r["query_id"], r["rank"]): r["article_id"] for r in ranking.mmr_select(results(spark, rows), 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (2, 1): 4}


def test_gap_and_domains(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, i, 1.0 - i / 10, d, at + dt.timedelta(hours=h) if h is not None else None, None) for i, (d, h) in enumerate([("a", 0), ("a", 1), ("a", 5), ("b", None), ("c", 20)])]
    assert sorted(r["article_id"] for r in ranking.temporal_gap(results(spark, rows)).collect()) == [0, 2, 3, 4]
    got = sorted((r["rank"], r["article_id"]) for r in ranking.ensure_min_domains(results(spark, rows), 3, 3).collect())
    assert [a for _, a in got] == [0, 4, 3]


def test_fusion_ranks_what_both_found(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, article_id long, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, article_id long, rank int")
    got = ranking.rrf_fuse(one, two, limit=3).orderBy("rank").collect()
    assert got[0]["article_id"] == 11 and len({r["article_id"] for r in got}) == 3


def test_vectors_of_zero_and_wrong_length(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "id long, embedding array<float>")
    got = [(r["id"], round(r["similarity"], 4)) for r in vectors.vector_topk(items, items.where("id = 1"), "id", "id", 10).orderBy("rank").collect()]
    assert got == [(1, 1.0), (5, 0.7071), (2, 0.0)]


def test_ann_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.25 * rng.normal(size=16)).tolist()) for i in range(1500)]
    items = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = items.where("id % 50 = 0")
    index, middle = vectors.ann_build(items, "id", 16)
    found = {(r["query"], r["id"]) for r in vectors.ann_search(index, middle, asked, "id", probes=6).collect()}
    exact = {(r["query"], r["id"]) for r in vectors.vector_topk(items, asked, "id", "id").collect()}
    assert len(found & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_ann_recall(spark, sf):
    """The registered search on the given embeddings finds nine tenths of what the exact one does, each once."""
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    rows = [(r["query"], r["id"]) for r in own.QUERIES["v2_ann_search"](spark, path).collect()]
    exact = {(r["query"], r["id"]) for r in own.QUERIES["v1_vector_topk"](spark, path).collect()}
    assert len(rows) == len(set(rows))
    assert len(exact.intersection(rows)) / len(exact) >= 0.9
    report = own.QUERIES["v2_ann_recall"](spark, path).first()
    assert report["recall"] >= 0.9 and report["compared_share"] <= 0.1


def test_dbscan_against_plain_numpy(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(1, 8)) + 0.15 * rng.normal(size=(30, 8)) for _ in range(4)] + [rng.normal(size=(15, 8))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<float>")
    unit = vectors.unit(points.astype(np.float32).astype(np.float64))
    near = 1 - unit @ unit.T <= 0.1
    core = near.sum(axis=1) >= 5
    label = np.full(len(points), -1)
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            queue, label[i] = [i], i
            while queue:
                for k in np.flatnonzero(near[queue.pop()] & core):
                    if label[k] < 0:
                        label[k] = i
                        queue.append(k)
    want = [label[i] if core[i] else min([label[k] for k in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(points))]
    got = {r["id"]: r["cluster"] for r in vectors.dbscan_cosine(df, "id", 0.1, 5, block=40).collect()}
    assert [got[i] for i in range(len(points))] == want


@pytest.mark.parametrize("parts", [1, 64])
def test_components_chain_and_star(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_series(spark):
    df = spark.createDataFrame([("a", [1, 1, 1]), ("b", [0] * 40 + [5] * 8), ("c", [1, 0] * 20 + [0] * 7 + [9])], "cluster string, series array<int>")
    got = {r["cluster"]: (r["momentum"], r["burst"]) for r in trends.momentum_burst(df).collect()}
    assert got["a"] == (0.0, 0) and got["b"][0] == 39.0 and got["c"][1] == 2
    one = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", None)], "topic string, published_at timestamp")
    assert [tuple(r) for r in trends.ewma_slope(one, "topic").select("topic", "ewma", "slope").collect()] == [("a", 0.0, 0.0)]


def test_near_dup_pairs_of_copies(spark):
    words = [f"w{i}" for i in range(20)]
    docs = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:18] + ["x"])), (4, ""), (5, None), (6, "other words")]
    got = {(r["a"], r["b"]): round(r["jaccard"], 4) for r in textindex.near_dup_pairs(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect()}
    assert got == {(1, 2): 1.0, (1, 3): round(18 / 21, 4)}


def test_merge_keeps_the_first(spark):
    schema = "article_id long, url string, pos long"
    old, new = spark.createDataFrame([(1, "a", 0)], schema), spark.createDataFrame([(1, "z", 0), (2, "a", 1), (3, "c", 2), (4, "c", 3), (3, "d", 4)], schema)
    assert sorted(r["article_id"] for r in joins.merge_docs(old, new).collect()) == [1, 3]


PAGE = """<html lang="en"><head><title>Plain title</title><link rel="canonical" href="https://x.com/a">
<meta property="og:title" content="OG title"><meta name="author" content="Ann"><meta name="twitter:title" content="TW title">
<script type="application/ld+json">[{"@type": "NewsArticle", "headline": "LD title", "author": {"name": "Bob"}, "datePublished": "2024-01-02", "keywords": ["k1", "k2"]}]</script>
<script type="application/ld+json">{broken</script></head><body><nav>menu</nav><article><h1>Head</h1><p>First <b>bold</b> text.</p><p>First</p>
<div class="social">share me</div><figure><img src="big.jpg" width="300" height="200" alt="A"><figcaption>Cap tion</figcaption></figure><img src="dot.gif" width="1" height="1">
<iframe src="https://youtube.com/embed/1"></iframe><a href="https://other.org/p">o</a><a href="https://www.x.com/q">own</a></article><footer>foot</footer></body></html>"""


def test_page():
    p = pages.parse_page(1, "https://x.com/a", PAGE)
    assert p["title"] == "Plain title" and pages.parse_page(1, "u", PAGE, ("jsonld", "og", "meta"))["title"] == "LD title"
    assert p["authors"] == ["Ann", "Bob"] and p["keywords"] == ["k1", "k2"] and p["published"] == "2024-01-02"
    assert "menu" not in p["content"] and "share" not in p["content"] and "foot" not in p["content"] and "bold text." in p["content"]
    assert p["images"] == [{"src": "big.jpg", "alt": "A", "caption": "Cap tion"}] and p["top_image"] == "big.jpg"
    assert p["videos"] == ["https://youtube.com/embed/1"] and p["outlinks"] == ["https://other.org/p"] and p["canonical"] == "https://x.com/a"
    assert pages.parse_page(2, None, None)["content"] == ""


def test_chunks():
    text = "\n\n".join(" ".join(["word"] * 60) for _ in range(4))
    got = pages.paragraph_chunks(text, 100, 20, r"\n\s*\n")
    assert len(got) == 4 and got[0][2] == 0 and pages.paragraph_chunks("short", 100, 20, r"\n") == [] and pages.paragraph_chunks(None, 100, 20, r"\n") == []


def test_feed_entries(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>https://x.com/1</link><pubDate>Mon</pubDate></item><item><title>B</title><guid>https://x.com/2</guid></item></channel></rss>")
    assert [(r["url"], r["title"]) for r in tables.read_feed_entries(spark, str(tmp_path / "feed.xml")).orderBy("title").collect()] == [("https://x.com/1", "A"), ("https://x.com/2", "B")]


def test_late_rows_go_aside(spark, tmp_path):
    at = dt.datetime(2024, 1, 10)
    for k, days in enumerate([0, 1, -5]):
        spark.createDataFrame([(k, at + dt.timedelta(days=days))], "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fresh, late = jobs.split_late(jobs.read_stream(spark, str(tmp_path / "in"), 1), "ts")
    assert {r["event_id"] for r in fresh.collect()} == {0, 1} and {r["event_id"] for r in late.collect()} == {2}


def test_alerts_in_stream_equal_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=20 * i), i % 3, "m", float(i % 7)) for i in range(120)]
    m = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, metric string, value double")
    for k in range(3):
        m.where(f"event_id >= {40 * k} AND event_id < {40 * k + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    rules = spark.createDataFrame([("a", "m", ">", 4.0, 90)], "alert_id string, metric string, operator string, threshold double, cooldown_minutes int")
    streamed = jobs.collected(jobs.stream_alerts(jobs.read_stream(spark, str(tmp_path / "m"), 1), rules))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, jobs.batch_alerts(m, rules).collect()))


def test_ann_in_parts_finds_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400, None), (401, [1.0]), (402, [0.0] * 8)]
    items = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = items.where("id % 10 = 0")
    listed = lambda index, middle: sorted((r["query"], r["id"], r["rank"]) for r in vectors.ann_search(index, middle, asked, "id").collect())
    index, middle = vectors.ann_build(items, "id")
    whole = listed(index, middle)
    monkeypatch.setattr(vectors, "LIST_PART", 7)
    assert listed(index, middle) == whole and len(whole) == 400
    assert all(r["id"] not in (400, 401) for r in index.collect())


def plain_mmr(rows, k, weight):
    """Maximal marginal relevance pair by pair."""

    def alike(a, b):
        (va, da, ta), (vb, db, tb) = a[3:], b[3:]
        cosine = float(np.dot(va, vb) / (np.linalg.norm(va) * np.linalg.norm(vb)))
        same = 1.0 if da == db else 0.8 if da.split(".")[-2:-1] == db.split(".")[-2:-1] else 0.0
        near = math.exp(-abs((ta - tb).total_seconds()) / 3600 / 12) if ta and tb else 0.0
        return max(cosine, 0.3 * same, 0.2 * near)

    rest = sorted(rows, key=lambda r: (-r[2], r[1]))
    chosen = [rest.pop(0)]
    while rest and len(chosen) < k:
        best = max(rest, key=lambda r: weight * r[2] - (1 - weight) * max(alike(r, o) for o in chosen))
        rest.remove(best)
        chosen.append(best)
    return [r[1] for r in chosen]


def many_results(spark, n=150):
    rng = np.random.default_rng(17)
    start = dt.datetime(2024, 1, 1)
    rows = [(q, 1000 * q + i, round(float(rng.random()), 4), rng.normal(size=4).tolist(), f"news.site{rng.integers(6)}.{'com' if i % 2 else 'org'}", None if i % 11 == 0 else start + dt.timedelta(minutes=int(rng.integers(5000)))) for q in (1, 2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "query_id long, article_id long, score double, embedding array<double>, source_domain string, published_at timestamp")


def test_mmr_over_all_rows_against_plain_python(spark):
    rows, df = many_results(spark)
    got = {q: [r["article_id"] for r in sorted(ranking.mmr_select(df, 12, 0.5).where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2)}
    assert got == {q: plain_mmr([r for r in rows if r[0] == q], 12, 0.5) for q in (1, 2)}


def test_temporal_gap_over_all_rows_against_plain_python(spark):
    rows, df = many_results(spark, 250)
    want = set()
    for q in (1, 2):
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            if r[5] is None or all(abs((r[5] - o).total_seconds()) >= 7200 for o in kept):
                want.add(r[1])
                kept += [r[5]] if r[5] else []
    assert {r["article_id"] for r in ranking.temporal_gap(df).collect()} == want


def test_min_domains_looks_at_every_row(spark):
    rows = [(1, i, 1.0 - i / 1000, "a.com") for i in range(300)] + [(1, 300, 0.1, "b.com"), (1, 301, 0.05, "c.com"), (1, 302, 0.01, "d.com")]
    df = spark.createDataFrame(rows, "query_id long, article_id long, score double, source_domain string")
    assert sorted(r["article_id"] for r in ranking.ensure_min_domains(df).collect()) == [0, 1, 2, 300, 301]


def test_word_cooccurrence_against_windows(spark):
    texts = ["a b a c d", "x y z", "q", "", None, "one two three four five one two"]
    want = {}
    for text in texts:
        w = (text or "").split(" ")
        for s in range(len(w) - 3):
            for i in range(4):
                for k in range(i + 1, 4):
                    if w[s + i] != w[s + k]:
                        key = tuple(sorted((w[s + i], w[s + k])))
                        want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("split(t, ' ') AS words")
    assert {(r["a"], r["b"]): r["weight"] for r in joins.word_cooccurrence(df).collect()} == {k: v for k, v in want.items() if v >= 2}


def test_paths_against_plain_search(spark):
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(rng.choice(9, 2, replace=False).tolist())) for _ in range(18)}
    edges = [(a, b, None if (a + b) % 7 == 0 else round(float(rng.random()), 3)) for a, b in sorted(pairs)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, 0.5 if w is None else w))
        near.setdefault(b, []).append((a, 0.5 if w is None else w))
    found = set()

    def walk(path, total):
        if len(path) > 1 and path[-1] == 8:
            found.add((tuple(path), round(min(1.0, total / (len(path) - 1) / (1 + 0.1 * len(path))), 9)))
        elif len(path) <= 4:
            for o, w in near.get(path[-1], []):
                if o not in path:
                    walk([*path, o], total + w)

    walk([0], 0.0)
    got = graph.find_paths(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame([(0, 8)], "src long, dst long"), 4, 1000).collect()
    assert {(tuple(r["path"]), r["score"]) for r in got} == found


def test_feed_entries_have_keywords_and_enclosures(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(
        """<rss><channel><item><title>One</title><link>https://a/1</link><category>x</category><category>y</category><author>A</author><enclosure url="https://a/1.mp3" type="audio/mpeg" length="12"/><pubDate>d1</pubDate></item>
<item><title>Two</title><guid>https://a/2</guid></item></channel></rss>"""
    )
    (tmp_path / "atom.xml").write_text(
        """<feed><entry><title>Three</title><id>tag:3</id><link rel="self" href="https://a/self"/><link rel="alternate" href="https://a/3"/><category term="t"/><updated>d3</updated></entry>
<entry><title>Four</title><id>https://a/4</id><link rel="alternate" href="https://a/other"/></entry></feed>"""
    )
    rss = {r["title"]: r for r in tables.read_feed_entries(spark, str(tmp_path / "rss.xml")).collect()}
    assert (rss["One"]["url"], rss["One"]["keywords"], rss["One"]["authors"]) == ("https://a/1", ["x", "y"], ["A"])
    assert [tuple(e) for e in rss["One"]["enclosures"]] == [("https://a/1.mp3", "audio/mpeg", 12)]
    assert (rss["Two"]["url"], rss["Two"]["keywords"], rss["Two"]["enclosures"], rss["Two"]["published"]) == ("https://a/2", [], [], None)
    atom = {r["title"]: r for r in tables.read_feed_entries(spark, str(tmp_path / "atom.xml"), "entry").collect()}
    assert (atom["Three"]["url"], atom["Three"]["keywords"], atom["Three"]["published"]) == ("https://a/3", ["t"], "d3")
    assert atom["Four"]["url"] == "https://a/4"


def test_ingest_and_late_rows_across_restarts(spark, tmp_path):
    where, base, line = (f"file://{tmp_path}/{n}" for n in ("checkpoint", "stored", "late"))
    day = lambda d: dt.datetime(2024, 1, d)
    put = lambda i, rows: spark.createDataFrame(rows, "url_hash string, created_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema("url_hash string, created_at timestamp").parquet(f"{tmp_path}/in/*")
    put(1, [("a", day(1)), ("a", day(1)), ("b", day(20))])
    assert sorted(r["url_hash"] for r in jobs.ingest_new(read(), base, where).collect()) == ["a", "b"]
    fresh, late = jobs.split_late(read(), "created_at", 48, line, where + "2")
    assert (fresh.count(), late.count()) == (3, 0)
    put(2, [("a", day(25)), ("c", day(26)), ("d", day(2))])
    assert sorted(r["url_hash"] for r in jobs.ingest_new(read(), base, where).collect() if r["url_hash"] != "d") == ["a", "b", "c"]
    fresh, late = jobs.split_late(read(), "created_at", 48, line, where + "2")
    assert (fresh.count(), [r["url_hash"] for r in late.collect()]) == (5, ["d"])


def test_memory_access_is_counted(spark):
    m = spark.createDataFrame([(1, 2), (2, None), (3, 5)], "memory_id long, access_count int")
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 2)), (2, dt.datetime(2024, 1, 3))], "memory_id long, accessed_at timestamp")
    got = {r["memory_id"]: (r["access_count"], r["last_accessed_at"]) for r in vectors.counted_access(m, log).collect()}
    assert got == {1: (4, dt.datetime(2024, 1, 2)), 2: (1, dt.datetime(2024, 1, 3)), 3: (5, None)}


def test_chunks_cover_whole_texts(spark):
    text = "\n".join(f"paragraph {i} " + "word " * 60 for i in range(300))
    got = pages.chunk_paragraphs(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, t string"), "id", "t", paragraph=r"\n").collect()
    assert " ".join(r["chunk_text"].replace("\n", " ") for r in sorted(got, key=lambda r: r["chunk_index"])).split() == text.split() and {r["id"] for r in got} == {1}
    assert len(pages.chunk_paragraphs(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", max_chunks=4, paragraph=r"\n").collect()) == 4


def test_outlink_edges_count_other_domains(spark):
    html = '<html><body><article><p>{}</p></article>{}</body></html>'
    link = lambda *urls: "".join(f'<a href="{v}">x</a>' for v in urls)
    rows = [(1, "https://www.x.com/a", html.format("text " * 60, link("https://other.org/1", "https://sub.other.org/2", "/own"))), (2, "https://x.com/b", html.format("text " * 60, link("https://other.org/3", "https://third.net/"))), (3, "https://y.com/", None)]
    got = {(r["source"], r["target"]): r["links"] for r in pages.outlink_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {("x.com", "other.org"): 3, ("x.com", "third.net"): 1}


def test_soft_relevance_counts_entities(spark):
    from presswire.operators import results as shown

    rows = [(1, i, "plain title", "plain body", "https://x.com/1", "x.com", e) for i, e in enumerate([["Marlin Works"], [], None])]
    df = spark.createDataFrame(rows, "query_id long, article_id long, title_norm string, clean_text string, url string, source_domain string, entities array<string>")
    got = {r["article_id"]: r["soft_score"] for r in shown.soft_relevance(df, spark.createDataFrame([(1, "marlin")], "query_id long, query string")).collect()}
    assert got[0] - got[1] == 1.5 and got[1] == got[2]


def test_retrieval_falls_back_to_wide_hits(spark):
    from presswire.operators import select

    now = dt.datetime(2024, 1, 31)
    rows = [(1, 1, now - dt.timedelta(hours=5), 0.5), (1, 2, now - dt.timedelta(hours=30), 0.9), (2, 3, now - dt.timedelta(days=300), 0.7)]
    schema = "query_id long, article_id long, published_at timestamp, fts_score double"
    wide = spark.createDataFrame([*rows, (2, 4, None, 0.8), (1, 5, now, 1.0)], schema)
    got = sorted((r["query_id"], r["article_id"], r["window_hours"], r["rank"]) for r in select.retrieve_with_fallback(spark.createDataFrame(rows, schema), F.lit(now), wide=wide).collect())
    assert got == [(1, 1, 6, 1), (2, 3, None, 2), (2, 4, None, 1)]


def test_search_with_any_and_without(spark):
    docs = spark.createDataFrame([(1, "red green", "en"), (2, "red blue", "en"), (3, "green", "en"), (4, "", "en"), (5, None, "en")], "id long, t string, l string")
    index = textindex.build_text_index(docs, "id", "t", "l")
    asked = spark.createDataFrame([(1, "red green", False, None), (2, "red green", True, None), (3, "red green", True, ["Blue"])], "query_id long, query string, any boolean, without array<string>")
    found = textindex.search_text(index, asked, stats=textindex.text_stats(docs, "t", "l")).collect()
    assert {k: sorted(r["id"] for r in found if r["query_id"] == k) for k in (1, 2, 3)} == {1: [1], 2: [1, 2, 3], 3: [1, 3]}
    plain = textindex.search_text(index, asked.select("query_id", "query")).collect()
    assert {(r["id"], r["score"]) for r in plain if r["query_id"] == 1} == {(r["id"], r["score"]) for r in found if r["query_id"] == 1}


def test_parsed_windows_and_sites(spark):
    asked = ["news today site:news.bbc.co.uk after:01/15/2024", "новости на этой неделе site:unknown.org", "plain", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(asked)], "i int, v string")
    got = [tuple(r[0]) if r[0] is not None else None for r in df.orderBy("i").select(q.parse_search_operators(c("v"), F.lit("2024-01-31").cast("timestamp"))).collect()]
    assert got[0] == ("bbc.co.uk", dt.date(2024, 1, 15), None, "24h", "news today")
    assert got[1] == (None, None, None, "7d", "новости на этой неделе")
    assert got[2] == (None, None, None, None, "plain")
