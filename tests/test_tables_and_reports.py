"""Buckets, sketches, links, duplicates, reports and events on small tables with odd rows."""

import datetime as dt
import os
import random
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.functions import urls
from presswire.operators import aggregates, ranking, results, textindex, trends
from presswire.operators import pages as pages_of
from presswire.sources import tables

#: The references of RFC 3986, section 5.4, and some more.
REFERENCES = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g a//b /a//b http://x.com/../y mailto:a@b javascript:void(0) HTTP://X.com/a".split() + [""]
BASES = ["http://a/b/c/d;p?q", "http://a", "http://a/", "https://www.x.com/a/b/?q=1#f", "http://a/b//c/d"]


def test_links_resolve_as_in_urllib(spark):
    rows = [(b, r) for b in BASES for r in REFERENCES] + [(None, "a"), ("http://a", None)]
    df = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolve_relative_url(F.col("b"), F.col("r")).alias("o"))
    for x in df.collect():
        assert x["o"] == (urljoin(x["b"], x["r"]) if x["b"] is not None and x["r"] is not None else None), (x["b"], x["r"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_links_of_pages(spark):
    from presswire.plans.q_functions import x6_resolved_links

    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()}
    found = x6_resolved_links(spark, "/root/testdata/sf0.001").collect()
    assert len(found) > 100
    for r in found:
        assert r["resolved"] == urljoin(pages[r["page_id"]], r["link"])


def test_buckets_that_a_batch_does_not_touch_keep_their_files(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "k long, v string, w long"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    old = [(i, f"v{i}", i) for i in range(300)] + [(None, "none", 0)]
    tables.write_bucketed(frame(old), path, ["k"], 16)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    batch = [(5, "new", 1), (1000, "more", 2)]
    for _ in range(2):  # a repeat changes nothing
        tables.upsert_bucketed(frame(batch), path, ["k"], lambda a, b: tables.upsert_rows(a, b, ["k"]), frame([]).schema, 16)
        found = sorted((tuple(r) for r in tables.read_bucketed(spark, path, frame([]).schema).drop("bucket").collect()), key=repr)
        assert found == sorted([r for r in old if r[0] != 5] + batch, key=repr)
        kept = [f for f, t in files().items() if before.get(f) == t]
        assert len(before) - len(kept) <= 2 and len(kept) >= 12
    patch = spark.createDataFrame([(7, "patched"), (8, None)], "k long, v string")
    tables.upsert_bucketed(patch, path, ["k"], lambda a, b: tables.apply_patches(a, b, "k"), frame([]).schema, 16)
    rows = {r["k"]: r["v"] for r in tables.read_bucketed(spark, path, frame([]).schema).collect()}
    assert (rows[7], rows[8], rows[9], len(rows)) == ("patched", "v8", "v9", 302)
    tables.upsert_bucketed(frame([]), path, ["k"], lambda a, b: tables.upsert_rows(a, b, ["k"]), frame([]).schema, 16)
    assert tables.read_bucketed(spark, path, frame([]).schema).count() == 302


def test_sketches_of_any_days_are_close(spark):
    rng = np.random.default_rng(3)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), int(u), "a" if u % 3 else "b", int(n), None if i % 500 == 0 else float(t)) for i, (u, n, t) in enumerate(zip(rng.integers(0, 6_000, 9_000), rng.integers(0, 4, 9_000), rng.lognormal(4, 1, 9_000), strict=True))]
    logs = spark.createDataFrame(rows, "ts timestamp, user_id long, search_method string, results_count int, response_time_ms double")
    sketches = aggregates.daily_search_sketches(logs).persist()
    for first, last in ((1, 31), (3, 3), (10, 20), (40, 50)):
        day = lambda d: F.lit(dt.date(2024, 1, 1) + dt.timedelta(days=d - 1))
        found = {r["search_method"]: r for r in aggregates.search_analytics_over(sketches, day(first), day(last)).collect()}
        some = [r for r in rows if dt.datetime(2024, 1, 1) + dt.timedelta(days=first - 1) <= r[0] < dt.datetime(2024, 1, 1) + dt.timedelta(days=last)]
        assert set(found) == {r[2] for r in some}
        for method, r in found.items():
            own = [x for x in some if x[2] == method]
            assert (r["searches"], r["zero_results"]) == (len(own), sum(x[3] == 0 for x in own))
            users = len({x[1] for x in own})
            assert abs(r["users"] - users) <= max(1, 4 * 0.0065 * users)
            times = np.sort([x[4] for x in own if x[4] is not None])
            for q in (50, 95, 99):
                assert abs(np.searchsorted(times, r[f"p{q}"]) / len(times) - q / 100) <= 0.012 + 1 / len(times)


def test_snapshots_and_gaps(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(t, at + dt.timedelta(hours=h), 0.1, 0.2, h) for t in ("Click", "view", "cliché") for h in range(5)]
    snapshots = spark.createDataFrame(rows, "topic string, ts timestamp, momentum double, sentiment double, volume long")
    found = aggregates.snapshot_history(snapshots, "CLI", 2).collect()
    assert sorted((r["topic"], r["volume"], r["n"]) for r in found) == [("Click", 3, 2), ("Click", 4, 1), ("cliché", 3, 2), ("cliché", 4, 1)]
    assert aggregates.snapshot_history(snapshots).count() == 15
    urls_of = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert tuple(tables.sync_gap(urls_of("a", "b", "b", None, "c"), urls_of("a")).first()) == (3, 1, 2)
    assert tuple(tables.sync_gap(urls_of(), urls_of("a")).first()) == (0, 1, -1)


def test_canonical_map_and_alternatives(spark):
    rows = [(i, "u" if i < 60 else f"x{i}", i == 7 or i >= 60, 7 if i < 60 else i, 59 if i < 60 else 0) for i in range(65)]
    c = spark.createDataFrame(rows, "article_id long, url string, is_canonical boolean, canonical_id long, alternatives long")
    refs = {r["article_id"]: r["canonical_id"] for r in ranking.canonical_refs(c).collect()}
    assert refs == {i: 7 for i in range(60) if i != 7}
    parts = ranking.alternatives(c, 20).collect()
    assert len(parts) == 3 and sorted(i for p in parts for i in p["alternative_ids"]) == sorted(refs)


def test_duplicates_of_titles_and_bodies(spark):
    body = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "Same title here", "a b", "same TITLE here", "c d", True), (2, "One", body, "Other", body + " w21", True), (3, "One", body, "Other", "none of it", False), (4, None, None, None, None, True), (5, "x", "b", "y", None, False), (6, "a b c d", "p", "a b c e", "q", False)]
    df = spark.createDataFrame(rows, "k int, title_a string, body_a string, title_b string, body_b string, want boolean")
    assert textindex.is_duplicate(df).where("duplicate <> want").select("k").collect() == []
    a = spark.createDataFrame([(1, "https://www.site.co.uk/p.html?utm_source=x", "A title"), (2, "http://m.site.co.uk/p", " a  TITLE "), (3, "http://site.co.uk/p", "Another"), (4, "http://other.co.uk/p", "A title"), (5, None, None)], "article_id long, url string, title_norm string")
    assert [tuple(r) for r in textindex.url_title_pairs(a).collect()] == [(1, 2)]
    assert [(r["site"], r["path"], r["n"], r["first_id"]) for r in textindex.url_title_groups(a).collect()] == [("site.co.uk", "p", 2, 1)]


def test_diversity(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "a", at, [1.0, 0.0]), (1, 2, "a", at + dt.timedelta(hours=5), [0.0, 2.0]), (1, 3, "b", None, [1.0, 1.0]), (1, 4, None, at, None), (2, 1, "a", None, [1.0, 0.0]), (3, 9, "z", at, None)]
    df = spark.createDataFrame(rows, "query_id long, article_id long, source_domain string, published_at timestamp, embedding array<double>")
    found = {r["query_id"]: r for r in results.diversity_report(df).collect()}
    mean = (0 + 2 * 0.5**0.5) / 3
    assert (found[1]["domains"], found[1]["ratio"], found[1]["domain_counts"], found[1]["span_hours"]) == (2, 0.5, {"a": 2, "b": 1}, 5.0)
    assert abs(found[1]["mean_similarity"] - mean) < 1e-9 and abs(found[1]["max_similarity"] - 0.5**0.5) < 1e-8 and abs(found[1]["diversity"] - 1 + mean) < 1e-9
    assert (found[2]["mean_similarity"], found[2]["max_similarity"], found[2]["diversity"], found[3]["domains"]) == (0.0, 0.0, 1.0, 1)


def test_records_by_rules(spark):
    rows = [(1, "t" * 30, "b", "https://ok.org/a", "2024-01-01"), (2, "", "b" * 60, "https://x.spam.com/a", "01.01.2024"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, body string, url string, date string")
    found = {r["id"]: set(r["violations"]) for r in results.validate_records(df, {"title": 20, "body": 50}).collect()}
    assert found == {1: {"title_long"}, 2: {"title_missing", "body_long", "date_form", "unsafe_domain"}, 3: {"title_missing", "date_form", "url_invalid"}}
    assert {r["id"]: r["violations"] for r in results.validate_records(df, rules=("unsafe_domain",)).collect()} == {1: [], 2: ["unsafe_domain"], 3: []}


def test_events_by_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 40)) if i % 9 else None, f"title {i}", rng.choice(["Ann Lee met Bob", "nobody", "In Paris", ""])) for i in range(80)]
    df = spark.createDataFrame(rows, "topic string, doc_id long, date date, title string, text string")
    want = {}
    for topic in "ab":
        anchor = event = None
        for _, i, d, title, text in sorted((r for r in rows if r[0] == topic and r[2]), key=lambda r: (r[2], r[1])):
            if anchor is None or (d - anchor).days > 3:
                anchor, event = d, i
            want.setdefault((topic, event), []).append((d, i, title, text))
    found = {(r["topic"], r["event"]): r for r in results.anchored_event_clusters(df, 3).collect()}
    assert set(found) == set(want)
    for k, docs in want.items():
        assert (found[k]["start"], found[k]["end"], found[k]["members"], found[k]["title"], found[k]["texts"]) == (docs[0][0], docs[-1][0], len(docs), docs[0][2], [d[3] for d in docs[:3]])
    names = {(r["topic"], r["event"], r["entity"]): r["n"] for r in results.enrich_events(results.event_members(df, 3)).collect()}
    for k, docs in want.items():
        assert names.get((*k, "Ann Lee"), 0) == sum(d[3].startswith("Ann") for d in docs)


def test_trends_of_two_topics(spark):
    """Two tight clusters and noise: sizes, dynamics, terms and the newest three, of the hours asked for."""
    rng = np.random.default_rng(2)
    at = dt.datetime(2024, 1, 31)
    topics = {0: ("storm hits coast", rng.normal(size=8)), 1: ("vote count goes on", rng.normal(size=8))}
    articles, chunks = [], []
    for i in range(40):
        title, centre = topics[i % 2]
        age = dt.timedelta(hours=i // 2 if i % 2 else (i // 2) % 3)  # the first topic is all of the last hours
        articles.append((i, f"{title} {i}", at - age if i != 39 else None))
        v = rng.normal(size=8) if i >= 36 else centre + 0.02 * rng.normal(size=8)
        chunks += [(i * 10 + k, i, k, v.tolist() if k == 0 else rng.normal(size=8).tolist()) for k in range(2)]
    a = spark.createDataFrame(articles, "article_id long, title_norm string, published_at timestamp").withColumns({"source": F.lit("s"), "language": F.lit("en")})
    c = spark.createDataFrame(chunks, "chunk_id long, article_id long, chunk_index int, embedding array<double>")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    found = {r["cluster"]: r for r in trends.build_trends(a, c, as_of, stop=("on",), eps=0.1).collect()}
    assert {k: r["size"] for k, r in found.items()} == {0: 18, 1: 18}
    assert found[0]["score"] > found[1]["score"] and "storm" in found[0]["keywords"] and "vote" in found[1]["keywords"]
    assert [m["article_id"] for m in found[0]["latest"]] == [0, 6, 12] and [m["article_id"] for m in found[1]["latest"]] == [1, 3, 5]
    short = {r["cluster"]: r["size"] for r in trends.build_trends(a, c, as_of, hours=6, eps=0.1).collect()}
    assert short[0] == 18 and 5 <= short[1] <= 7


def test_articles_from_pages_and_their_feed(spark):
    body = " ".join(f"<p>Council members met again and spoke of harbour works, harbour costs and ferry times in week {i}.</p>" for i in range(20))
    page = lambda head, content=body: f"<html lang='en'><head>{head}</head><body><article>{content}</article></body></html>"
    pages = [
        (1, "http://www.a.org/1?utm_source=x", page("<title>Own title</title><link rel='canonical' href='https://a.org/one'><meta name='keywords' content='k1, k2'><meta property='og:image' content='https://a.org/i.jpg'>")),
        (2, "http://a.org/2", page("")),
        (3, "http://a.org/3", page("", "<p>Subscribe to continue reading this short piece.</p>")),
        (4, None, None),
        (5, "http://a.org/5", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    entries = spark.createDataFrame([("http://a.org/2", "Fed title", "2024-01-02", ["Fed Author"], ["fed"], [{"href": "https://a.org/f.jpg"}]), ("http://a.org/2", "Z later", None, None, None, None), ("http://a.org/3", "Third", None, None, None, None), (None, "none", None, None, None, None)], "url string, title string, published string, authors array<string>, keywords array<string>, enclosures array<struct<href:string>>")
    found = {r["page_id"]: r for r in pages_of.parse_articles(df, entries).collect()}
    assert len(found) == 5
    one, two, three = (found[k] for k in (1, 2, 3))
    assert (one["canonical_url"], one["title"], one["keywords"], one["source"], one["status"], one["reason"]) == ("https://a.org/one", "Own title", ["k1", "k2"], "a.org", "stored", None)
    assert one["url_hash"] and one["words"] >= 200 and one["minutes"] >= 1 and one["text_hash"] == two["text_hash"]
    assert (two["title"], two["published"], two["authors"], two["keywords"], two["top_image"]) == ("Fed title", "2024-01-02", ["Fed Author"], ["fed"], "https://a.org/f.jpg")
    assert (three["title"], three["status"], three["paywalled"], three["reason"]) == ("Third", "partial", True, "paywalled")
    assert (found[4]["status"], found[4]["reason"], found[5]["status"]) == ("error", "no title", "error")
    alone = {r["page_id"]: r for r in pages_of.parse_articles(df, entries.select("url", "title", "published")).collect()}
    assert alone[2]["keywords"][0] == "harbour" and alone[2]["authors"] == []
    chunks = pages_of.chunk_paragraphs(spark.createDataFrame([(1, "x" * 150), (2, "short")], "article_id long, clean_text string"), "article_id", "clean_text")
    assert [tuple(r) for r in pages_of.completion_patches(chunks).collect()] == [(1, True, 1)]
