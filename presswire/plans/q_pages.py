"""Queries of web pages and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.operators import pages as p
from presswire.plans import fixtures as x
from presswire.plans.registry import Registry

R = Registry()
c = F.col


@R.add()
def h1_extract_content(spark, sf_dir):
    return p.extract_pages(x.table(spark, sf_dir, "pages")).select("page_id", "title", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha"))


@R.add()
def h2_extract_media_links(spark, sf_dir):
    return p.extract_pages(x.table(spark, sf_dir, "pages")).select("page_id", F.size("images").alias("images"), F.size("videos").alias("videos"), F.array_join("outlinks", " ").alias("outlinks"), "top_image")


@R.add()
def h3_extract_metadata(spark, sf_dir):
    return p.extract_pages(x.table(spark, sf_dir, "pages")).select("page_id", "title", "lang", "canonical", F.array_join("authors", ",").alias("authors"), F.array_join("keywords", ",").alias("keywords"), "published")


@R.add()
def h4_parse_articles(spark, sf_dir):
    pages = x.table(spark, sf_dir, "pages")
    entries = pages.where("page_id % 2 = 0").select("url", F.concat(F.lit("Entry "), "page_id").alias("title"), F.lit("2024-01-30").alias("published")).dropDuplicates(["url"])
    found = p.parse_articles(pages, entries)
    return found.select("page_id", "canonical_url", "url_hash", "source", "title", "published", F.array_join("keywords", ",").alias("keywords"), "text_hash", "words", "minutes", "paywalled", "partial", "status", "reason")


@R.add()
def h5_outlink_edges(spark, sf_dir):
    return p.outlink_edges(x.table(spark, sf_dir, "pages"))


@R.add()
def c1_chunk_paragraphs(spark, sf_dir):
    return p.chunk_paragraphs(x.articles(spark, sf_dir), "article_id", "clean_text", paragraph=r"\n").select("id", "chunk_index", F.sha2("chunk_text", 256).alias("sha"), "char_start", "words")


@R.add()
def c2_denormalise_chunks(spark, sf_dir):
    a = x.articles(spark, sf_dir)
    return p.denormalise_chunks(p.chunk_paragraphs(a, "article_id", "clean_text", paragraph=r"\n"), a).select("id", "chunk_index", "url", "source_domain", "language", "published_at")


@R.add("SELECT article_id, CASE WHEN length(regexp_replace(clean_text, '^\\s+|\\s+$', '', 'g')) >= 100 THEN true ELSE chunking_completed END AS chunking_completed FROM articles_index", "articles_index")
def c2_completion(spark, sf_dir):
    """The index after its articles were cut into chunks: those that have any are done."""
    from presswire.sources.tables import apply_patches

    index = x.articles_index(spark, sf_dir)
    chunks = p.chunk_paragraphs(x.articles(spark, sf_dir), "article_id", "clean_text", paragraph=r"\n")
    return apply_patches(index.select("article_id", "chunking_completed"), p.completion_patches(chunks).select("article_id", "chunking_completed"), "article_id")
