"""Web pages: main text, links and media, metadata, parsed articles, chunks. One pass of a small parser over each page, inside Spark's tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.functions import text as t
from presswire.functions.urls import canonicalize_url, host, registered_domain
from presswire.operators.textindex import own_words, top_words
from presswire.sources.scratch import written
from presswire.sources.tables import first_per_key

#: Fixed values.
SKIP_TAGS = ("script", "style", "nav", "header", "footer", "aside", "noscript")
SKIP_CLASSES = ("social", "share", "ad", "ads", "advertisement", "comments", "comment", "related", "sidebar")
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "blockquote", "tr", "section", "article")
EMBED_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "dailymotion.com")
VOID = ("br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr")
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "ReportageNewsArticle")

#: Pages whose results a task holds before it gives them on.
PAGES = 100

SCHEMA = "page_id long, url string, title string, content string, lang string, canonical string, authors array<string>, keywords array<string>, published string, images array<struct<src:string,alt:string,caption:string>>, videos array<string>, outlinks array<string>, top_image string"


class _Page(HTMLParser):
    """Collects text by container, links, media and metadata in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.texts: list[tuple[bool, str]] = []
        self.main = self.skip = 0
        self.meta: list[tuple[str, str]] = []
        self.title = self.lang = self.canonical = self._json = ""
        self.json: list[str] = []
        self.links: list[str] = []
        self.images: list[dict] = []
        self.videos: list[str] = []
        self.caption: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            self.meta.append(((a.get("property") or a.get("name") or "").lower(), a.get("content", "")))
        elif tag == "link" and a.get("rel") == "canonical":
            self.canonical = a.get("href", "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img" and a.get("src"):
            self.images.append({"src": a["src"], "alt": a.get("alt", ""), "caption": "", "w": a.get("width", ""), "h": a.get("height", "")})
        elif tag in ("video", "source") and a.get("src"):
            self.videos.append(a["src"])
        elif tag == "iframe" and any(h in a.get("src", "") for h in EMBED_HOSTS):
            self.videos.append(a["src"])
        if tag in BLOCK_TAGS:
            self.texts.append((self.main > 0, "\n"))
        if tag in VOID:
            return
        names = set((a.get("class", "") + " " + a.get("id", "")).lower().split())
        main, skip = tag in ("article", "main"), tag in SKIP_TAGS or bool(names & set(SKIP_CLASSES))
        self.stack.append((tag, main, skip))
        self.main += main
        self.skip += skip
        if tag == "figcaption":
            self.caption = []
        if tag == "script":
            self._json = a.get("type", "")

    def handle_endtag(self, tag: str) -> None:
        while self.stack and any(x[0] == tag for x in self.stack):
            name, main, skip = self.stack.pop()
            self.main -= main
            self.skip -= skip
            if name == tag:
                break
        if tag in BLOCK_TAGS:
            self.texts.append((self.main > 0, "\n"))
        if tag == "figcaption" and self.caption is not None:
            if self.images:
                self.images[-1]["caption"] = " ".join("".join(self.caption).split())
            self.caption = None

    def handle_data(self, data: str) -> None:
        tag = self.stack[-1][0] if self.stack else ""
        if tag == "script" and self._json == "application/ld+json":
            self.json.append(data)
        elif tag == "title":
            self.title += data
        elif not self.skip and data.strip():
            self.texts.append((self.main > 0, data))
        if self.caption is not None:
            self.caption.append(data)


def _content(page: _Page) -> str:
    """The text of article or main elements, or of the whole page; a text that has been there before is left out."""
    parts = [x for m, x in page.texts if m] if any(m and x != "\n" for m, x in page.texts) else [x for _, x in page.texts]
    seen, out = set(), []
    for x in parts:
        key = x.strip()
        if x != "\n" and (not key or key in seen):
            continue
        if x != "\n":
            seen.add(key)
        out.append(x)
    lines = [" ".join(line.split()) for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line)


def _articles(blocks: list[str]) -> Iterator[dict]:
    for block in blocks:
        try:
            found = json.loads(block)
        except ValueError:
            continue
        queue = found if isinstance(found, list) else [found]
        while queue:
            item = queue.pop(0)
            if isinstance(item, dict):
                queue += item.get("@graph", []) if isinstance(item.get("@graph"), list) else []
                kinds = item.get("@type")
                if any(k in ARTICLE_TYPES for k in (kinds if isinstance(kinds, list) else [kinds])):
                    yield item


def _names(value: object) -> list[str]:
    if isinstance(value, list):
        return [n for v in value for n in _names(v)]
    if isinstance(value, dict):
        return [str(value["name"])] if value.get("name") else []
    return [x.strip() for x in str(value).split(",") if x.strip()] if value else []


def parse_page(page_id: int, url: str | None, html: str | None, priority: tuple[str, ...] = ("meta", "twitter", "og", "jsonld")) -> dict:
    """Everything from one page; single values come from the first source of ``priority`` that has one, authors and keywords from all."""
    page = _Page()
    page.feed(html or "")
    page.close()
    meta = dict(reversed(page.meta))
    ld = list(_articles(page.json))
    first = lambda key: next((x[key] for x in ld if x.get(key)), "")
    values = {
        "meta": {"title": page.title, "published": meta.get("date", "")},
        "twitter": {"title": meta.get("twitter:title", "")},
        "og": {"title": meta.get("og:title", ""), "published": meta.get("article:published_time", "")},
        "jsonld": {"title": first("headline"), "published": first("datePublished")},
    }
    pick = lambda key: next((str(v) for p in priority if (v := values[p].get(key))), "")
    host = re.sub(r"^www\.", "", re.sub(r"^[a-z]+://", "", (url or "").lower()).split("/")[0])
    outer = [x for x in page.links if x.startswith("http") and re.sub(r"^www\.", "", re.sub(r"^[a-z]+://", "", x.lower()).split("/")[0]) != host]
    size = lambda x, k: int(x[k]) if x[k].isdigit() else None
    images = [x for x in page.images if not any((v := size(x, k)) is not None and v < 50 for k in "wh")]
    large = [x["src"] for x in images if (size(x, "w") or 0) >= 200 and (size(x, "h") or 0) >= 150]
    return {
        "page_id": page_id,
        "url": url,
        "title": " ".join(pick("title").split()),
        "content": _content(page),
        "lang": page.lang or meta.get("og:locale", ""),
        "canonical": page.canonical or meta.get("og:url", ""),
        "authors": list(dict.fromkeys([*_names(meta.get("author")), *_names(meta.get("article:author")), *(n for x in ld for n in _names(x.get("author")))])),
        "keywords": list(dict.fromkeys([*_names(meta.get("keywords")), *_names(meta.get("article:tag")), *(n for x in ld for n in _names(x.get("keywords")))])),
        "published": pick("published"),
        "images": [{k: x[k] for k in ("src", "alt", "caption")} for x in images],
        "videos": list(dict.fromkeys(page.videos)),
        "outlinks": list(dict.fromkeys(outer)),
        "top_image": meta.get("og:image", "") or (large[0] if large else ""),
    }


def extract_pages(pages: DataFrame, own: int = 0) -> DataFrame:
    """Text, media, links and metadata of each page (page_id, url, html), in ``SCHEMA``; an empty page gives empty values.

    ``own``: so many ``own_keywords`` of its text are given too, as of ``keywords``.
    """
    names = ["page_id", "url", "title", "content", "lang", "canonical", "authors", "keywords", "published", "images", "videos", "outlinks", "top_image"]
    none = frozenset(KEYWORD_STOP)

    def parsed(row: tuple) -> dict:
        page = parse_page(*row)
        return page | {"own_keywords": [w for w, _ in top_words(own_words(page["content"]), none, own)]} if own else page

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), PAGES):
                yield pd.DataFrame([parsed(r) for r in rows.iloc[at : at + PAGES].itertuples(index=False)], columns=[*names, "own_keywords"] if own else names)

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA + (", own_keywords array<string>" if own else ""))


#: The last columns of parsed articles, in their order.
COUNTED = ("url_hash", "source", "text_hash", "words", "minutes", "paywalled", "partial", "status", "reason")
#: Words that are no keywords; fixed values.
KEYWORD_STOP = ("with", "that", "this", "from", "have", "been", "were", "they", "their", "will", "would", "which", "there", "about")


def parse_articles(pages: DataFrame, entries: DataFrame, k: int = 10) -> DataFrame:
    """Pages (page_id, url, html) as articles; where a page says nothing, what its feed entry says; keywords, where neither has any, from the text.

    ``entries`` (url, title, published) may have authors, keywords and enclosures, as of ``read_feed_entries``; of entries with one url the
    first title holds. A page without a title is an error, one with less than 200 words partial, as is one behind a paywall, which is then the reason.
    """
    have = set(entries.columns)
    none = lambda kind: F.lit(None).cast(kind)
    image = F.get(F.col("enclosures")["href"], F.lit(0)) if "enclosures" in have else none("string")
    lists = {n: F.col(n) if n in have else none("array<string>") for n in ("authors", "keywords")}
    feed = first_per_key(entries.where(F.col("url").isNotNull()), ["url"], [F.col("title")]).select("url", F.col("title").alias("feed_title"), F.col("published").alias("feed_published"), image.alias("feed_image"), *(c.alias(f"feed_{n}") for n, c in lists.items()))
    # written, as the steps below go over the text several times, and parsing must not be repeated with them
    joined = written(extract_pages(pages, k), "parsed").join(feed, "url", "left")
    told = lambda page, other: F.coalesce(F.nullif(page, F.lit("")), other)
    listed = lambda *names: F.coalesce(*(F.when(F.size(n) > 0, F.col(n)) for n in names), F.array().cast("array<string>"))
    canonical, text, pay = canonicalize_url(told("canonical", F.col("url"))), t.clean_text(F.col("content")), t.paywall_signals(F.col("content"))
    out = joined.select(
        "page_id",
        "url",
        canonical.alias("canonical_url"),
        told("title", F.col("feed_title")).alias("title"),
        told("published", F.col("feed_published")).alias("published"),
        F.col("lang").alias("language"),
        listed("authors", "feed_authors").alias("authors"),
        listed("keywords", "feed_keywords", "own_keywords").alias("keywords"),
        told("top_image", F.col("feed_image")).alias("top_image"),
        "images",
        "videos",
        "outlinks",
        text.alias("text"),
        pay["paywalled"].alias("paywalled"),
        pay["partial"].alias("partial"),
    )
    # a step for each column that others are made of, so that none is worked out twice
    out = out.withColumns({"url_hash": F.sha2("canonical_url", 256), "source": host(F.col("canonical_url")), "text_hash": t.text_hash(F.col("text")), "words": t.word_count(F.col("text")), "status": t.article_status(F.col("title"), F.col("text"))})
    reason = F.when(F.col("status") == "error", "no title").when((F.col("status") == "partial") & F.col("paywalled"), "paywalled").when(F.col("status") == "partial", "short")
    out = out.withColumns({"minutes": t.minutes(F.col("words")), "reason": reason})
    return out.select(*(n for n in out.columns if n not in COUNTED), *COUNTED)


def outlink_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links): how often pages of a domain link to another one."""
    links = extract_pages(pages).select(registered_domain(F.col("url")).alias("source"), F.explode("outlinks").alias("link"))
    return links.groupBy("source", registered_domain(F.col("link")).alias("target")).agg(F.count("*").alias("links"))


def paragraph_chunks(text: str | None, target_words: int, max_chunks: int | None, paragraph: str, max_chars: int | None = None) -> list[tuple[int, str, int]]:
    """(place, text, offset): paragraphs put together while they have at most max(50, target) words; none for fewer than 100 characters.

    Whole texts and all chunks, unless ``max_chars`` or ``max_chunks`` say where a model that reads them ends.
    """
    text = (text or "").strip()
    if len(text) < 100:
        return []
    if max_chars is not None and len(text) > max_chars:
        text = text[:max_chars] + "..."
    most, out, own, n = max(50, target_words), [], [], 0
    for p in [x.strip() for x in re.split(paragraph, text) if x.strip()]:
        words = len(p.split())
        if own and n + words > most:
            out.append("\n".join(own))
            own, n = [], 0
        own.append(p)
        n += words
    if own:
        out.append("\n".join(own))
    at, placed = 0, []
    for i, chunk in enumerate(out[:max_chunks]):
        found = text.find(chunk[:50].split("\n")[0], at)
        at = found if found >= 0 else at
        placed.append((i, chunk, at))
    return placed


def chunk_paragraphs(articles: DataFrame, id_col: str, text_col: str, target_words: int = 400, max_chunks: int | None = None, paragraph: str = r"\n\s*\n", max_chars: int | None = None) -> DataFrame:
    """(id, chunk_index, chunk_text, char_start, words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, k, c, at, len(c.split())) for i, x in rows.itertuples(index=False) for k, c, at in paragraph_chunks(x, target_words, max_chunks, paragraph, max_chars)]
            yield pd.DataFrame(out, columns=["id", "chunk_index", "chunk_text", "char_start", "words"])

    return articles.select(id_col, text_col).mapInPandas(run, "id long, chunk_index int, chunk_text string, char_start int, words int")


def denormalise_chunks(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunks with the columns of their article; category and tags where articles have them."""
    more = [n for n in ("category", "tags") if n in articles.columns]
    meta = articles.select(F.col("article_id").alias("id"), "url", "title_norm", "source_domain", "language", "published_at", *more)
    return chunks.join(meta, "id")


def completion_patches(chunks: DataFrame) -> DataFrame:
    """(article_id, chunking_completed, chunk_count): what the index takes on, by ``apply_patches``, of articles that have chunks."""
    return chunks.groupBy(F.col("id").alias("article_id")).agg(F.lit(True).alias("chunking_completed"), F.count("*").alias("chunk_count"))
