"""URLs: canonical forms, hashes, registered domains. Column functions; null gives null unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_name", "utm_cid", "utm_reader", "utm_viz_id",
    "utm_pubreferrer", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "icid", "ref", "referer", "referrer",
    "campaign_id", "ad_id", "campaign", "source", "medium", "content", "term",
)
DEDUP_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "msclkid", "ref", "source", "campaign", "medium", "_ga", "_gac", "_gl")
TWO_PART_SUFFIXES = ("co.uk", "com.au", "com.br", "co.jp", "co.kr", "co.nz", "co.za", "com.cn", "com.mx", "com.ar")


@F.pandas_udf(T.StringType())
def canonicalize_url(urls: pd.Series) -> pd.Series:
    """Scheme (http if missing) and host in lower case, no default port, no tracking parameters, the rest sorted, no fragment, no slash at the end, at least the path /."""
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    def one(url: str | None) -> str | None:
        if not url or not url.strip():
            return "" if url is not None else None
        url = url.strip()
        try:
            p = urlsplit(url if "://" in url else f"http://{url}")
            host, port = (p.hostname or ""), p.port
        except ValueError:
            return url
        scheme = p.scheme.lower()
        default = {"http": 80, "https": 443}.get(scheme)
        netloc = host if port in (None, default) else f"{host}:{port}"
        query = urlencode(sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in TRACKING))
        return urlunsplit((scheme, netloc, p.path.rstrip("/") or "/", query, ""))

    return urls.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """https, host in lower case, no tracking parameters and no fragment, other parameters in their order; other schemes give ''."""
    from urllib.parse import urlsplit, urlunsplit

    def one(url: str) -> str:
        url = url.strip()
        try:
            p = urlsplit(url if "://" in url else f"https://{url}")
        except ValueError:
            return ""
        if p.scheme.lower() not in ("http", "https") or not p.netloc:
            return ""
        kept = [x for x in p.query.split("&") if x and x.split("=")[0].lower() not in TRACKING]
        return urlunsplit(("https", p.netloc.lower(), p.path, "&".join(kept), ""))

    return urls.map(one, na_action="ignore")


def url_hash(url: Column) -> Column:
    return F.sha2(canonicalize_url(url), 256)


def host(url: Column) -> Column:
    """The host in lower case, without port and a leading www."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r":[0-9]*$", ""), r"^www\.", "")


def registered_domain(url: Column) -> Column:
    """The last two labels of the host, or three after a listed two-part suffix."""
    labels = F.split(host(url), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, host(url)).when(last(2).isin(*TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def dedup_path(url: Column) -> Column:
    """The path in lower case without outer slashes and page suffix, then what parameters are left, sorted."""
    rest = F.when(url.contains("://"), F.regexp_replace(F.regexp_replace(url, r"^.*?://", ""), r"^[^/]*/?", "")).otherwise(url)
    path = F.regexp_replace(F.trim(F.lower(F.split_part(rest, F.lit("?"), F.lit(1))), F.lit("/")), r"\.(html?|php|aspx?)$", "")
    query = F.when(rest.contains("?"), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise("")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: x.contains("=") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*DEDUP_TRACKING)))
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def is_valid_url(url: Column) -> Column:
    """http or https with a host that has a dot; null is not valid."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]*\.[^/?#\s]*"), F.lit(False))


def resolve_relative_url(base: Column, url: Column) -> Column:
    """``url`` as a page at ``base`` means it: dot segments resolved, other schemes and hosts as they are, an empty one the base without its fragment.

    A url that repeats the base's scheme without a host is taken as relative, as browsers do. Null if either is null.
    """
    part = lambda u, pattern, k=1: F.regexp_extract(u, pattern, k)
    scheme, own = F.lower(part(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):")), F.lower(part(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):"))
    plain = lambda u: F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    rest, root = plain(url), plain(base)
    netloc, path = part(root, r"^//([^/?#]*)"), part(F.regexp_replace(root, r"^//[^/?#]*", ""), r"^[^?#]*", 0)
    to, query, fragment = part(rest, r"^[^?#]*", 0), part(rest, r"^[^?#]*\?([^#]*)"), part(rest, r"#(.*)$")
    above = F.split(path, "/", -1)
    above = F.when(F.element_at(above, -1) != "", F.slice(above, 1, F.size(above) - 1)).otherwise(above)
    below = F.concat(above, F.split(to, "/", -1))
    raw = F.when(to.startswith("/"), F.split(to, "/", -1)).otherwise(F.filter(below, lambda s, i: (s != "") | (i == 0) | (i == F.size(below) - 1)))
    taken = F.aggregate(raw, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.array_append(a, s)))
    joined = F.array_join(F.when(F.element_at(raw, -1).isin(".", ".."), F.array_append(taken, F.lit(""))).otherwise(taken), "/")
    with_mark = lambda mark, value: F.when(value != "", F.concat(F.lit(mark), value)).otherwise("")
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), with_mark("//", netloc))
    # what climbs over the top of a host stays at it
    rooted = F.when((netloc != "") & (joined != "") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", "/").otherwise(joined)
    same = F.concat(head, path, with_mark("?", F.when(query != "", query).otherwise(part(root, r"^[^?#]*\?([^#]*)"))), with_mark("#", fragment))
    relative = F.when(to == "", same).otherwise(F.concat(head, rooted, with_mark("?", query), with_mark("#", fragment)))
    return F.when(url == "", base).when((own != "") & (own != scheme), url).when(rest.startswith("//"), F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), rest)).otherwise(relative)
