"""URL expressions."""

from __future__ import annotations

from urllib.parse import quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def domain(url: Column) -> Column:
    """Host and port without scheme and leading ``www.``."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^([^/]+|/.*)", 1), r"^www\.", "")


def short_url(url: Column) -> Column:
    """Urls beyond 250 characters as a prefix and 60 digits of their hash."""
    return F.when(F.length(url) > 250, F.concat(F.substring(url, 1, 185), F.lit("___"), F.substring(F.sha2(url, 256), 1, 60))).otherwise(url)


def path_similarity(a: Column, b: Column) -> Column:
    """Share of equal path segments, place by place; 0 if either path is empty."""
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.coalesce(p, F.lit("")), r"/*$", ""), r"\?.*$", "")
    x, y = F.split(clean(a), "/"), F.split(clean(b), "/")
    same = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"] == z["y"]))
    return F.when((clean(a) == "") | (clean(b) == ""), 0.0).otherwise(same / F.greatest(F.size(x), F.size(y)))


def normalize(url: str | None) -> str | None:
    """Host folded, port and fragment dropped, dots resolved, query sorted and encoded, no final slash.

    The path is only edited where it has no capitals; other paths stay as written.
    """
    if url is None:
        return None
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    if not parts.scheme or not host:
        return url
    path = parts.path
    if path == path.lower():
        path = path.replace("%2e", ".").replace("%2f", "/")
        while True:
            kept: list[str] = []
            for seg in path.split("/"):
                if seg == "..":
                    if len(kept) > 1:
                        kept.pop()
                elif seg != ".":
                    kept.append(seg)
            new = "/".join(kept)
            while "//" in new:
                new = new.replace("//", "/")
            if new == path:
                break
            path = new
    query = ""
    if parts.query:
        pairs = sorted(parts.query.split("&"))
        query = "?" + "&".join(k + "=" + quote_plus(v) if eq else k for k, eq, v in (p.partition("=") for p in pairs))
    port = f":{parts.port}" if parts.port and parts.scheme not in ("http", "https") else ""
    out = f"{parts.scheme.lower()}://{host.lower()}{port}{path}{query}"
    return out[:-1] if out.endswith("/") else out


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    return urls.map(normalize)


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if b is None or x is None else urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)
