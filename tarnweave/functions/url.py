"""URLs in normal form: parsing, normalising and joining, with the standard library only."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_SAFE_PATH, _SAFE_QUERY = "/%:@!$&'()*+,;=-._~|[]\\^", "/%:@!$&()*+,;=-._~?|[]\\^`{}"


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        if low == "..":
            if len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif low == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def normalize(url: str | None) -> str | None:
    """The URL with lower-case scheme and host, no default port, resolved dots and percent-encoding; null if it has none."""
    if url is None:
        return None
    url = re.sub(r"[\t\r\n]", "", url.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0b\x0c\r\x0e\x0f\x10 \x1f"))
    if not _SCHEME.match(url):
        return None
    try:
        parts = urlsplit(url)
        scheme = parts.scheme.lower()
        if scheme not in _PORTS:
            return url[: len(scheme)].lower() + url[len(scheme) :]
        host, port = parts.hostname, parts.port
    except ValueError:
        return None
    if not host:
        return None
    try:
        host = host.encode("idna").decode("ascii") if not host.isascii() else host
    except UnicodeError:
        return None
    if ":" in host:
        host = f"[{host}]"
    user = parts.netloc.rpartition("@")[0]
    place = (f"{user}@" if user else "") + host + (f":{port}" if port is not None and port != _PORTS[scheme] else "")
    path = _dots(quote(parts.path.replace("\\", "/"), safe=_SAFE_PATH) or "/")
    return urlunsplit((scheme, place, path if path.startswith("/") else "/" + path, quote(parts.query, safe=_SAFE_QUERY), quote(parts.fragment, safe=_SAFE_QUERY))) + ("#" if url.endswith("#") and not parts.fragment else "")


def join(base: str | None, href: str | None) -> str | None:
    """A reference resolved against its page; null if either can't be read."""
    if base is None or href is None:
        return None
    try:
        return normalize(href) if _SCHEME.match(href.strip()) else normalize(urljoin(base, href.strip()))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    return pd.Series([normalize(u) for u in urls], dtype="object")


@F.pandas_udf(T.StringType())
def join_urls(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([join(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype="object")


def scheme(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL"))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))
