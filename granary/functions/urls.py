"""Addresses: canonical forms, hosts, links of pages, robots rules."""

from __future__ import annotations

import math
import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import arrow_udf, short_hash


def host(url: Column) -> Column:
    """Lower-case host without a leading www., empty where there is none; the scheme may be missing."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    got = F.lower(F.regexp_extract(F.trim(full), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(F.regexp_replace(got, r"^www\.", ""), F.lit(""))


def canonical(url: Column) -> Column:
    """Fragment and tracking parameters dropped, parameters in key order (equal keys keep theirs)."""
    bare = F.regexp_replace(url, "#.*$", "")
    path, query = F.regexp_extract(bare, r"^[^?]*", 0), F.regexp_extract(bare, r"\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit("(?i)^(?:utm_[^=]*|fbclid|gclid)(?:=|$)")))
    keyed = F.transform(parts, lambda p, i: F.struct(F.regexp_extract(p, "^[^=]*", 0).alias("k"), i.alias("i"), p.alias("p")))
    rest = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    return F.when(rest == "", path).otherwise(F.concat(path, F.lit("?"), rest))


def publishable(url: Column) -> Column:
    """http(s) addresses without credentials: lower host without www., no fragment, query as it is; others null."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    rest = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"^[A-Za-z]+://[^/?]*(.*)$", 1)
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    plain = ~F.rlike(url, F.lit(r"^[A-Za-z]+://[^/?#]*@")) & (host(url) != "")
    return F.when(scheme.isin("http", "https") & plain, F.concat(scheme, F.lit("://"), host(url), path))


def archive_id(url: Column) -> Column:
    return F.concat(host(url), F.lit(":"), short_hash(url, 24))


def path_of(url: Column) -> Column:
    got = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(got == "", F.lit("/")).otherwise(got)


def request_of(url: Column) -> Column:
    """Path and query."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(path_of(url), query)


def authority(url: Column) -> Column:
    """Lower-case host with its port, a www. included."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def holds_any(text: Column, parts: Column) -> Column:
    """Whether a text holds any of an array of parts; null counts as none."""
    return F.exists(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.contains(text, p))


def _unnamed(parts: Column) -> Column:
    return F.coalesce(F.size(parts), F.lit(0)) <= 0


def listed(url: Column, base: Column, allow: Column, block: Column) -> Column:
    """On the base's host, no blocked part in the path, and an allowed part in it (any, if none is named)."""
    path = path_of(url)
    return (authority(url) == authority(base)) & ~holds_any(path, block) & (_unnamed(allow) | holds_any(path, allow))


def followable(url: Column, base: Column, follow: Column, block: Column) -> Column:
    """On the base's host, no blocked part in the path, and a part to follow in path or query."""
    return (authority(url) == authority(base)) & ~holds_any(path_of(url), block) & holds_any(request_of(url), follow)


def in_sitemap(url: Column, base: Column, hosts: Column, allow: Column) -> Column:
    """On the base's host or one of some hosts, with an allowed part in the address (any, if none is named)."""
    known = (authority(url) == authority(base)) | F.coalesce(F.array_contains(hosts, authority(url)), F.lit(False))
    return known & (_unnamed(allow) | holds_any(url, allow))


def is_sitemap(url: Column, content_type: Column) -> Column:
    xml = F.rlike(path_of(url), F.lit(r"(?i)\.xml(?:\.gz)?(?:$|\?)"))
    return xml | (F.contains(F.coalesce(content_type, F.lit("")), F.lit("xml")) & F.contains(url, F.lit("sitemap")))


_LOC = re.compile(r"<loc\b[^>]*>(.*?)</loc>", re.I | re.S)
_HREF = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>]+))", re.I)
#: Default ports; characters that stay as they are in a path and in a query. Fixed values.
_PORTS = {"http": 80, "https": 443}
_PATH, _QUERY = "!$%&'()*+,-./:;=@[]^_|~\\", "!$%&()*+,-./:;=?@[\\]^_`{|}~"


def absolute(link: str, base: str) -> str | None:
    """The address of a link on a page; null if there is none."""
    try:
        parts = urlsplit(urljoin(base, link.strip()))
        port = parts.port
    except ValueError:
        return None
    if not parts.scheme or (parts.scheme in _PORTS and not parts.hostname):
        return None
    if parts.scheme not in _PORTS:
        return parts.geturl()
    user = parts.netloc.rpartition("@")[0]
    where = (f"{user}@" if user else "") + parts.hostname + (f":{port}" if port and port != _PORTS[parts.scheme] else "")
    query = f"?{quote(parts.query, safe=_QUERY)}" if parts.query else ""
    return f"{parts.scheme}://{where}{quote(parts.path, safe=_PATH) or '/'}{query}" + (f"#{quote(parts.fragment, safe=_QUERY)}" if parts.fragment else "")


def links_of(text: str | None, base: str | None) -> list[str]:
    """Site map locations as they are, then anchors resolved against the base, distinct in order."""
    found = [m.strip().replace("&amp;", "&") for m in _LOC.findall(text or "")]
    found += [absolute("".join(g), base or "") for g in _HREF.findall(text or "")]
    return list(dict.fromkeys(x for x in found if x))


def _links(texts: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([links_of(t, b) for t, b in zip(texts, bases, strict=True)])


links = arrow_udf(_links, "array<string>")


def rule_pattern(rule: Column) -> Column:
    """A robots rule as a pattern: stars match anything, anchored at the start; a dollar is a dollar."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(rule, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"))


def robots_groups(text: str, agent: str) -> dict:
    """{allow, disallow, delay_ms} of the groups for an agent, or of the star groups if it has none; null without any."""
    groups, names, rules_seen = [], [], False
    for line in text.splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if rules_seen or not names:
                names, rules_seen = [], False
                groups.append((names, {"allow": [], "disallow": [], "delay_ms": 0}))
            names.append(value.lower())
        elif groups:
            rules_seen = True
            rules = groups[-1][1]
            if key in ("allow", "disallow"):
                rules[key].append(value)
            elif key == "crawl-delay":
                rules["delay_ms"] = math.ceil(float(value) * 1000) if re.fullmatch(r"\d+(\.\d+)?", value) else 0
    own = [g for n, g in groups if any(x != "*" and agent.lower().startswith(x) for x in n)] or [g for n, g in groups if "*" in n]
    if not own:
        return {}
    return {"allow": [r for g in own for r in g["allow"]], "disallow": [r for g in own for r in g["disallow"]], "delay_ms": max(g["delay_ms"] for g in own)}
