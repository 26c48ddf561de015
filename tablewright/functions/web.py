"""URL compliance and address functions. Python is used only for IP literals and declared character sets."""

from __future__ import annotations

import ast
import ipaddress
import json
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sites that are login-walled or must not be crawled.
DENY = ("linkedin.com", "www.linkedin.com", "in.linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "glassdoor.com", "glassdoor.co.in", "wellfound.com", "startup.jobs", "remoterocketship.com", "indeed.com", "naukri.com", "internshala.com")

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without credentials, port, brackets and a trailing dot."""
    place = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"^\[|\]$", ""), r"\.$", ""))


def port(url: Column) -> Column:
    given = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    return F.when(given != "", given.try_cast("int")).otherwise(F.when(scheme(url) == "https", 443).otherwise(80))


def url_fault(url: Column) -> Column:
    """Why a URL is no crawl destination, or null."""
    return (
        F.when(~scheme(url).isin("http", "https") | (host(url) == ""), "only absolute HTTP(S) URLs are allowed")
        .when(F.contains(F.regexp_extract(url, _AUTHORITY, 1), F.lit("@")), "URLs containing credentials are not allowed")
        .when(port(url) == 0, "port zero is not a valid crawl destination")
    )


def is_public(address: str) -> bool:
    """Whether an IP literal is globally routable and no tunnel to a private one."""
    try:
        ip = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return False
    return ip.is_global and not (ip.version == 6 and (ip.ipv4_mapped or ip.sixtofour or ip.teredo))


@F.pandas_udf(T.BooleanType())
def public_address(addresses: pd.Series) -> pd.Series:
    return addresses.map(lambda a: a is not None and is_public(a))


def all_public(addresses: Column) -> Column:
    """A host's addresses are accepted only if there is one and none is private. (A list of resolved literals.)"""
    return _all_public(F.array_join(addresses, ","))


@F.pandas_udf(T.BooleanType())
def _all_public(joined: pd.Series) -> pd.Series:
    return joined.map(lambda a: bool(a) and all(map(is_public, a.split(","))))


def compliance_reason(url: Column) -> Column:
    """Empty if a URL may be fetched, else the first reason against it."""
    h = host(url)
    denied = F.exists(F.array(*(F.lit(d) for d in DENY)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))
    fault = url_fault(url)
    return (
        F.when(F.regexp_extract(url, _AUTHORITY, 1) == "", "not a fetchable http(s) URL")
        .when(~scheme(url).isin("http", "https"), "not a fetchable http(s) URL")
        .when(denied, "domain is on the deny list (login-walled / ToS-sensitive)")
        .when(fault.isNotNull(), F.concat(F.lit("unsafe destination: "), fault))
        .otherwise("")
    )


@F.pandas_udf(T.StringType())
def decode_bytes(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Declared character set, else UTF-8, else Windows-1252 with replacement."""

    def one(raw: bytes, declared: str | None) -> str | None:
        if raw is None:
            return None
        for name in (declared, "utf-8"):
            try:
                if name:
                    return bytes(raw).decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
        return bytes(raw).decode("cp1252", errors="replace")

    return pd.Series([one(r, c) for r, c in zip(content, charset)], dtype=object)


@F.pandas_udf(T.BooleanType())
def robots_allow(body: pd.Series, status: pd.Series, url: pd.Series, agent: pd.Series) -> pd.Series:
    """Whether a site's robots file lets an agent fetch a URL. A missing file, or one that was answered with an error, allows all."""
    known: dict[str, RobotFileParser] = {}

    def one(text: str | None, code: float | None, address: str | None, name: str | None) -> bool:
        if address is None:
            return False
        if text is None or (code is not None and code >= 400):
            return True
        if text not in known:
            known[text] = RobotFileParser()
            known[text].parse(text.splitlines())
        return known[text].can_fetch(name or "*", address)

    return pd.Series([one(*row) for row in zip(body, status.astype(object).where(status.notna(), None), url, agent)], dtype=bool)


@F.pandas_udf(T.StringType())
def literal_as_json(raw: pd.Series) -> pd.Series:
    """Error texts that hold a Python dictionary, with that as JSON; others as they are."""

    def one(text: str | None) -> str | None:
        if text is None or "{" not in text or "}" not in text:
            return text
        start, end = text.find("{"), text.rfind("}") + 1
        try:
            json.loads(text[start:end])
        except ValueError:
            try:
                return text[:start] + json.dumps(ast.literal_eval(text[start:end])) + text[end:]
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                pass
        return text

    return raw.map(one)
