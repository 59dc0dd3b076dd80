"""URL identity as Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import fixed

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _encoded(c: Column) -> Column:
    """Form encoding that leaves ~ alone and escapes *."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(raw: Column) -> Column:
    """Pairs without tracking keys, sorted by key and value, encoded anew."""
    pairs = F.filter(F.split(raw, "&"), lambda p: F.length(p) > 0)
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(pairs, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.locate("=", p) > 0, decoded(F.substring(p, F.locate("=", p) + 1, F.length(p)))).otherwise("").alias("v")))
    key = lambda p: F.lower(p["k"])
    pairs = F.array_sort(F.filter(pairs, lambda p: ~key(p).startswith("utm_") & ~key(p).isin(fixed.TRACKING)))
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonical_url(c: Column) -> Column:
    """One spelling of an absolute http(s) URL; null for anything else, for user names in it and for bad hosts.

    https; host in lower case without leading www. or amp., trailing dots or a default port; path without trailing
    slashes and /amp; no fragment. Hosts outside ASCII are null: put ascii_host() before where they occur.
    """
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    part = lambda i: F.regexp_extract(bare, _PARTS, i)
    authority = F.lower(part(2))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.+$", ""), r"^((www|amp)\.)+", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(part(3), r"(/amp|/)+$", "")
    query = _query(part(4))
    good = F.lower(part(1)).isin("http", "https") & ~part(2).contains("@") & host.rlike(r"^([a-z0-9.-]{1,253}|\[[0-9a-f:.]+\])$")
    return F.when(
        good,
        F.concat(F.lit("https://"), host, port, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))),
    )


def ascii_host(c: Column) -> Column:
    """The URL with its host in punycode, by an Arrow UDF; left as it is where the host has no such form."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def punycode(s: pd.Series) -> pd.Series:
        def one(url: str | None) -> str | None:
            if url is None or url.isascii():
                return url
            head, mark, rest = url.partition("://")
            host = rest.split("/")[0].split("?")[0].split("#")[0]
            try:
                return head + mark + host.encode("idna").decode("ascii") + rest[len(host) :]
            except UnicodeError:
                return url

        return s.map(one, na_action="ignore")

    return punycode(c)


def url_id(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/:?#]+)", 1)), r"^www\.", "")


#: Suffixes under which names are registered one level lower.
TWO_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "github.io")


def registrable(c: Column) -> Column:
    """The registered domain: the last two labels, three under the suffixes above."""
    d = domain(c)
    two, three = F.substring_index(d, ".", -2), F.substring_index(d, ".", -3)
    return F.when(two.isin(*TWO_LEVEL), three).otherwise(two)


def chosen_canonical(final: Column, declared: Column) -> Column:
    """The declared canonical URL if it lies on the same registered domain, else the final one."""
    a, b = canonical_url(declared), canonical_url(final)
    return F.when(a.isNotNull() & (registrable(a) == registrable(b)), a).otherwise(b)
