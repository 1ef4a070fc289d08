"""Canonical form of web addresses and headlines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query parameters that name a campaign or a click, not a page.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid)(=|$)"
_PARTS = r"^[\s]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column, tracking: str = TRACKING) -> Column:
    """Host, path and query of an address, as equal addresses would be written.

    The scheme, user, default port, ``www.``, fragment, tracking parameters, trailing slashes and empty parameters go; the
    host is lower case; parameters are sorted. A text that is no address with a host is trimmed; blank and NULL give NULL.
    """
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)?$", ""), r"^www\.|\.$", "")
    path = F.regexp_replace(F.regexp_replace(part(2), "/{2,}", "/"), r"/+\s*$", "")
    kept = F.filter(F.split(F.trim(part(3)), "&"), lambda p: (p != "") & ~p.rlike(tracking))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    bare = F.trim(url)
    return F.when(bare == "", F.lit(None)).when(host == "", bare).otherwise(whole)


def headline_form(headline: Column) -> Column:
    """Letters and digits of a headline in lower case, one blank between words; NULL if it has none."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(headline), r"[^\p{L}\p{N}]+", " ")), F.lit(""))
