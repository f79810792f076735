"""Functions on web addresses and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track visits, besides those that begin with utm_. Fixed values.
TRACKERS = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid")
_WHOLE = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Hosts that name no public machine: one label, local names, digits alone, private and reserved IPv4 ranges.
_LOCAL = r"^[^.]*$|%|(^|\.)localhost$|\.(local|internal)$|^(10|127|0)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^(22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
_NUMERIC = r"^(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+))*$"
_DOTTED = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _WHOLE, k)


def safe_url(url: Column) -> Column:
    """The trimmed address if it is absolute http(s) on a web port of a public
    host, without credentials, control characters or backslashes; else null."""
    own = F.trim(url)
    name = F.lower(F.regexp_replace(F.regexp_replace(_part(own, 2), ":[0-9]*$", ""), r"\.$", ""))
    port = F.regexp_extract(own, r"^[A-Za-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    odd = url.rlike(r"[\x00-\x1f\\]") | ~F.lower(_part(own, 1)).isin("http", "https") | (name == "") | _part(own, 2).contains("@")
    numeric = name.rlike(_NUMERIC) & ~name.rlike(_DOTTED)
    return F.when(~(odd | ~port.isin("", "80", "443") | name.rlike(_LOCAL) | numeric), own)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or trackers, "/" for
    no path; the rest keeps its order and bytes. Keys are decoded and lowered
    before they are compared. Null for what ``safe_url`` refuses."""
    own = safe_url(url)
    scheme, query = F.lower(_part(own, 1)), F.substring(_part(own, 4), 2, 2**31 - 1)
    name = F.regexp_replace(F.lower(_part(own, 2)), F.when(scheme == "https", F.lit(":443$")).otherwise(F.lit(":80$")), F.lit(""))
    path = F.when(_part(own, 3) == "", "/").otherwise(_part(own, 3))

    def tracks(part: Column) -> Column:
        key = F.regexp_extract(part, "^([^=]*)", 1)
        key = F.lower(F.coalesce(F.try_url_decode(key), key))
        return key.startswith("utm_") | key.isin(*TRACKERS)

    kept = F.array_join(F.filter(F.split(query, "&"), lambda part: ~tracks(part)), "&")
    return F.concat(scheme, F.lit("://"), name, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def host(url: Column) -> Column:
    """Bare host in lower case, without credentials, www., port and a last dot."""
    own = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, "^[^@]*@", ""), ":[0-9]+$", ""), r"\.$", "")
    return F.regexp_replace(own, r"^www\.", "")


def stable_id(url: Column, source: Column, title: Column, guid: Column | None = None) -> Column:
    """24 hex digits of SHA-256 over the canonical address, else source and guid or title."""
    given = F.coalesce(*([F.nullif(guid, F.lit(""))] if guid is not None else []), title, F.lit(""))
    return F.substring(F.sha2(F.coalesce(canonical_url(url), F.concat(source, F.lit("|"), given)), 256), 1, 24)


def event_id(anchor: Column) -> Column:
    return F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat(F.lit("event-v1|"), anchor), 256), 1, 16))
