"""URLs as keys: one spelling for each resource."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ws_trim

# Parameters that name a click, not the resource.
TRACKING_KEYS = ("fbclid", "gclid", "mc_eid", "mc_cid", "igshid", "ref", "ref_src")
TRACKING_PREFIX = "utm_"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host without ``www.``, user or default port; no tracking parameters, closing slash or fragment.

    What isn't http(s) or has no host is only trimmed.
    """
    u = ws_trim(c)
    part = lambda pattern: F.regexp_extract(u, pattern, 1)
    scheme = F.lower(part(r"^([A-Za-z][A-Za-z0-9+.\-]*):"))
    place = F.regexp_replace(part(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"), r"^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^:]*)", 1)), r"^www\.", "")
    port = F.regexp_extract(place, r":([0-9]+)$", 1)
    default = F.when(scheme == "http", DEFAULT_PORTS["http"]).otherwise(DEFAULT_PORTS["https"])
    path = part(r"^[^:]*://[^/?#]*([^?#]*)")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)
    key = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    kept = F.filter(F.split(part(r"^[^?#]*\?([^#]*)"), "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit(TRACKING_PREFIX)) & ~key(p).isin(*TRACKING_KEYS))
    query = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin(*DEFAULT_PORTS) & (host != ""), whole).otherwise(u)


def bare_host(c: Column) -> Column:
    """The host for display: without ``www.``; the text itself where there is none."""
    place = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.when(place != "", place).otherwise(c), r"^www\.", "")
