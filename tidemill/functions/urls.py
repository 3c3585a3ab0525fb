"""URL keys as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and those that AMP pages and caches add.
TRACKING = (
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "ttclid", "igshid", "igsh", "li_fat_id", "mc_cid",
    "mc_eid", "_ga", "_gl", "_hsenc", "_hsmi", "mkt_tok", "xtor", "ocid", "cmpid", "s_cid", "smid", "smtyp", "ref_src", "ref_url",
)
TRACKING_STARTS = ("utm_", "at_", "ns_")
AMP = ("amp", "_amp", "amp_js_v", "amp_gsa", "amp_r", "amp_tf", "ampshare", "usqp", "aoh", "__amp_source_origin")


def host(url: Column) -> Column:
    """Host in lower case; null where the url cannot be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_noise(name: Column, value: Column) -> Column:
    """Whether a query parameter is left out of a key."""
    key = F.lower(name)
    return key.isin(*TRACKING, *AMP) | key.rlike(f"^({'|'.join(TRACKING_STARTS)})") | ((key == "outputtype") & (F.lower(value) == "amp"))


def _unwrapped(url: Column) -> Column:
    """The page behind an AMP cache url, one level deep."""
    viewer = F.regexp_extract(url, r"^(?i:https?)://(?:www\.)?google\.[a-z]{2,3}(?:\.[a-z]{2})?/amp/(?:s/)?([^/?#]*\..+)$", 1)
    cache = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*\.cdn\.ampproject\.org/(?:c|v|i|r|wp|ii)/(?:s/)?([^/?#]*\..+)$", 1)
    return F.when(viewer != "", F.concat(F.lit("https://"), viewer)).when(cache != "", F.concat(F.lit("https://"), cache)).otherwise(url)


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments (also as %2e) carried out."""
    dots = lambda s: F.regexp_replace(F.lower(s), "%2e", ".")
    parts = F.split(path, "/")
    steps = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(dots(s) == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(dots(s) == ".", kept).otherwise(F.concat(kept, F.array(s))),
    )
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise(path)


def _decoded(c: Column) -> Column:
    """A name or value of a query as it reads, so that ``+`` and ``%20`` are one key; what cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(c), c)


def _one_ascii_host(x: str | None) -> str | None:
    try:
        return x if x is None or x.isascii() else x.encode("idna").decode()
    except UnicodeError:
        return x


def _ascii_host(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_one_ascii_host)

    return run(c)


def normalise(url: Column, idn: bool = False) -> Column:
    """The key by which two links are the same page; a text that is no http(s) url is only trimmed.

    Dot segments are carried out and queries written as forms write them.  With ``idn`` hosts in other scripts get
    their ASCII form (a Python worker reads the hosts); one that has none stays as it is.
    """
    text = F.regexp_replace(url, r"^\s+|\s+$", "")
    full = _unwrapped(text)
    name = F.regexp_replace(F.lower(F.regexp_extract(full, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"\.$", "")
    name = _ascii_host(name) if idn else name
    name = F.regexp_replace(name, r"^(?:(?:www|m|amp)\.)+(?=[^.]+\.[^.])", "")
    port = F.regexp_extract(full, r"^(?i:https?)://(?:[^/?#@]*@)?[^/?#:]+(:[0-9]+)", 1)
    path = F.regexp_extract(full, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(_without_dots(path), "/"), lambda s: F.lower(s) != "amp")
    path = F.regexp_replace(F.array_join(parts, "/"), r"/+$", "")
    path = F.regexp_replace(path, r"(?i)(^|/)articleViewAmp\.html$", "$1articleView.html")
    path = F.regexp_replace(path, r"(?i)\.amp(\.html?)$", "$1")
    path = F.regexp_replace(path, r"(?i)([^/])\.amp$", "$1")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    pieces = F.split(F.regexp_replace(path, r"(?i)(%[0-9a-f]{2})", "\u0001$1\u0001"), "\u0001")
    path = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?i)^%[0-9a-f]{2}$"), F.upper(p)).otherwise(p)), "")
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    raw = F.filter(F.split(query, "&"), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")
    pairs = F.transform(raw, lambda p, i: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), i.alias("at"), _decoded(value(p)).alias("value")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_noise(p["name"], p["value"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    key = F.concat(F.lit("https://"), name, F.when(port.isin(":80", ":443"), "").otherwise(port), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(text.rlike(r"^(?i:https?)://[^/?#\s]"), key).otherwise(text)


def url_hash(url: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a normalised url."""
    return F.substring(F.sha2(normalise(url), 256), 1, length)


def card_id(url: Column) -> Column:
    return F.concat(F.lit("c_"), url_hash(url, 10))


def link_problem(url: Column) -> Column:
    """Why a link cannot be published, or null."""
    bad = F.when(F.trim(url) != url, "blanks around").when(~url.rlike(r"^(?i:https?)://"), "scheme").when(host(url).isNull(), "unreadable")
    return F.when(url.isNull(), "missing").otherwise(bad.when(~F.contains(host(url), F.lit(".")), "host").when(url.rlike(r"[\s<>\"]"), "characters"))


def site_path(ref: Column, page: Column) -> Column:
    """The path in a site that ``ref`` means on ``page`` (a path): without query and fragment, dots carried out; null for other sites, schemes and bare fragments."""
    bare = F.regexp_replace(F.trim(ref), r"[?#].*$", "")
    folder = F.regexp_replace(page, r"[^/]*$", "")
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    return F.when(bare.startswith("//") | bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (bare == ""), F.lit(None)).otherwise(_without_dots(whole))
