"""Column expressions for texts, urls, vectors, scores and times; all but unicode composition stay inside Catalyst."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS_PER_TOKEN, WORDS_PER_MINUTE = 4, 238

# Query parameters that never distinguish content, and their prefixes.
TRACKING_PARAMS = (
    "fbclid gclid dclid gbraid wbraid msclkid mc_cid mc_eid igshid mkt_tok yclid _hsenc _hsmi vero_id oly_anon_id oly_enc_id spm scm".split()
)
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_")

# Lower bounds of the importance bands, ascending.
BANDS = {"noise": 0.0, "low": 0.25, "normal": 0.45, "high": 0.7, "critical": 0.9}


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " "))


def without_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, "[​-‍﻿]", "")


def without_control(text: Column) -> Column:
    """Without control characters but line feeds and tabs, lone surrogates and replacement characters."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\uFFFD]", "")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode composition, which has no built-in; texts within ASCII do not reach Python."""
    return F.coalesce(_composed(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def reading_seconds(words: Column) -> Column:
    return F.floor(words / WORDS_PER_MINUTE * 60 + 0.5)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…")))


def slugify(text: Column) -> Column:
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüý", "aaaaaaceeeeiiiinooooouuuuy")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def content_hash(text: Column) -> Column:
    """Identity of a content: SHA-256 of the composed text without zero-width characters, white space squeezed."""
    return F.sha2(squeeze(without_zero_width(nfc(text))).cast("binary"), 256)


def _absolute(url: Column) -> Column:
    url = F.trim(url)
    return F.when(F.length(url) == 0, None).when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def domain_of(url: Column) -> Column:
    """Lower-case host without a leading www.; null for what does not parse."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(_absolute(url), F.lit("HOST"))), "^www\\.", ""), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no www., default port, fragment, tracking parameters or trailing slash; parameters sorted."""
    full = _absolute(url)
    scheme = F.lower(F.regexp_extract(full, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = domain_of(url)
    port = F.regexp_extract(full, "^[^/]*//[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/+$", "")
    query = F.coalesce(F.try_parse_url(full, F.lit("QUERY")), F.lit(""))

    def stays(param: Column) -> Column:
        name = F.lower(F.substring_index(param, "=", 1))
        tracked = name.isin(*TRACKING_PARAMS)
        for prefix in TRACKING_PREFIXES:
            tracked = tracked | name.startswith(prefix)
        return (F.length(param) > 0) & ~tracked

    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), stays)), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when((port != "") & ~usual, F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))
    return F.when(scheme.isin("http", "https") & host.isNotNull(), whole)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a length is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def shorten_vector(a: Column, width: int) -> Column:
    """The first ``width`` components at unit length; null for a shorter or a zero vector."""
    cut = F.slice(a, 1, width)
    size = norm(cut)
    return F.when((F.size(a) >= width) & (size > 0), F.transform(cut, lambda x: x.cast("double") / size))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))))


def band_for(score: Column) -> Column:
    out = F.lit("noise")
    for band, least in BANDS.items():
        out = F.when(score >= least, F.lit(band)).otherwise(out)
    return out


def minute_of(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 60_000_000)


def seconds_of(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def local_day(ts: Column, zone: str) -> Column:
    """The calendar day of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def since_until(ts: Column, low: Column | None = None, high: Column | None = None, closed: bool = False) -> Column:
    """The range convention: aggregates include their start and exclude their end; retrieval (``closed``) includes both."""
    out = F.lit(True) if low is None else ts >= low
    return out if high is None else out & ((ts <= high) if closed else (ts < high))


def working_hours(ts: Column) -> Column:
    """Monday to Friday, from 9 to before 18."""
    return F.weekday(ts).between(0, 4) & F.hour(ts).between(9, 17)
