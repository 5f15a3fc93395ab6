"""Title, url and post text as Column expressions; all of it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from .times import strip


def map_literal(values: dict) -> Column:
    """A small fixed dictionary as a map column."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(map_literal(values), key), F.lit(default))


def clamp(col: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col))


def fixed(value: Column, digits: int, commas: bool = False) -> Column:
    """Number text with fixed digits, rounded from the exact binary value (ties to even)."""
    text = F.format_number(value, digits)
    return text if commas else F.replace(text, F.lit(","), F.lit(""))


def round_exact(value: Column, digits: int) -> Column:
    """Round by the exact binary value, where the plain ``round`` goes by the shortest decimal text."""
    return fixed(value, digits).cast("double")


def round_settled(value: Column, digits: int) -> Column:
    """Round half up by the first ten decimals: what is a half on paper goes up, in whatever order the sum was added."""
    return F.round(F.round(value, 10), digits)


# --- titles ------------------------------------------------------------------------------

def canonical_numbers(text: Column) -> Column:
    """Rewrite every number with its unit as ``<integer>`` so spellings of one amount agree."""
    part = lambda k: F.regexp_extract_all(text, F.lit(D.NUMBER_PATTERN), F.lit(k))
    between = F.split(text, D.NUMBER_PATTERN, -1)
    found = F.arrays_zip(part(0).alias("raw"), part(1).alias("digits"), part(2).alias("unit"),
                         F.slice(between, F.lit(2), F.size(between)).alias("after"))

    def rewrite(m: Column) -> Column:
        unit = F.coalesce(F.try_element_at(map_literal(D.NUMBER_UNITS), m["unit"]), F.lit(1.0))
        value = F.replace(m["digits"], F.lit(","), F.lit("")).try_cast("double") * unit
        whole = F.when(value < 9e18, value.cast("bigint").cast("string")).otherwise(
            value.try_cast("decimal(38,0)").cast("string"))
        return F.concat(F.coalesce(F.concat(F.lit("<"), whole, F.lit(">")), m["raw"]), F.coalesce(m["after"], F.lit("")))

    return F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(F.filter(
        found, lambda m: m["raw"].isNotNull()), rewrite), ""))


def normalize_title(title: Column) -> Column:
    """Lower case, outlet prefix cut, amounts made equal, punctuation and white space removed."""
    lowered = F.lower(strip(F.coalesce(title, F.lit(""))))
    no_outlet = F.regexp_replace(lowered, D.OUTLET_PREFIX, "")
    return F.regexp_replace(canonical_numbers(no_outlet), "(?U)" + D.TITLE_NOISE, "")


def title_key(title: Column) -> Column:
    """First 100 word characters of the lower-case title."""
    return F.substring(F.regexp_replace(F.lower(title), r"(?U)[^\w一-鿿]+", ""), 1, 100)


def clean_result_title(title: Column, publisher: Column) -> Column:
    """Cut the publisher a search engine appends to the title."""
    t = strip(title)
    bare = F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(publisher)), r"(?U)\s+$", "")
    cut = F.regexp_replace(bare, r"(?U)\s*-$", "")
    ends = (F.coalesce(F.length(publisher), F.lit(0)) > 0) & F.endswith(t, publisher)
    return F.when(ends & (F.length(cut) >= 8), cut).otherwise(
        strip(F.regexp_replace(t, r"\s+-\s+[^-]{2,40}$", "")))


# --- event identity -------------------------------------------------------------------------

def slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def fallback_id(title_en: Column, day: Column) -> Column:
    title = strip(F.lower(F.coalesce(title_en, F.lit(""))))
    return F.substring(F.sha2(F.concat(title, F.lit("_"), day), 256), 1, 16)


def event_fingerprint(subject: Column, action: Column, day: Column) -> Column:
    """Hash of subject, action and day; null when the subject or the action is blank."""
    s, a = slug(subject), slug(action)
    raw = F.concat_ws("|", s, a, F.substring(F.coalesce(day, F.lit("")), 1, 10))
    return F.when((s != "") & (a != ""), F.substring(F.sha2(raw, 256), 1, 16))


# --- urls -----------------------------------------------------------------------------------

def host(url: Column) -> Column:
    """Lower-case host with port and without ``www.``; blank when the url has none."""
    netloc = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(netloc, r"^www\.", "")


def domain(url: Column) -> Column:
    """Lower-case host without port and ``www.``."""
    return F.regexp_replace(host(strip(url)), ":.*$", "")


def url_key(url: Column) -> Column:
    """Host and path; scheme, query, fragment and closing slashes do not count."""
    u = F.coalesce(url, F.lit(""))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    return F.concat(host(u), F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), "/+$", ""))


def bare_url(url: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(url, F.lit(""))), "/+$", "")


def url_hash(url: Column) -> Column:
    return F.sha2(bare_url(url), 256)


# --- bodies and posts -------------------------------------------------------------------------

def strip_tags(html: Column, by: str = "") -> Column:
    return F.regexp_replace(html, "<[^>]+>", by)


def squeeze(text: Column) -> Column:
    """Text without blanks, hard blanks and line breaks, for comparing lengths."""
    t = F.coalesce(text, F.lit(""))
    return strip(F.regexp_replace(t, "&nbsp;|[  \n]", ""))


def has_body(title: Column, summary: Column) -> Column:
    """True when the summary says more than the title repeated."""
    t, s = squeeze(title), squeeze(summary)
    rest = F.when(t == "", s).otherwise(F.replace(s, t, F.lit("")))
    return (s != "") & (F.length(rest) >= D.MIN_BODY_CHARS)


def clean_post(text: Column) -> Column:
    """Post text without urls, mentions and hashtags."""
    t = F.regexp_replace(text, r"(?U)https?://\S+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)@\w+", " "), r"(?U)#\w+", " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def post_key(text: Column) -> Column:
    """Copy-paste key of a post: the first 120 word characters of its cleaned text."""
    return F.substring(F.regexp_replace(F.lower(clean_post(text)), r"(?U)[^\w一-鿿]+", ""), 1, 120)


def post_title(text: Column) -> Column:
    t = strip(F.regexp_replace(strip(text), r"(?U)https?://\S+", ""))
    return F.substring(F.replace(t, F.lit("\n"), F.lit(" ")), 1, 180)


def outlet_key(name: Column) -> Column:
    n = F.lower(strip(F.coalesce(name, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(n, "^x/", ""), r"[^\p{L}\p{N}]", "")
