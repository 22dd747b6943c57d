"""URL resolution, canonical forms and link heuristics as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradecut.functions.keys import county_name

# What stays as it is inside a path or a query.
_KEPT = "!$%&'()*+,;=:@/[]|\\~^"
_DEFAULT_PORTS = (("http", ":80"), ("https", ":443"))
_NAME_LIMIT = 48


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    Keeps long chains linear in size: plain nesting would repeat a step's whole expression
    wherever its result is used, and so would every predicate pushed through it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _percent_encode(text: Column, kept: str = _KEPT) -> Column:
    """UTF-8 percent-encoding of everything but plain URL characters."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for char in kept:
        encoded = F.replace(encoded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return F.when(text.rlike(r"[^\x21-\x7E]|[\"<>`{}]"), encoded).otherwise(text)


def _resolved_segments(segments: Column) -> Column:
    """'.' dropped and '..' taken together with the segment before it."""
    is_dot = lambda s: F.lower(s).isin(".", "%2e")
    is_up = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(is_dot(s), acc)
        .when(is_up(s), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    last = F.element_at(segments, -1)
    ends_open = is_dot(last) | is_up(last)
    return _let(
        kept,
        lambda k: F.concat(
            F.lit("/"),
            F.array_join(k, "/"),
            F.when(ends_open & (F.size(k) > 0), "/").otherwise(""),
        ),
    )


def _remove_dot_segments(path: Column) -> Column:
    """Path without '.' and '..'; it starts with '/'."""
    tidy = _let(F.slice(F.split(path, "/"), 2, 1 << 20), _resolved_segments)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), tidy).otherwise(path)


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _assembled(p: Column, keep_fragment: bool) -> Column:
    """A URL from its parts (scheme, authority, path, query, fragment) in normal form."""
    scheme, authority = p["scheme"], p["authority"]
    host = authority
    for name, port in _DEFAULT_PORTS:
        default = (scheme == name) & authority.endswith(port)
        host = F.when(default, F.regexp_replace(authority, port + "$", "")).otherwise(host)
    path = _let(_percent_encode(F.when(p["path"] == "", "/").otherwise(p["path"])), _remove_dot_segments)
    query = F.when(p["query"] == "?", "").otherwise(_percent_encode(p["query"], _KEPT + "?"))
    pieces = [scheme, F.lit("://"), host, path, query]
    if keep_fragment:
        pieces.append(_percent_encode(p["fragment"], _KEPT + "?#"))
    valid = scheme.isin("http", "https") & (authority != "") & ~authority.rlike(r"[\s<>\\^|%]")
    return F.when(valid, F.concat(*pieces))


def canonical_url(url: Column, keep_fragment: bool = True) -> Column:
    """Normal form of an absolute http(s) URL: lower-case scheme and host, no default port,
    no dot segments, '/' for an empty path, encoded path; null for anything else."""
    pattern = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    names = ("scheme", "authority", "path", "query", "fragment")

    def split(u: Column) -> Column:
        parts = {n: F.regexp_extract(u, pattern, i + 1) for i, n in enumerate(names)}
        parts["scheme"], parts["authority"] = F.lower(parts["scheme"]), F.lower(parts["authority"])
        return F.struct(*[value.alias(n) for n, value in parts.items()])

    return _let(_let(url, split), lambda p: _assembled(p, keep_fragment))


def resolve_url(href: Column, base: Column, keep_fragment: bool = True) -> Column:
    """``href`` as seen from the absolute page address ``base``, in canonical form.

    Handles absolute, scheme-relative, root-relative, query-only and relative references;
    null when the result is not an http(s) address.
    """
    scheme = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
    trimmed = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    slashed = lambda t: F.concat(
        F.translate(F.regexp_extract(t, r"^[^?#]*", 0), "\\", "/"), F.regexp_extract(t, r"[?#].*$", 0)
    )
    cleaned = _let(trimmed, lambda t: F.when(t.contains("\\"), slashed(t)).otherwise(t))
    parts = _let(
        cleaned,
        lambda t: F.struct(
            t.alias("ref"),
            F.lower(F.regexp_extract(t, scheme, 1)).alias("scheme"),
            F.regexp_replace(t, scheme, "").alias("rest"),
            F.lower(F.regexp_extract(base, r"^([A-Za-z]+):", 1)).alias("base_scheme"),
            origin_of(base).alias("origin"),
            F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
        ),
    )

    def absolute(p: Column) -> Column:
        # "http:page" is a relative reference on an http page, an absolute one elsewhere.
        inherits = (p["scheme"] == p["base_scheme"]) & ~p["rest"].startswith("//")
        foreign = F.concat(p["scheme"], F.lit("://"), F.regexp_replace(p["rest"], "^/+", ""))
        directory = F.regexp_extract(p["path"], r"^(.*/)", 1)
        relative = _let(
            F.when(inherits, p["rest"]).otherwise(p["ref"]),
            lambda r: F.when(r.startswith("//"), F.concat(p["base_scheme"], F.lit(":"), r))
            .when(r.startswith("/"), F.concat(p["origin"], r))
            .when(r.startswith("?"), F.concat(p["origin"], p["path"], r))
            .when((r == "") | r.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), r))
            .otherwise(F.concat(p["origin"], F.when(directory == "", "/").otherwise(directory), r)),
        )
        return F.when((p["scheme"] != "") & ~inherits, foreign).otherwise(relative)

    return canonical_url(_let(parts, absolute), keep_fragment)


def directory_of(url: Column) -> Column:
    """Everything up to the last slash of the path, without query and fragment."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    directory = F.regexp_extract(plain, r"^([A-Za-z]+://[^/]*/(?:.*/)?)", 1)
    return F.when(directory != "", directory).otherwise(F.concat(plain, F.lit("/")))


def under_directory(url: Column, parent: Column) -> Column:
    """``url`` lives in the directory of ``parent`` or below it, and is not ``parent``."""
    return F.coalesce((url != parent) & F.startswith(url, directory_of(parent)), F.lit(False))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one is a subdomain of the other; siblings are not the same site."""
    a, b = F.lower(a), F.lower(b)
    return (
        (a == b)
        | F.endswith(a, F.concat(F.lit("."), b))
        | F.endswith(b, F.concat(F.lit("."), a))
    )


def looks_like_year(url: Column, text: Column, year: Column) -> Column:
    haystack = F.concat_ws(" ", url, text)
    return F.rlike(haystack, F.concat(F.lit("\\b"), year.cast("string"), F.lit("\\b")))


def _bare_words(text: Column) -> Column:
    """Lower-case words without Romanian diacritics, each between two spaces."""
    plain = F.translate(F.lower(text), "ăâîșşțţ", "aaisstt")
    return F.concat(F.lit(" "), F.regexp_replace(plain, "[^a-z]+", " "), F.lit(" "))


def looks_like_county(url: Column, text: Column, county: Column, names: bool = True) -> Column:
    """The county code or the county's name as words of their own, in any case and, for the
    name, with or without diacritics."""
    haystack = F.concat_ws(" ", url, text)
    by_code = F.rlike(haystack, F.concat(F.lit("(?i)\\b"), county, F.lit("\\b")))
    if not names:
        return by_code
    name = county_name(F.upper(county))
    known = name != F.upper(county)
    return by_code | (known & F.contains(_bare_words(haystack), _bare_words(name)))


def short_hash(text: Column, length: int = 6) -> Column:
    return F.substring(F.sha1(text), 1, length)


def cache_key(url: Column) -> Column:
    """File stem a stored page is kept under."""
    return short_hash(url, 16)


def page_slug(url: Column) -> Column:
    """Readable name of a page: last path segment without its extension, and the query."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    segment = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    stem = F.regexp_replace(segment, r"(?i)\.[a-z0-9]+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    dashed = F.regexp_replace(F.lower(F.concat_ws(" ", stem, query)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-+|-+$", "")
    short = F.regexp_replace(F.substring(slug, 1, _NAME_LIMIT), "-+$", "")
    return F.when(slug == "", "index").otherwise(short)


def staged_name(county: Column, year: Column, url: Column) -> Column:
    """File stem of a staged page, before collisions are told apart."""
    return F.concat_ws("-", F.lower(county), year.cast("string"), page_slug(url))
