"""URL columns: splitting, canonical form, resolution and crawl scope.

Everything here maps columns to columns with built-in functions only, so the
work stays inside the JVM and can be pushed through any DataFrame job.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.columns import (
    after,
    form_encode,
    let,
    percent_decode,
    strip,
)

# Schemes that can be crawled.
CRAWLABLE_SCHEMES = ("http", "https")

# Scheme classes of generic URL syntax ("" is "no scheme").
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
)
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
    "svn+ssh", "ws", "wss",
)
AUTHORITY_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
    "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
)

def _one_of(values: tuple[str, ...]) -> str:
    """Pattern that matches exactly the given values."""
    return "^(?:" + "|".join(v.replace("+", r"\+").replace("-", r"\-") for v in values) + r")\z"


URL_PATTERN = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
    r"(?:\?([^#]*))?(?:#.*)?\z"
)


# Shapes that are canonical, or canonical behind the base's root, as they stand
# (a path with "/." in it may still hold dot segments). Visible ASCII without
# "?", "#" and ";", written out one by one: the regex engine then tests a
# character by one table look-up.
_PLAIN = "[" + "".join(rf"\x{c:02x}" for c in range(0x21, 0x7F) if chr(c) not in "?#;") + "]"
PLAIN_URL = rf"^https?://[a-z0-9.\-]+(?::[0-9]+)?/{_PLAIN}*+\z"
PLAIN_PATH = rf"^/(?!/){_PLAIN}*+\z"
# Canonical but for the case of scheme and host.
CASED_URL = rf"^(?i:https?)://[A-Za-z0-9.\-]+(?::[0-9]+)?/{_PLAIN}*+\z"


def _ipv6_pattern() -> str:
    group = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    quad = rf"{octet}(?:\.{octet}){{3}}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{quad}"]
    for left in range(8):
        head = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        right = 7 - left
        tails = [f"(?:{group}(?::{group}){{0,{right - 1}}})?"] if right else [""]
        if right >= 2:
            tails.append(f"(?:{group}:){{0,{right - 2}}}{quad}")
        forms.append(f"{head}::(?:{'|'.join(tails)})")
    return f"(?:{'|'.join(forms)})(?:%[^%\\]]+)?"


def _compatibility_delimiters() -> str:
    """Characters whose compatibility form hides a URL delimiter."""
    return "".join(
        chr(c)
        for c in range(0x80, 0x10000)
        if not 0xD800 <= c <= 0xDFFF
        and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c)))
    )


_BRACKET_HOST = (
    rf"^[^\[]*\[(?:v[0-9A-Fa-f]+\.[^\]]+|{_ipv6_pattern()})\]"
)
_HIDDEN_DELIMITER = f"[{_compatibility_delimiters()}]"


def split_ready(url: Column) -> Column:
    """Drop leading control characters and embedded tab, CR and LF."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_parts(url: Column) -> Column:
    """Split into ``struct<scheme, netloc, path, query>``; the path keeps its
    ``;params``. The fragment is dropped. Input as given by ``split_ready``."""
    return F.struct(
        F.lower(F.regexp_extract(url, URL_PATTERN, 1)).alias("scheme"),
        F.regexp_extract(url, URL_PATTERN, 2).alias("netloc"),
        F.regexp_extract(url, URL_PATTERN, 3).alias("path"),
        F.regexp_extract(url, URL_PATTERN, 4).alias("query"),
    )


def netloc_ok(netloc: Column) -> Column:
    """False where the authority part is malformed (brackets, look-alikes)."""
    bracketed = netloc.contains("[") | netloc.contains("]")
    return F.when(~netloc.rlike(r"[\[\]]|[^\x00-\x7f]"), F.lit(True)).otherwise(
        (~bracketed | netloc.rlike(_BRACKET_HOST)) & ~netloc.rlike(_HIDDEN_DELIMITER)
    )


def bare_path(scheme: Column, path: Column) -> Column:
    """The path without the ``;params`` of its last segment."""
    return F.when(
        path.contains(";") & scheme.rlike(_one_of(PARAM_SCHEMES)),
        F.regexp_replace(path, r";[^/]*\z", ""),
    ).otherwise(path)


def canonical_query(query: Column) -> Column:
    """Decode, drop blank values, sort by (key, value) and encode again."""
    pairs = F.filter(
        F.split(query, "&"),
        lambda p: p.contains("=") & (F.instr(p, "=") < F.length(p)),
    )
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            percent_decode(F.substring_index(p, "=", 1)).alias("k"),
            percent_decode(after(p, "=")).alias("v"),
        ),
    )
    encoded = F.transform(
        F.array_sort(decoded),
        lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"])),
    )
    return F.when(query == "", query).otherwise(F.array_join(encoded, "&"))


def _assemble(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    netloc = F.lower(netloc)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted))
        .when(
            path.startswith("//")
            | (path.startswith("/") & scheme.rlike(_one_of(AUTHORITY_SCHEMES))),
            F.concat(F.lit("//"), path),
        )
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
        body,
        let(
            canonical_query(query),
            lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)),
        ),
    )


def canonical_url(url: Column) -> Column:
    """Canonical form of a URL; null where the authority is malformed."""
    full = let(
        url_parts(split_ready(strip(url))),
        lambda p: F.when(
            netloc_ok(p["netloc"]),
            _assemble(
                p["scheme"],
                p["netloc"],
                bare_path(p["scheme"], p["path"]),
                p["query"],
            ),
        ),
    )
    return F.when(url.rlike(PLAIN_URL), url).otherwise(full)


def url_domain(url: Column) -> Column:
    """Lower-cased authority (host and port) of a URL."""
    return F.lower(F.regexp_extract(split_ready(url), URL_PATTERN, 2))


def has_crawlable_scheme(url: Column) -> Column:
    """http or https, in any case."""
    return let(
        url_parts(split_ready(url)),
        lambda p: p["scheme"].isin(*CRAWLABLE_SCHEMES) & netloc_ok(p["netloc"]),
    )


def is_valid_url(url: Column) -> Column:
    """http or https with a non-empty, well-formed authority."""
    return let(
        url_parts(split_ready(url)),
        lambda p: p["scheme"].isin(*CRAWLABLE_SCHEMES)
        & (p["netloc"] != "")
        & netloc_ok(p["netloc"]),
    )


def is_valid_canonical(url: Column) -> Column:
    """``is_valid_url`` for values that ``canonical_url`` produced."""
    return url.rlike("^https?://[^/?#]")


# -- resolution ---------------------------------------------------------------


def base_parts(base: Column) -> Column:
    """What resolution needs to know about a base URL, computed once per page:
    ``struct<scheme, netloc, path, query, blank, ok, root>``."""

    def known(b: Column, p: Column) -> Column:
        ok = netloc_ok(p["netloc"])
        rooted = ok & p["scheme"].isin(*CRAWLABLE_SCHEMES) & (p["netloc"] != "")
        return F.struct(
            p["scheme"].alias("scheme"),
            p["netloc"].alias("netloc"),
            bare_path(p["scheme"], p["path"]).alias("path"),
            p["query"].alias("query"),
            (b == "").alias("blank"),
            ok.alias("ok"),
            F.when(rooted, F.concat(p["scheme"], F.lit("://"), F.lower(p["netloc"]))).alias("root"),
        )

    def plain(b: Column, root: Column) -> Column:
        scheme = F.substring_index(root, ":", 1)
        return F.struct(
            scheme.alias("scheme"),
            F.substr(root, F.length(scheme) + F.lit(4)).alias("netloc"),
            F.substr(b, F.length(root) + F.lit(1)).alias("path"),
            F.lit("").alias("query"),
            F.lit(False).alias("blank"),
            F.lit(True).alias("ok"),
            root.alias("root"),
        )

    # The base can be a long expression itself: it is evaluated once.
    return let(
        base,
        lambda b: F.when(
            b.rlike(PLAIN_URL), let(F.substring_index(b, "/", 3), lambda root: plain(b, root))
        ).otherwise(let(url_parts(split_ready(b)), lambda p: known(b, p))),
    )


def _remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..``; climbing above the root is ignored."""
    segments = F.split(path, "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(
            s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        )
        .when(s == ".", kept)
        .otherwise(F.array_append(kept, s)),
    )
    slash = F.when(path.rlike(r"(?:^|/)\.\.?\z"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(folded, slash), "/")


def _merge_paths(base_path: Column, path: Column) -> Column:
    directory = F.when(base_path == "", F.lit("/")).otherwise(
        F.regexp_replace(base_path, r"[^/]*\z", "")
    )
    merged = F.when(path.startswith("/"), path).otherwise(
        F.regexp_replace(F.concat(directory, path), "/{2,}", "/")
    )
    return let(
        merged,
        lambda m: F.when(
            m.rlike(r"(?:^|/)\."), F.regexp_replace(_remove_dot_segments(m), "^$", "/")
        ).otherwise(m),
    )


def resolve_href(base: Column, href: Column) -> Column:
    """Resolve a stripped, non-empty ``href`` against a ``base_parts`` column
    and canonicalise the result; null where either side is malformed."""

    usable = base["blank"] | base["ok"]

    def parts(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
        return F.struct(
            scheme.alias("scheme"),
            netloc.alias("netloc"),
            path.alias("path"),
            query.alias("query"),
        )

    def joined(h: Column) -> Column:
        scheme = F.when(h["scheme"] == "", base["scheme"]).otherwise(h["scheme"])
        own = bare_path(scheme, h["path"])
        stands_alone = (
            base["blank"]
            | (scheme != base["scheme"])
            | ~scheme.rlike(_one_of(RELATIVE_SCHEMES))
        )
        query = F.when(h["query"] == "", base["query"]).otherwise(h["query"])
        target = (
            F.when(
                stands_alone,
                parts(h["scheme"], h["netloc"], bare_path(h["scheme"], h["path"]), h["query"]),
            )
            .when(h["netloc"] != "", parts(scheme, h["netloc"], own, h["query"]))
            .when(
                h["path"].isin("", ";"),
                parts(scheme, base["netloc"], base["path"], query),
            )
            .otherwise(
                parts(scheme, base["netloc"], _merge_paths(base["path"], own), h["query"])
            )
        )
        return F.when(
            usable & netloc_ok(h["netloc"]),
            let(
                target,
                lambda t: _assemble(t["scheme"], t["netloc"], t["path"], t["query"]),
            ),
        )

    return (
        F.when(
            base["root"].isNotNull() & href.rlike(PLAIN_PATH) & ~href.contains("/."),
            F.concat(base["root"], href),
        )
        .when(usable & href.rlike(PLAIN_URL), href)
        .when(
            usable & href.rlike(CASED_URL),
            let(
                F.substring_index(href, "/", 3),
                lambda root: F.concat(F.lower(root), F.substr(href, F.length(root) + F.lit(1))),
            ),
        )
        .otherwise(let(url_parts(split_ready(href)), joined))
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against the URL text ``base`` and canonicalise."""
    return let(
        F.struct(base_parts(base).alias("b"), strip(href).alias("h")),
        lambda s: F.when(s["h"] == "", canonical_url(base)).otherwise(
            resolve_href(s["b"], s["h"])
        ),
    )


# -- scope --------------------------------------------------------------------


def scope_path(seed: Column) -> Column:
    """Path of the seed with a trailing slash: the boundary of a crawl."""
    return let(
        url_parts(split_ready(seed)),
        lambda p: let(
            bare_path(p["scheme"], p["path"]),
            lambda b: F.when(b.endswith("/"), b).otherwise(F.concat(b, F.lit("/"))),
        ),
    )


def scope_prefix(seed: Column) -> Column:
    """Domain and scope path in one text, e.g. ``docs.example.org/3/``."""
    return F.concat(url_domain(seed), scope_path(seed))


def in_scope(canonical: Column, prefix: Column) -> Column:
    """Is a canonical http(s) URL inside a ``scope_prefix``?

    The scheme does not count. The scope path itself may lack its slash; behind
    it a query may follow. Works on plain prefixes, without any splitting.
    """
    rest = F.substr(canonical, F.instr(canonical, "//") + F.lit(2))
    closed = F.regexp_replace(prefix, r"/+\z", "")
    return (
        rest.startswith(prefix)
        | (rest == closed)
        | rest.startswith(F.concat(closed, F.lit("?")))
    )


def scope_keys(canonical: Column) -> Column:
    """Every text that the key of a scope holding the URL can have: the path and
    each of its ancestors, with domain. Scopes are then met by equality."""
    rest = F.substr(canonical, F.instr(canonical, "//") + F.lit(2))
    segments = F.split(F.substring_index(rest, "?", 1), "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(segments) - 1),
        lambda i: F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/")),
    )
    return F.array_distinct(F.array_append(above, F.array_join(segments, "/")))


def keys_of_scope(prefix: Column) -> Column:
    """The keys under which ``in_scope`` URLs are found: below the scope path, or
    the path itself without its slash. A URL meets one of them at most."""
    return F.array_distinct(F.array(prefix, F.regexp_replace(prefix, r"/+\z", "")))
