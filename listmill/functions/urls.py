"""URL parts, keys and reference resolution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.text import contains_any, let, unicode_regex

_ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def url_key(c: Column) -> Column:
    """Key under which two URLs count as one: no trailing slashes, lower case; null is ""."""
    return F.lower(F.coalesce(F.rtrim(c, F.lit("/")), F.lit("")))


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)


def origin(u: Column) -> Column:
    return F.regexp_extract(u, r"^([^:/?#]+://[^/?#]*)", 1)


def path(u: Column) -> Column:
    """The path without query, fragment and parameters."""
    return F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")


def board_seed(c: Column) -> Column:
    """A board URL as typed, with https:// added where the scheme is missing."""
    return F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def _fold_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def step(done: Column, seg: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(seg == ".", done).when(seg == "..", up).otherwise(F.concat(done, F.array(seg)))

    def fold(parts: Column) -> Column:
        slash = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        done = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
        return F.concat(F.array_join(done, "/"), slash)

    return let(p, lambda x: F.when(x.contains("/."), let(F.split(x, "/"), fold)).otherwise(x))


def urljoin(base: Column, href: Column) -> Column:
    """Resolve a reference against an absolute base URL."""
    root = origin(base)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(F.substring(bare, F.length(root) + 1, F.length(bare)), r"^(.*/)", 1)
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    rel = F.regexp_extract(href, r"^([^?#]*)", 1)
    return (
        F.when(href == "", base)
        .when(href.rlike(_ABSOLUTE), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("/"), F.concat(root, _fold_dots(rel), tail))
        .otherwise(F.concat(root, _fold_dots(F.concat(F.when(folder == "", "/").otherwise(folder), rel)), tail))
    )


def resolve_href(base: Column, href: Column) -> Column:
    """The absolute http(s) URL of a trimmed href, or null where it is not a link to a page."""
    skip = (href == "") | href.startswith("#") | href.startswith("mailto:") | href.startswith("javascript:")
    return let(urljoin(base, href), lambda u: F.when(~skip & scheme(u).isin("http", "https"), u))


def job_link_rule(host: Column, p: Column) -> Column:
    """Number of the rule by which host and path look like a job page, or null.

    ``host`` is lower case and ``p`` has no trailing slash.  Hosts of the
    second rule are decided there; all others fall through to the generic paths.
    """
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    parts = F.size(F.array_remove(F.split(p, "/"), ""))
    jobs = p.contains("/jobs/")
    return (
        F.when(host.contains("greenhouse.io") & jobs, 1)
        .when(host.contains("lever.co"), F.when(parts >= 2, 2))
        .when(host.contains("ashbyhq.com") & jobs, 3)
        .when(host.contains("workable.com") & (p.contains("/j/") | jobs), 4)
        .when(host.contains("mercor.com") & jobs & (slashes >= 2), 5)
        .when(p.rlike("(?i)" + unicode_regex(V.GENERIC_JOB_PATHS[0])), 6)
        .when(p.rlike("(?i)" + unicode_regex(V.GENERIC_JOB_PATHS[1])), 7)
    )


def same_site(board_host: Column, link_host: Column) -> Column:
    """True where one host contains the other, or the link goes to a known board."""
    return F.contains(link_host, board_host) | F.contains(board_host, link_host) | contains_any(
        link_host, V.KNOWN_BOARDS)
