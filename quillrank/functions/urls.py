"""URL expressions. Parts are cut by pattern, so odd characters never fail a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.config import Site
from quillrank.functions.text import bind, text_or_null

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def full_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(full_path(url), r";[^/]*$", "")


def no_slash(url: Column) -> Column:
    """URL without any trailing slash: the key under which slash variants meet."""
    return F.rtrim(url, F.lit("/"))


def last_segment(p: Column) -> Column:
    return F.element_at(F.split(no_slash(p), "/"), -1)


def squeeze_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(
            F.concat(done, F.array(part))
        )

    def resolve(text: Column) -> Column:
        walked = F.array_join(F.aggregate(F.split(text, "/"), F.array().cast("array<string>"), step), "/")
        return F.when(text.rlike(r"/\.\.?$"), F.concat(walked, F.lit("/"))).otherwise(walked)

    # Most paths have no dot segment and skip the walk.
    return bind(p, lambda q: F.when(F.contains(q, F.lit("/.")) & q.rlike(r"/\.\.?(/|$)"), resolve(q)).otherwise(q))


def absolute(base: Column, href: Column) -> Column:
    """Resolve ``href`` against the page it was found on."""
    def site() -> Column:
        return F.concat(scheme(base), F.lit("://"), netloc(base))

    def beside(h: Column) -> Column:
        folder = F.coalesce(text_or_null(F.regexp_extract(full_path(base), r"^(.*/)", 1)), F.lit("/"))
        return F.regexp_replace(F.concat(folder, full_path(h)), "/+", "/")

    def resolve(h: Column) -> Column:
        tail = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
        relative = F.when(h.startswith("/"), full_path(h)).otherwise(beside(h))
        return (
            F.when(h == "", base)
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.rlike(_SCHEME), h)
            .when(h.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), h))
            .when(h.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), h))
            .otherwise(F.concat(site(), squeeze_dots(relative), tail))
        )

    return bind(href, resolve)


def canonical(url: Column, site: Site) -> Column:
    """One form per item: no query, no fragment, exactly one trailing slash."""
    def form(u: Column) -> Column:
        ours = netloc(u).endswith(site.host) & path(u).startswith(site.item_path)
        return F.when(
            ours, F.concat(scheme(u), F.lit("://"), netloc(u), no_slash(path(u)), F.lit("/"))
        ).otherwise(u)

    return bind(url, form)


def is_item_link(href: Column, site: Site) -> Column:
    """Item pages only: not the feed, not a numbered or bare listing page."""
    def real(slug: Column) -> Column:
        return (slug != "") & (slug != site.listing_slug) & ~slug.rlike(r"^\p{Nd}+$")

    return (
        F.contains(href, F.lit(site.item_path))
        & F.contains(path(href), F.lit(site.item_path))
        & ~F.contains(netloc(href), F.lit(site.feed_host))
        & bind(last_segment(path(href)), real)
    )


def is_next_page(text: Column, href: Column, site: Site) -> Column:
    """Pagination: a known link word, or a numbered listing page."""
    numbered = F.contains(href, F.lit(site.item_path)) & last_segment(href).rlike(r"^\p{Nd}+$")
    return text.isin(*site.next_words) | numbered


def cache_key(url: Column) -> Column:
    return F.sha2(url.cast("binary"), 256)


def display_url(presentation_url: Column, url: Column) -> Column:
    return F.coalesce(text_or_null(presentation_url), url)


def item_key(presentation_url: Column, url: Column) -> Column:
    """Slash-insensitive key of an item; an empty presentation link stays empty."""
    return no_slash(F.coalesce(presentation_url, url))
