"""Links of crawled pages: what archives and folder listings offer, as full addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .archive import SCAN_NAME

#: Scheme, host and path of an address.
ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
#: The href of an anchor, quoted or not. (The two expressions are the same in Java and in SQL engines with RE2.)
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def hrefs(html: Column) -> Column:
    """Targets of a page's anchors as written, without quotes, fragments and outer blanks."""
    bare = lambda h: F.trim(F.regexp_replace(F.replace(F.regexp_replace(h, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")), "#.*$", ""))
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), bare)


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda got, part: F.when(part == "..", F.when(F.size(got) > 1, F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(1)))).otherwise(got)).when(part == ".", got).otherwise(F.array_append(got, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved(href: Column, base: Column) -> Column:
    """The full address that an href of the page at base means, its scheme and host in lower case, its path at
    least a slash; null for what is no
    web address, or for a relative one on a page without an address of its own."""
    part = lambda of, k: F.regexp_extract(of, ADDRESS, k)
    site = F.when(part(base, 2) != "", F.concat(F.lower(part(base, 1)), F.lit("://"), F.lower(part(base, 2))))
    folder = F.when(part(base, 3) == "", F.lit("/")).otherwise(F.regexp_replace(part(base, 3), "[^/]*$", ""))
    page = F.when(part(base, 3) == "", F.lit("/")).otherwise(part(base, 3))
    whole = (
        F.when(href == "", None)
        .when(href.rlike("^(?i)https?://[^/?#]"), F.concat(F.lower(part(href, 1)), F.lit("://"), F.lower(part(href, 2)), F.regexp_replace(href, "^[^/]*//[^/?#]*", "")))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, page, href))
        .otherwise(F.concat(site, folder, href))
    )
    front, path, rest = F.regexp_extract(whole, "^[^/]*//[^/?#]*", 0), part(whole, 3), F.regexp_replace(whole, "^[^/]*//[^/?#]*[^?#]*", "")
    return F.when(path == "", F.concat(front, F.lit("/"), rest)).when(path.contains("/."), F.concat(front, _without_dots(path), rest)).otherwise(whole)


def described(url: Column, observation_suffixes: list[str]) -> dict[str, Column]:
    """What an address says of itself: host, suffix, kind, and of a scan the observed object and day."""
    name = F.regexp_extract(F.regexp_extract(url, ADDRESS, 3), "[^/]*$", 0)
    suffix = F.lower(F.regexp_extract(name, r"[.]([A-Za-z0-9]+)$", 1))
    scan = name.rlike(SCAN_NAME)
    got = lambda k: F.regexp_extract(name, SCAN_NAME, k)
    return {
        "host": F.regexp_extract(url, ADDRESS, 2),
        "suffix": suffix,
        "kind": F.when(suffix.isin(*observation_suffixes), "observation").otherwise("page"),
        "object": F.when(scan, got(3)),
        "mjd": F.when(scan, got(1).cast("int") + got(2).cast("int") / 86400.0),
    }
