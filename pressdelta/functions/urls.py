"""URL functions as column expressions over the generic URL pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def part(url: Column, name: str) -> Column:
    return F.regexp_extract(url, _URL, ("scheme", "netloc", "path", "query", "fragment").index(name) + 1)


def host(url: Column) -> Column:
    """Lower-case host without port and user; the empty string if there is none."""
    bare = F.regexp_replace(part(url, "netloc"), "^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, "^([^:]*)", 1)))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def _clean(url: Column) -> Column:
    """http(s), a host, and no user or password."""
    return F.lower(part(url, "scheme")).isin("http", "https") & (host(url) != "") & ~part(url, "netloc").rlike(r"^(?:[^@:]|:[^@]).*@")


def _base(url: Column) -> Column:
    return F.concat(F.lower(part(url, "scheme")), F.lit("://"), F.lower(part(url, "netloc")), part(url, "path"))


def safe(url: Column) -> Column:
    """Without query and fragment, at most 200 characters; empty if not acceptable."""
    return F.when(_clean(url), F.substring(_base(url), 1, V.MAX_URL)).otherwise("")


def canonical(url: Column) -> Column:
    """With the query, without the fragment; null if not acceptable."""
    query = part(url, "query")
    return F.when(_clean(url), F.concat(_base(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def strict(url: Column) -> Column:
    """A source address: no white space, a valid port and no user, not even an empty one."""
    netloc = part(url, "netloc")
    port = F.regexp_extract(netloc, r":([^\]:]*)$", 1)
    good_port = (port == "") | (port.rlike("^[0-9]{1,5}$") & F.coalesce(port.try_cast("int") <= 65535, F.lit(False)))
    return F.coalesce(is_http(url) & (host(url) != "") & ~url.rlike(r"(?U)\s") & ~netloc.contains("@") & good_port, F.lit(False))


def redact_url(url: Column) -> Column:
    """Drops the user; values of sensitive query keys and fragment parameters become ``***``."""
    sensitive = f"(?i){V.SENSITIVE}"
    plain = lambda v: F.coalesce(F.try_url_decode(v), v)
    quoted = lambda v: F.replace(F.replace(F.url_encode(plain(v)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def pair(p):
        key, value = F.regexp_extract(p, "(?s)^([^=]*)", 1), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)
        return F.concat(quoted(key), F.lit("="), F.when(plain(key).rlike(sensitive), "%2A%2A%2A").otherwise(quoted(value)))

    pairs = F.filter(F.split(part(url, "query"), "&"), lambda p: p != "")
    query = F.array_join(F.transform(pairs, pair), "&")
    fragment = F.regexp_replace(part(url, "fragment"), rf"(?i)(^|[?&])([^=&#\s]*{V.SENSITIVE}[^=&#\s]*=)[^&#\s]*", "$1$2***")
    netloc = F.regexp_replace(part(url, "netloc"), "^.*@", "")
    scheme = F.lower(part(url, "scheme"))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        part(url, "path"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
