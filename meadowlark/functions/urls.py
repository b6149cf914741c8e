"""Column functions for URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meadowlark.functions.text import blank_to_null, col, let, words_regex

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def with_scheme(c) -> Column:
    """Trimmed URL with https assumed when no http scheme is given; '' becomes NULL."""
    return blank_to_null(F.regexp_replace(F.trim(col(c)), "^(?!http)(?=.)", "https://"))


def base_url(c) -> Column:
    return F.rtrim(with_scheme(c), F.lit("/"))


def host(c) -> Column:
    return F.lower(F.regexp_extract(col(c), _HOST, 1))


def origin(c) -> Column:
    return F.regexp_extract(col(c), _ORIGIN, 1)


def path(c) -> Column:
    return F.regexp_extract(col(c), _PATH, 1)


def on_host(h: Column, hosts: Sequence[str]) -> Column:
    """The host is one of the hosts or a sub-domain of one."""
    return h.rlike(rf"(?:^|\.)(?:{words_regex(hosts)})$")


def below(p: Column, prefixes: Sequence[str]) -> Column:
    return p.rlike(rf"^(?:{words_regex(prefixes)})")


def resolve(base, rel) -> Column:
    """A link resolved against the page that holds it."""
    b, r = col(base), col(rel)
    folder = F.when(b.endswith("/"), b).otherwise(F.concat(F.regexp_replace(b, r"/[^/]*$", ""), F.lit("/")))
    return (
        F.when(r.startswith("http"), r)
        .when(r.startswith("//"), F.concat(F.lit("https:"), r))
        .when(r.startswith("/"), F.concat(origin(b), r))
        .otherwise(F.concat(folder, r))
    )


def repair_url(c) -> Column:
    """A doubled URL is collapsed; anything that is not http becomes NULL."""
    once = F.regexp_replace(F.trim(col(c)), r"(https?://[^\s]+)\1+", "$1")
    return let(once, lambda u: F.when(u.startswith("http"), u))


def clean_md_url(c, max_len: int | None = None) -> Column:
    """A URL without the rest of a Markdown link; anything else, or longer than ``max_len``, becomes NULL."""
    url = F.rtrim(F.replace(col(c), F.lit("]("), F.lit("")), F.lit(")"))
    return let(url, lambda u: F.when(u.startswith("http") & (F.lit(True) if max_len is None else F.length(u) <= max_len), u))
