"""Column functions for text: normalizing, matching, escaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from meadowlark import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_regex(words: Sequence[str]) -> str:
    """One alternation for a word list, so a text is scanned once."""
    return "|".join(re.escape(w) for w in words)


# --- cleaning ---------------------------------------------------------------------

def strip(c) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def squeeze(c) -> Column:
    """Runs of whitespace become one space; ends are stripped."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def blank_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def norm_key(c) -> Column:
    return F.lower(F.trim(col(c)))


def norm_url_key(c) -> Column:
    return F.rtrim(norm_key(c), F.lit("/"))


def strip_punctuation(c) -> Column:
    return F.rtrim(col(c), F.lit(",.!?;"))


def prefix(c, n: int | None) -> Column:
    """The first n characters; all of them if n is None."""
    return col(c) if n is None else F.substring(col(c), 1, n)


def is_blank(c) -> Column:
    return col(c).isNull() | (col(c) == "")


def first_nonempty(*cs) -> Column:
    """The first value that is neither NULL nor '', else ''."""
    return F.coalesce(*[blank_to_null(c) for c in cs], F.lit(""))


def join_nonempty(sep: str, *cs) -> Column:
    return F.concat_ws(sep, *[blank_to_null(c) for c in cs])


# --- matching ---------------------------------------------------------------------

def contains_ci(c, q: str) -> Column:
    """SQL LIKE with the user's own wildcards, case-insensitive."""
    return col(c).ilike(f"%{q}%")


def mentions(c, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the lower-cased text."""
    return F.lower(col(c)).rlike(words_regex(words))


def keyword_hits(c, words: Sequence[str]) -> Column:
    """The words of the list that occur in the text, in list order."""
    listed = F.array(*[F.lit(w) for w in words])
    return let(F.lower(col(c)), lambda low: F.filter(listed, lambda w: low.contains(w)))


def score_terms(c, terms: Sequence[str]) -> Column:
    """How many distinct terms occur in the text."""
    return F.size(keyword_hits(c, terms))


def extract(c, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, NULL if there is none."""
    return blank_to_null(F.regexp_extract(col(c), pattern, group))


def first_match(c, patterns: Sequence[str], group: int = 0) -> Column:
    return F.coalesce(*[extract(c, p, group) for p in patterns])


def first_fitting(c, patterns: Sequence[str], group: int, ok, clean=None) -> Column:
    """The first pattern's match that fits after cleaning; every pattern is searched once."""
    found = F.array(*[F.regexp_extract(col(c), p, group) for p in patterns])
    cleaned = found if clean is None else F.transform(found, clean)
    return F.get(F.filter(cleaned, lambda x: (x != "") & ok(x)), F.lit(0))


def extract_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), group)


def query_words(c) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: F.length(w) > 2)


# --- shaping ----------------------------------------------------------------------

def slugify(c) -> Column:
    kept = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s-]", "")
    dashed = F.regexp_replace(strip(kept), r"\s+", "-")
    return F.regexp_replace(dashed, "-+", "-")


def html_escape(c) -> Column:
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _character(ref: Column) -> Column:
    """The character of a numeric reference such as #233 or #xE9."""
    hexadecimal = F.substring(ref, 2, 1).isin("x", "X")
    code = F.when(hexadecimal, F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7)).cast("int")
    fine = ref.startswith("#") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def html_unescape(c) -> Column:
    """Named and numeric character references, each decoded once; anything else stays as it is."""
    named = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code) if name != "nbsp" else " ")],
                         F.lit("apos"), F.lit("'"))

    def decoded(part: Column) -> Column:
        def char(ref: Column) -> Column:
            known = F.when(ref.startswith("#"), _character(ref)).when(ref != "", F.try_element_at(named, ref))
            return F.coalesce(F.concat(known, F.substr(part, F.length(ref) + 2)), F.concat(F.lit("&"), part))

        return let(F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1), char)

    parts = F.split(col(c), "&")
    whole = F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded))
    return F.when(col(c).contains("&"), F.array_join(whole, "")).otherwise(col(c))


def sql_quote(c) -> Column:
    """A text value as an SQL literal."""
    return F.coalesce(
        F.concat(F.lit("'"), F.replace(col(c), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")
    )


def ics_escape(c) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for char, escaped in [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n"), ("\r", "")]:
        out = F.replace(out, F.lit(char), F.lit(escaped))
    return out


def label(c, mapping: Mapping[str, str], default) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), default)


def source_label(c) -> Column:
    shown = label(F.lower(col(c)), K.SOURCE_LABELS, F.concat(F.lit("Source: "), html_escape(c)))
    return F.when(is_blank(c), F.lit("")).otherwise(shown)


def truthy(c) -> Column:
    return F.coalesce(col(c).cast("boolean"), F.lit(False))


def json_field(c, path: str) -> Column:
    return F.get_json_object(col(c), path)


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def pct(part, whole, digits: int = 1) -> Column:
    return F.round(100.0 * col(part) / F.nullif(col(whole), F.lit(0)), digits)
