"""Page markup to text where nesting matters.

A text is visible if none of the elements it lies in is hidden. So the reader keeps the
stack of open elements with their state; end tags close what they match, void elements
never open anything, and the next block or list item closes an open paragraph or item.
Only the markup crosses to Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.session import bound_batches

# hidden tags, whether class, id and role hide elements too, separator between text runs
PROFILES = {
    "simple": (frozenset(K.SKIP_TAGS_SIMPLE), False, " "),
    "frame": (frozenset(K.SKIP_TAGS_FRAME), False, " "),
    "full": (frozenset(K.SKIP_TAGS_FULL), True, " "),
    "lines": (frozenset(K.SKIP_TAGS_FRAME), False, "\n"),
}
BATCH_PAGES = 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# open element -> the start tags that end it
ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}


def marked_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether role, class or id mark an element as no content."""
    given = {name: (value or "").lower() for name, value in attrs}
    return (given.get("role") in K.SKIP_ROLES or any(mark in given.get("class", "") for mark in K.SKIP_CLASSES)
            or any(mark in given.get("id", "") for mark in K.SKIP_IDS))


class PageReader(HTMLParser):
    """Calls ``emit`` with every visible text of a page."""

    def __init__(self, hides: Callable[[str, list], bool], emit: Callable[[str], None]):
        super().__init__(convert_charrefs=True)
        self.hides, self.emit = hides, emit
        self.path: list[tuple[str, bool]] = [("", False)]  # open elements and whether their content is hidden

    def handle_starttag(self, tag, attrs):
        if tag in ENDED_BY.get(self.path[-1][0], ()):
            self.path.pop()
        if tag not in VOID:
            self.path.append((tag, self.path[-1][1] or self.hides(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth][0] == tag:
                del self.path[depth:]
                break

    def handle_data(self, data):
        if not self.path[-1][1]:
            self.emit(data)


def visible_text(html: str | None, profile: str) -> str | None:
    if html is None:
        return None
    tags, by_marks, separator = PROFILES[profile]
    runs: list[str] = []
    reader = PageReader(lambda tag, attrs: tag in tags or (by_marks and marked_hidden(attrs)), runs.append)
    reader.feed(html)
    reader.close()
    return separator.join(run for run in (" ".join(text.split()) for text in runs) if run)


def html_text(pages: DataFrame, profile: str = "full", html: str = "html", out: str = "text") -> DataFrame:
    """Pages with their visible text; the other columns stay in the JVM. A Python worker holds the bodies
    of one small batch, and one of them as text."""
    bound_batches(pages.sparkSession, BATCH_PAGES)

    @F.arrow_udf("string")
    def read(bodies: pa.Array) -> pa.Array:
        return pa.array((visible_text(body.as_py(), profile) for body in bodies), pa.string())

    return pages.withColumn(out, read(F.col(html)))
