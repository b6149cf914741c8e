"""Name matching across sources.

Names are collapsed to distinct keys first, so a group of copies is matched once.
Nothing here crosses two tables: containment, token rules and edit distances become
equi-joins on fingerprints, words and segments. Their sides are shuffled, by hint: a table of
names that were cut up is many times larger than Spark's estimate, by which it would be sent
through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import bloom
from meadowlark.functions import extract as X
from meadowlark.functions import fingerprints as P
from meadowlark.functions import text as T
from meadowlark.operators.sets import tokens
from meadowlark.scale import keys_of, meet_in_blocks
from meadowlark.session import durable


def _attach(df: DataFrame, found: DataFrame, name: str, cols) -> DataFrame:
    """Found values (by lower-case key ``_name``) given to every row with that name."""
    return df.join(found.select("_name", *cols).hint("merge"), F.lower(F.col(name)) == F.col("_name"), "left").drop("_name")


def match_exact(df: DataFrame, ref: DataFrame, name: str = "name") -> DataFrame:
    """Lower-case equality; the last entry of a reference name wins. Adds ``match_url``."""
    last = ref.groupBy(F.lower("name").alias("_name")).agg(F.max_by("url", "pos").alias("match_url"))
    return _attach(df, last, name, ["match_url"])


# --- containment -------------------------------------------------------------------------

def contained_pairs(short: DataFrame, long: DataFrame, short_text: str, long_id: str, long_text: str) -> DataFrame:
    """(long_id, short_text) for every text of ``short``, blank ones aside, that occurs inside a long one.

    Long texts are read once for their winnowed fingerprints, of which only those that a short
    text has too leave the scan's stage. Of a short text's fingerprints the one that is rarest
    among the long texts is joined; one that no long text has rules the text out. Every
    candidate is compared as text.
    """
    usable = durable(short.select(short_text).distinct().withColumn("_kind", P.text_class(short_text)).where(F.col("_kind").isNotNull()))
    kinds = sorted(r[0] for r in usable.select("_kind").distinct().collect())  # at most P.PIECE + 3 classes
    wanted = usable.select(short_text, F.explode(P.own_fingerprints(short_text, "_kind")).alias("g"))
    wanted = durable(wanted)
    prints = long.select(long_id, F.explode(P.fingerprints(long_text, kinds)).alias("g"))
    met = durable(prints.join(keys_of(wanted, "g", "_g").hint("merge"), F.col("g") == F.col("_g"), "left_semi"))
    counts = met.groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    rare = (
        wanted.join(counts.hint("merge"), F.col("g") == F.col("_g"), "left").groupBy(short_text)
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("p"))
        .where("p.n > 0").select(short_text, F.col("p.g").alias("_g"))
    )
    cands = met.join(rare.hint("merge"), F.col("g") == F.col("_g")).select(F.col(long_id).alias("_id"), short_text)
    return long.select(long_id, long_text).join(cands.hint("merge"), F.col(long_id) == F.col("_id")).where(
        F.col(long_text).contains(F.col(short_text))).select(long_id, short_text)


def match_contains(df: DataFrame, ref: DataFrame, name: str = "name", longer_than: int = 0) -> DataFrame:
    """First reference entry (by ``pos``) whose name contains, or is contained in, the row's name;
    both longer than ``longer_than`` characters. Adds ``match_url``."""
    mine = df.select(F.lower(F.col(name)).alias("_name")).where(F.length("_name") > longer_than).distinct()
    theirs = (
        ref.select(F.lower("name").alias("_ref"), "pos", "url").where(F.length("_ref") > longer_than)
        .groupBy("_ref").agg(F.min_by(F.struct("pos", "url"), "pos").alias("_hit"))
    )
    mine_as_text = mine.withColumn("_text", F.col("_name"))
    refs_as_text = theirs.select("_ref", F.col("_ref").alias("_rtext"))
    inside = contained_pairs(theirs.select("_ref"), mine_as_text, "_ref", "_name", "_text")
    around = contained_pairs(mine.select("_name"), refs_as_text, "_name", "_ref", "_rtext").select("_name", "_ref")
    best = (
        inside.select("_name", "_ref").unionByName(around).join(theirs.hint("merge"), "_ref")
        .groupBy("_name").agg(F.min_by("_hit", "_hit.pos").alias("_hit"))
        .select("_name", F.col("_hit.url").alias("match_url"))
    )
    return _attach(df, best, name, ["match_url"])


def passages_in(docs: DataFrame, passages: DataFrame, doc_id: str, doc_text: str, passage_id: str,
                passage_text: str) -> DataFrame:
    """(doc_id, passage_id) for all passages, blank ones aside, that occur inside documents."""
    pairs = contained_pairs(passages, docs, passage_text, doc_id, doc_text)
    return pairs.join(passages.select(passage_id, passage_text).hint("merge"), passage_text).select(doc_id, passage_id)


# --- tokens --------------------------------------------------------------------------------

def match_tokens(df: DataFrame, ref: DataFrame, name: str = "name", long_word: int = 4) -> DataFrame:
    """First reference entry sharing min(2, n) words with the row's name, or containing one of its
    words of over four letters. Adds ``match_url``.

    Two shared words include one that is not the commonest of the name, so names are joined to
    references by all their words but the commonest; the second word is then looked for in the
    reference's own. A single word and a long word are looked up by themselves, in a reference
    that is reduced to its lowest position per word first.
    """
    refs = durable(ref.select(F.lower("name").alias("_ref"), "pos").where(F.col("_ref").isNotNull())
                   .groupBy("_ref").agg(F.min("pos").alias("pos")).withColumn("_words", tokens("_ref")))
    mine = df.select(F.lower(F.col(name)).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    keyed = durable(mine.withColumn("_words", tokens("_name")))
    words = refs.select(F.explode("_words").alias("_key"), "pos", F.col("_words").alias("_theirs"))

    lowest = words.groupBy("_key").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("_n"))
    single = keyed.where(F.size("_words") == 1).join(lowest.hint("merge"), F.get("_words", F.lit(0)) == F.col("_key")).select("_name", "pos")

    # names of two words and more: the words that references have, the commonest left away
    asked = keyed.where(F.size("_words") > 1).select("_name", "_words", F.explode("_words").alias("_word"))
    known = asked.join(lowest.select("_key", "_n").hint("merge"), F.col("_word") == F.col("_key"))
    common = F.max(F.struct("_n", "_word"))
    least = known.groupBy("_name").agg(common.alias("_most"))
    probes = (known.join(least.withColumnRenamed("_name", "_of").hint("merge"), F.col("_name") == F.col("_of"))
              .where(F.col("_word") != F.col("_most._word")).select("_name", "_words", "_word"))
    double = probes.join(words.hint("merge"), F.col("_word") == F.col("_key")).where(
        F.size(F.array_intersect("_words", "_theirs")) > 1).groupBy("_name").agg(F.min("pos").alias("pos"))

    long_words = F.array_distinct(F.filter(F.split("_name", r"\s+"), lambda w: F.length(w) > long_word))
    third = keyed.where(F.size("_words") > 0).select("_name", F.explode(long_words).alias("_long"))
    titles = refs.select("_ref", F.col("_ref").alias("_title"))
    holding = contained_pairs(third.select("_long").distinct(), titles, "_long", "_ref", "_title")
    held = holding.join(refs.select("_ref", "pos").hint("merge"), "_ref").groupBy(F.col("_long").alias("_key")).agg(F.min("pos").alias("pos"))
    third = third.join(held.hint("merge"), F.col("_long") == F.col("_key")).select("_name", "pos")
    first = single.unionByName(double).unionByName(third).groupBy("_name").agg(F.min("pos").alias("pos"))
    found = first.join(ref.select("pos", F.col("url").alias("match_url")).hint("merge"), "pos").select("_name", "match_url")
    return _attach(df, found, name, ["match_url"])


# --- fuzzy ---------------------------------------------------------------------------------

def _letter_counts(names: list[str]) -> np.ndarray:
    """Counts of characters folded into 64 slots; folding only raises the shared count, so the
    bounds below stay safe."""
    out = np.zeros((len(names), 64), np.int16)
    for i, s in enumerate(names):
        for ch in s:
            out[i, ord(ch) % 64] += 1
    return out


def _best_ratio(a: str, own: np.ndarray, block, threshold: float) -> tuple[float, int]:
    """The best partner above the threshold, or -1. Only references that share enough letters are put in order."""
    names, lengths, letters, pos = block
    total = np.maximum(lengths + len(a), 1)
    some = np.flatnonzero(own)
    bound = 2.0 * np.minimum(letters[some], own[some, None]).sum(axis=0) / total
    if not len(a):
        bound = np.where(lengths == 0, 1.0, bound)
    able = np.flatnonzero(bound > threshold)
    best, at = -1.0, -1
    for i in able[np.lexsort((pos[able], -bound[able]))]:
        if bound[i] < best:
            break
        score = SequenceMatcher(None, a, names[i]).ratio()
        if score > best or (score == best and pos[i] < at):
            best, at = score, int(pos[i])
    return best, at


def most_edits(length: Column, threshold: float) -> Column:
    """The most edits at which names, the longer of ``length``, are still more alike than the threshold."""
    longest = F.greatest(length, F.lit(1))
    guess = F.ceil((1 - threshold) * longest).cast("int")
    return F.coalesce(*[F.when(1.0 - (guess - i) / longest > threshold, guess - i) for i in range(2)], guess - 2)


WIDE = 12  # edits up to which a segment is looked for at its possible places only


def _segments(df: DataFrame, text: str, threshold: float, edits: Callable = most_edits) -> DataFrame:
    """(long, size, edits, nth, slot, place, piece, further columns): each name cut into one segment
    more than its most edits. ``slot`` is the number of the segment, or -1 in names of many edits."""
    size = F.char_length(text)
    further = [F.col(c) for c in df.columns if c != text]
    cut = df.select(F.col(text).alias("long"), size.alias("size"), edits(size, threshold).alias("edits"), *further)
    nth = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("nth"))
    begin, end = _ends()
    slot = F.when(F.col("edits") <= WIDE, F.col("nth")).otherwise(-1)
    return nth.withColumns({"slot": slot, "place": begin, "piece": F.substring(F.col("long"), begin + 1, end - begin)})


def _ends() -> tuple[Column, Column]:
    """Begin and end of the ``nth`` segment of a name of ``size`` characters."""
    return tuple(F.floor((F.col("nth") + i) * F.col("size") / (F.col("edits") + 1)).cast("int") for i in range(2))


def _pieces_for(df: DataFrame, text: str, threshold: float, longer: int, known: DataFrame, edits: Callable = most_edits,
                stretch: Callable = lambda t: 1 / t, others: Callable = lambda rows, text: rows) -> DataFrame:
    """(short, own, size, slot, at, piece, further columns): the pieces of a name that may be a segment of a
    name of ``size`` characters, ``longer`` or more characters longer, for the sizes in ``known``.

    A segment that edits leave whole has as many before it, at least, as segments before it or as it is
    shifted, and as many after it as the rest is. Names of many edits give all pieces of the two lengths
    that segments have. ``others`` leaves the pairs of lengths that are asked for.
    """
    own = F.char_length(text)
    most = F.ceil(own * stretch(threshold)).cast("int")
    further = [F.col(c) for c in df.columns if c != text]
    sizes = df.select(F.col(text).alias("short"), own.alias("own"), *further,
                      F.explode(F.when(most >= own + longer, F.sequence(own + longer, most))).alias("size"))
    # one row for each length of a name, so small by nature
    usable = sizes.join(F.broadcast(known), "size").withColumn("edits", edits(F.col("size"), threshold)).where(F.col("size") - F.col("own") <= F.col("edits"))
    usable = others(usable, text)
    tight = F.col("edits") <= WIDE
    least = F.floor(F.col("size") / (F.col("edits") + 1)).cast("int")
    uneven = F.when(F.col("size") % (F.col("edits") + 1) > 0, 1).otherwise(0)
    nth = usable.select("*", F.explode(F.sequence(F.lit(0), F.when(tight, F.col("edits")).otherwise(uneven))).alias("nth"))
    begin, end = _ends()
    long = F.when(tight, end - begin).otherwise(least + F.col("nth"))
    first = F.when(tight, F.greatest(begin - F.col("edits"), F.lit(0))).otherwise(0)
    last = F.when(tight, F.least(begin + F.col("edits"), F.col("own") - long)).otherwise(F.col("own") - long)
    at = nth.withColumns({"place": begin, "n": long, "first": first, "last": last}).where("first <= last").select(
        "*", F.explode(F.sequence("first", "last")).alias("at"))
    shift = F.col("at") - F.col("place")
    possible = F.greatest(F.abs(shift), F.col("nth")) + F.abs(F.col("own") - F.col("size") - shift) <= F.col("edits")
    slot = F.when(tight, F.col("nth")).otherwise(-1).alias("slot")
    return at.where(~tight | possible).select("short", "own", "size", slot, "at", F.substring(F.col("short"), F.col("at") + 1, F.col("n")).alias("piece"),
                                              *[c for c in df.columns if c != text])


def _meetings(names: DataFrame, refs: DataFrame, threshold: float, name: str, ref: str, **kind) -> DataFrame:
    """(name, ref, further columns) of names that share a segment and are within the edits of the longer one,
    one row or more for each two. Both sides are shuffled: of the rows that names are cut into Spark's
    estimate knows nothing."""
    def met(long_df, long, short_df, short, longer):
        known = long_df.select(F.char_length(long).alias("size")).distinct()
        cut = _segments(long_df, long, threshold, kind.get("edits", most_edits))
        probe = _pieces_for(short_df, short, threshold, longer, known, **kind)
        left, gap = F.col("edits") - F.col("nth"), F.col("own") - F.col("_size")
        near = (F.abs(F.col("at") - F.col("place")) <= F.col("nth")) & (F.abs(F.col("at") - F.col("place") - gap) <= left)
        near = near | (F.col("slot") >= 0)
        # verified where they meet, so that only similar pairs are shuffled again
        alike = F.expr("levenshtein(short, long, edits) >= 0")
        both = probe.join(cut.withColumnsRenamed({"size": "_size", "piece": "_piece", "slot": "_slot"}).hint("merge"),
                          (F.col("size") == F.col("_size")) & (F.col("slot") == F.col("_slot")) & (F.col("piece") == F.col("_piece")) & near & alike)
        out = {"short": short, "long": long}
        return both.withColumnsRenamed(out).select(name, ref, *[c for d, x in ((names, name), (refs, ref)) for c in d.columns if c != x])

    return met(refs, ref, names, name, 0).unionByName(met(names, name, refs, ref, 1))


def similar_pairs(names: DataFrame, refs: DataFrame, threshold: float, name: str = "_name", ref: str = "_ref") -> DataFrame:
    """(name, ref, edits): every two names whose edits are less than ``1 - threshold`` of the longer's length.

    With at most d edits one of d + 1 segments of the longer name stands in the shorter one
    unchanged, shifted by no more than the edits before or after it, so the two meet in a join
    on length, segment and its number. Each of the two tables gives the longer name once. Cost grows
    with the square of a name's length, as names are short.
    """
    pairs = _meetings(names.select(name), refs.select(ref), threshold, name, ref).distinct()
    return pairs.withColumn("edits", F.levenshtein(name, ref))


# names with a partner above one of these are not looked up again below it; a letter more taken out costs most, so in small steps
SURE = (0.9, 0.88, 0.85, 0.82, 0.8, 0.79, 0.78, 0.77, 0.76, 0.75, 0.74, 0.72, 0.7, 0.65)
SURE_RATIO = (0.9, 0.88, 0.85, 0.8)  # the same for matched letters; from LIKELY on only if names meet by what is left of them alone
LIKELY = 0.85
EASY = 1 << 22  # remainders up to which steps are taken together,
STEEP = 2  # or if they are so many times those of the next step alone
WAYS = 512  # remainders of a name, on average, up to which names meet by what is left
MOST_WAYS = 1 << 13  # and of a single one
LONGEST = 256  # letters of names that meet by what is left
CHEAP = 32  # comparisons by a sequence matcher in place of which one remainder is cut,
QUICK = 16  # and so many times more by edits
FILTERED = bloom.MOST_BITS // 16  # remainders of names up to which a filter of them is sent to the references,
LOOSE = 12  # or so many times more of references up to which one is sent to the names,
SPARSE = 8  # if the other side has so many times as many


def match_fuzzy(df: DataFrame, ref: DataFrame, threshold: float = 0.6, metric: str = "levenshtein",
                name: str = "name") -> DataFrame:
    """The most similar reference entry above the threshold, the first one on ties. Adds
    ``match_url`` and ``match_score``.

    Exact. Names meet through segments (``similar_pairs``), by matched letters through what is left of
    them when a few are taken out, first those that are very alike; only names without such a partner go
    on, by edit distance to the threshold itself, by other metrics to a comparison of blocks of names of
    like length.
    """
    mine = durable(df.select(F.lower(F.col(name)).alias("_name")).where(F.col("_name").isNotNull()).distinct())
    refs = durable(
        ref.select(F.lower("name").alias("_ref"), "pos", "url").where(F.col("_ref").isNotNull()).groupBy("_ref")
        .agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"))
    )
    best = (_best_by_edits if metric == "levenshtein" else _best_by_letters)(mine, refs.select("_ref", "pos"), threshold, metric)
    found = best.select("_name", F.col("m.score").alias("match_score"), F.col("m.pos").alias("pos")).join(
        refs.select(F.col("pos"), F.col("url").alias("match_url")).hint("merge"), "pos").drop("pos")
    return _attach(df, found, name, ["match_url", "match_score"])


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("_name").agg(F.max_by(F.struct("score", "pos"), F.struct("score", -F.col("pos"))).alias("m"))


def _letters(df: DataFrame, text: str) -> set[str]:
    """All characters of the texts, found by tasks; of Unicode's, so of bounded number."""
    def own(batches):
        found = np.zeros(0, np.uint32)
        for batch in batches:
            joined = "".join(t for t in batch.column(0).to_pylist() if t)
            found = np.union1d(found, np.frombuffer(joined.encode("utf-32-le"), np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], ["letter"])

    return {chr(r[0]) for r in df.select(text).mapInArrow(own, "letter int").distinct().collect()}


def _most_out(length: np.ndarray, least: float) -> np.ndarray:
    """``most_edits`` of many lengths."""
    longest = np.maximum(length, 1)
    guess = np.ceil((1 - least) * longest).astype(np.int64)
    return np.where(1.0 - guess / longest > least, guess, np.where(1.0 - (guess - 1) / longest > least, guess - 1, guess - 2))


def _kept_by_edits(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The fewest letters, in order, that names of these lengths share if their edits are within the threshold."""
    longest = np.maximum(a, b)
    return longest - _most_out(longest, least)


def _kept_by_letters(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The fewest letters that two names of these lengths must share in order to exceed the ratio."""
    total = np.maximum(a + b, 1)
    guess = np.floor(total * (least / 2)).astype(np.int64)
    return np.where((2.0 * guess / total > least) | (a + b == 0), guess, guess + 1)


_SIZE = np.arange(LONGEST + 1)
_OUT = np.array([[float(math.comb(n, k)) for k in _SIZE] for n in _SIZE])  # ways to keep k of n letters


class _Lengths:
    """Names counted by length, and by the letters that may be kept, those that the other table has too. One row for
    each two lengths is collected, so few by nature; all that is longer than ``LONGEST`` is one length."""

    def __init__(self, df: DataFrame, text: str, kept: str):
        size = [F.least(F.char_length(c), F.lit(LONGEST + 1)) for c in (text, kept)]
        self.n, self.ways, self.most = np.zeros(LONGEST + 2), np.zeros((LONGEST + 1, LONGEST + 1)), np.zeros((LONGEST + 1, LONGEST + 1))
        for a, c, n in df.groupBy(*size).count().collect():
            self.n[a] += n
            if a <= LONGEST:
                self.ways[a] += n * _OUT[c]
                self.most[a] = np.maximum(self.most[a], _OUT[c])


class _Plan:
    """Which lengths of names and references meet by what is left of them at a threshold, and at what cost. Lengths that
    must share no fewer letters than at the step ``before`` have met there."""

    def __init__(self, names: _Lengths, refs: _Lengths, least: float, kept: Callable, cheap: int, before: float | None):
        a, b = np.meshgrid(_SIZE, _SIZE, indexing="ij")
        self.least, self.keep = least, kept(a, b, least)
        n, m = names.n[:-1, None], refs.n[None, :-1]
        possible = (n > 0) & (m > 0) & (self.keep <= np.minimum(a, b))
        self.met_before = np.zeros_like(possible) if before is None else possible & (self.keep >= kept(a, b, before))
        possible &= ~self.met_before
        at = np.clip(self.keep, 0, LONGEST)
        cut_a, cut_b = names.ways[a, at], refs.ways[b, at]
        settled = possible & (self.keep > 0) & (cut_a <= WAYS * n) & (cut_b <= WAYS * m) & (n * m > cheap * (cut_a + cut_b))
        self.settled = settled & (names.most[a, at] <= MOST_WAYS) & (refs.most[b, at] <= MOST_WAYS)
        # lengths that have too many letters which the other table has not are no work at all
        self.settled |= possible & (self.keep > 0) & ((cut_a == 0) | (cut_b == 0))
        self.met = self.settled & (cut_a > 0) & (cut_b > 0)
        self.open = possible & ~self.settled
        self.keys = [self._sum(names, a), self._sum(refs, b)]
        self.cost = sum(self.keys) + (n * m)[self.open].sum() / max(cheap, 1)
        self.long = [bool(x.n[-1]) for x in (names, refs)]

    def _sum(self, side: _Lengths, size: np.ndarray) -> float:
        return sum(side.ways[s, k] for s, k in {*zip(size[self.met].tolist(), self.keep[self.met].tolist())})

    def keeps(self, axis: int) -> list[tuple[int, list[int]]]:
        """For each length of names (0) or references (1) how many letters are kept."""
        met, keep = (self.met, self.keep) if axis == 0 else (self.met.T, self.keep.T)
        return [(int(s), sorted({*keep[s][met[s]].tolist()})) for s in np.flatnonzero(met.any(axis=1))]

    def others(self, axis: int, text: str) -> Column:
        """Names (0) or references (1) that may have partners of a length that is not settled."""
        sizes = {*np.flatnonzero(self.open.any(axis=1 - axis)).tolist()}
        if any(self.long):
            sizes = {*_SIZE.tolist(), LONGEST + 1}
        return F.least(F.char_length(text), F.lit(LONGEST + 1)).isin(sorted(sizes))

    def all_settled(self) -> bool:
        return not self.open.any() and not any(self.long)


def _next_plan(names: _Lengths, refs: _Lengths, steps: list[float], kept: Callable, cheap: int, likely: float, before: float | None) -> _Plan | None:
    """The lowest of the next steps that costs little, by itself or beside the first of them; below ``likely``
    only if it settles all lengths."""
    best = first = None
    for least in steps:
        plan = _Plan(names, refs, least, kept, cheap, before)
        first = first or plan
        if plan.cost > max(EASY, STEEP * first.cost) or (least < likely and not plan.all_settled()):
            break
        best = plan
    return best


def _staged(mine: DataFrame, refs: DataFrame, steps: list[float], kept: Callable, best_at: Callable,
            cheap: int, likely: float = 0.0) -> tuple[DataFrame | None, DataFrame]:
    """The best partners that ``best_at`` finds above the steps, and the names without one."""
    own, theirs = _letters(mine, "_name"), _letters(refs, "_ref")
    refs = refs.withColumn("_rkept", _without("_ref", theirs - own))
    held, found, before = _Lengths(refs, "_ref", "_rkept"), None, None
    while steps:
        asked = mine.withColumn("_nkept", _without("_name", own - theirs))
        plan = _next_plan(_Lengths(asked, "_name", "_nkept"), held, steps, kept, cheap, likely, before)
        if plan is None:
            break
        before = plan.least
        steps = [s for s in steps if s < plan.least]
        if not plan.met.any() and plan.all_settled() and (steps or found is not None):
            continue  # no lengths are near enough
        best = durable(_best(best_at(asked, refs, plan)))
        found = best if found is None else found.unionByName(best)
        mine = durable(mine.join(best.select("_name").hint("merge"), "_name", "left_anti"))
        if mine.isEmpty():
            break
    return found, mine


def _without(text: str, letters: set[str]) -> Column:
    return F.translate(text, "".join(sorted(letters)), "") if letters else F.col(text)


def _same_remainder(names: DataFrame, refs: DataFrame, plan: _Plan) -> DataFrame:
    """(_name, _ref, pos) of names that may exceed the threshold, of the lengths that the plan settles: two that
    share so many letters, in order, are the same when the others are taken out. What is left is nearly
    the whole name, so a word that many names have brings no two of them together. Letters that the other
    table has nowhere are never kept.

    The side that has far fewer remainders sends a filter of them, of bounded size, to the other, which then
    need not shuffle all of its own.
    """
    spark = names.sparkSession

    def cut(df: DataFrame, text: str, kept: str, axis: int, held=None) -> DataFrame:
        keeps = spark.createDataFrame(plan.keeps(axis), "_size int, _keeps array<int>")
        own = df.join(F.broadcast(keeps), F.char_length(text) == F.col("_size"))
        left = own.withColumnsRenamed({text: "_whole", kept: text}).withColumn("_left", F.explode(P.remainders(text, "_keeps", held)))
        return left.select(F.col("_whole").alias(text), *[c for c in df.columns if c not in (text, kept)], F.col("_left").alias(f"_left{axis}"))

    sides = [(names.select("_name", "_nkept"), "_name", "_nkept", 0), (refs, "_ref", "_rkept", 1)]
    held = [None, None]  # the filter that a side asks
    for own, most in ((0, FILTERED), (1, LOOSE * FILTERED)):
        keys, others = plan.keys[own], plan.keys[1 - own]
        if held[own] is None and 0 < keys <= most and SPARSE * keys <= others:
            df, text, kept, axis = sides[own]
            asked = bloom.build(cut(df.select(text, kept), text, kept, axis).select(f"_left{axis}"), int(keys))
            held[1 - own] = spark.sparkContext.broadcast(asked)
    mine, theirs = (cut(*side, held[side[-1]]) for side in sides)
    return mine.join(theirs.hint("merge"), F.col("_left0") == F.col("_left1")).drop("_left0", "_left1")


def _by_segments(names: DataFrame, refs: DataFrame, plan: _Plan, **kind) -> DataFrame:
    """(_name, _ref, pos) of names that share a segment, of the lengths that the plan does not settle."""
    rows = [(int(a), int(b)) for a, b in zip(*np.nonzero(plan.settled | plan.met_before))]
    settled = names.sparkSession.createDataFrame(rows, "_a int, _b int")

    def others(rows, text):
        a, b = ("own", "size") if text == "_name" else ("size", "own")
        return rows.join(F.broadcast(settled.select(F.col("_a").alias(a), F.col("_b").alias(b))), [a, b], "left_anti")

    return _meetings(names.drop("_nkept").where(plan.others(0, "_name")), refs.drop("_rkept").where(plan.others(1, "_ref")), plan.least, "_name", "_ref",
                     others=others, **kind)


def _dealt(names: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names grow to many rows, so each core has some of them."""
    tasks = 4 * names.sparkSession.sparkContext.defaultParallelism
    return names.repartition(tasks, "_name"), durable(refs.repartition(tasks, "_ref"))


def _best_by_edits(mine: DataFrame, refs: DataFrame, threshold: float, metric: str = "levenshtein") -> DataFrame:
    longest = F.greatest(F.char_length("_name"), F.char_length("_ref"), F.lit(1))

    def best_at(names, refs, plan):
        near = names.sparkSession.createDataFrame([], "_name string, _ref string, pos long") if plan.all_settled() else _by_segments(names, refs, plan)
        if plan.met.any():
            # verified where they meet, so that only similar pairs go on
            limit = most_edits(longest, plan.least)
            same = _same_remainder(names, refs, plan).withColumn("_limit", limit)
            near = near.select("_name", "_ref", "pos").unionByName(same.where("levenshtein(_name, _ref, _limit) >= 0").select("_name", "_ref", "pos"))
        return near.withColumn("score", 1.0 - F.levenshtein("_name", "_ref") / longest)

    mine, refs = _dealt(mine, refs)
    return _staged(mine, refs, [*[s for s in SURE if s > threshold], threshold], _kept_by_edits, best_at, QUICK * CHEAP)[0]


def _best_by_letters(mine: DataFrame, refs: DataFrame, threshold: float, metric: str) -> DataFrame:
    """Letters that a sequence matcher leaves unmatched, of both names, are edits, of which two of the same
    length have the most."""
    def unmatched(length, least):
        return most_edits(2 * length, least - 1e-9)

    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    def best_at(names, refs, plan):
        met = _by_segments(names, refs, plan, edits=unmatched, stretch=lambda t: (2 - t) / t).select("_name", "_ref", "pos")
        if plan.met.any():
            met = met.unionByName(_same_remainder(names, refs, plan))
        met = met.distinct()
        return met.withColumn("score", ratio.asNondeterministic()("_name", "_ref")).where(F.col("score") > plan.least)

    mine, refs = _dealt(mine, refs)
    found, left = _staged(mine, refs, [s for s in SURE_RATIO if s > threshold], _kept_by_letters, best_at, CHEAP, LIKELY)
    if found is not None and left.isEmpty():
        return found
    rest = _best_in_blocks(left, refs, threshold, metric)
    return rest if found is None else found.unionByName(rest)


# metric -> best partner in a block, and the least quotient of the lengths of two names that can exceed a threshold
_METRICS: dict[str, tuple[Callable, Callable]] = {"ratio": (_best_ratio, lambda t: t / (2 - t))}


def _best_in_blocks(mine: DataFrame, refs: DataFrame, threshold: float, metric: str) -> DataFrame:
    """Names that can score above the threshold lie in the same or the next class of length, so only
    blocks of such classes meet. Shared letters bound the score; one best partner per name leaves a block."""
    best_of, reach = _METRICS[metric]
    step = math.log(1 / reach(threshold))
    length_class = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / step).cast("int")
    near = F.explode(F.array(*[length_class("_name") + i for i in (-1, 0, 1)])).alias("_class")
    scored = meet_in_blocks(durable(mine.select("_name", near)), refs.select("_ref", "pos", length_class("_ref").alias("_class")),
                            "_name", "_ref", _scorer(best_of, threshold), "_name string, score double, pos long", on=["_class"])
    return _best(scored.where(F.col("score") > threshold))


def _scorer(best_of, threshold: float):
    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        asked, names = mine.column("_name").to_pylist(), theirs.column("_ref").to_pylist()
        hits = []
        if asked and names:
            lengths = np.array([len(s) for s in names], np.int32)
            block = (names, lengths, np.ascontiguousarray(_letter_counts(names).T), theirs.column("pos").to_numpy())
            own = _letter_counts(asked)
            hits = [(a, *best_of(a, own[i], block, threshold)) for i, a in enumerate(asked)]
        name, score, pos = zip(*hits) if hits else ((), (), ())
        return pa.table({"_name": pa.array(name, pa.string()), "score": pa.array(score, pa.float64()), "pos": pa.array(pos, pa.int64())})

    return run


# --- pages by slug ----------------------------------------------------------------------------

def match_slug_page(org: DataFrame, pages: DataFrame, base: str,
                    markers=tuple(K.PROJECT_MARKERS)) -> DataFrame:
    """(id, match_url): the page at base + slug of the name, if it is a real project page."""
    title = X.page_title("html")
    real = (T.any_of([F.col("html").contains(m) for m in markers]) & title.isNotNull()
            & ~title.contains("Page not found") & ~title.contains("404"))
    target = pages.where(real).select(F.col("url").alias("match_url"))
    slug_url = F.concat(F.lit(base), T.slugify("name"), F.lit("/"))
    return org.select("id", slug_url.alias("_slug")).join(target, F.col("_slug") == F.col("match_url")).select("id", "match_url")
