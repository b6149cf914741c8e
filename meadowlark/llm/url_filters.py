"""URL filters: host and path rules, then a ratio of character language models.

URLs that a rule allows or blocks train one variable-order Markov model each: counts of
every byte after its last 0 to ORDER bytes, each order smoothed with the one below. Counts are
exact. They live in a Spark table with one row per distinct run of ORDER + 1 bytes, which grows
with the URLs and never comes to the driver; the lower orders are sums of it, and each order is
joined to the one below, where a key has at most as many rows as there are bytes.

A URL's score is the mean per byte of ``log p_allowed - log p_blocked``. Every run has one such
number, so a URL looks up its runs: those that hold a ``HOT``-th of all bytes or more, hence at
most ``HOT`` runs, in a small table that each task has, and the others in a join, where no run
is frequent. The numbers are added as integers, so reruns agree to the last bit. The threshold
is the one that separates the rules' own URLs best when each half of them is scored by the model
of the other half. A URL without a rule is allowed if its score reaches the threshold.

Defined results: null, empty and malformed URLs have empty host and path, so no rule fits;
the models judge what text there is. If rules allow nothing or block nothing there is no
second model: scores are 0 and all other URLs are allowed. Repeated rows get equal verdicts,
and count in training as often as they occur; extra columns pass through, one named as a result
is replaced; an empty table stays empty. URLs may be of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.llm import words as W
from meadowlark.llm.batches import bound_batches, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
PRIOR = 2.0  # bytes that the next lower order counts for
HOT = 50_000
HELD = 400_000  # runs that a task counts before it sends them
UNIT = 1 << 32  # log ratios are whole numbers of this fraction
START, END, BITS = 256, 257, 9  # marks around a URL, and the bits of a symbol in a run
BINS, REACH = 4096, 8.0  # of the scores from which the threshold is chosen
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def runs(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends in each byte or end mark, ORDER + 1 symbols as one number (the last
    symbol in the lowest bits), and its row. A URL is preceded by start marks."""
    data, at = W.utf8(urls)
    n, size = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(n), size + 1)
    place = np.arange(len(row)) - np.repeat(at[:-1] + np.arange(n), size + 1)
    symbol = np.full(len(row), END, np.int64)
    symbol[place < size[row]] = data
    out = symbol.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(row), START, np.int64)
        some = np.flatnonzero(place >= k)
        before[some] = symbol[some - k]
        out |= before << (BITS * k)
    return out, row


def run_counts(urls: DataFrame) -> DataFrame:
    """(run, total, c0, c1, c2, c3) from (url, n, blocked, half): how often a run occurs in all
    URLs, and in those of each half (0, 1) that rules allow (c0, c2) or block (c1, c3)."""
    names = ["run", "total", "c0", "c1", "c2", "c3"]

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            n, blocked, half = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for a, b in W.slices(batch.column(0), W.SEGMENT):
                run, row = runs(batch.column(0)[a:b])
                key, where = np.unique(run, return_inverse=True)
                weight, kind = n[a:b][row], (2 * half + blocked)[a:b][row]
                part = np.zeros((5, len(key)), np.int64)
                np.add.at(part[0], where, weight)
                for k in range(4):
                    of = (kind == k) & (blocked[a:b][row] >= 0)
                    np.add.at(part[k + 1], where[of], weight[of])
                held.append((key, part))
                rows += len(key)
            if rows > HELD:
                held = [_added(held)]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield from sent(*held[0])
                    held, rows = [], 0
        if held:
            yield from sent(*_added(held))

    def sent(key, part):
        for a in range(0, len(key), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(key[a: a + 8192]), *[pa.array(x[a: a + 8192]) for x in part]], names)

    counted = urls.select("url", "n", F.coalesce("blocked", F.lit(-1)).cast("long"), F.col("half").cast("long"))
    counted = counted.mapInArrow(count, ", ".join(f"{c} long" for c in names))
    return counted.groupBy("run").agg(*[F.sum(c).alias(c) for c in names[1:]])


def _added(held):
    key, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    out = np.zeros((5, len(key)), np.int64)
    parts = np.concatenate([p for _, p in held], axis=1)
    for x, p in zip(out, parts):
        np.add.at(x, where, p)
    return key, out


MODELS = (("all", ("c0", "c2"), ("c1", "c3")), ("first", ("c0",), ("c1",)), ("second", ("c2",), ("c3",)))


def ratios(counts: DataFrame) -> DataFrame:
    """(run, total, all, first, second): log p_allowed - log p_blocked of each run's last symbol,
    in units, by the models of all ruled URLs and of either half of them."""
    lower = None
    for k in range(ORDER + 1):
        mask = (1 << (BITS * (k + 1))) - 1
        here = counts.groupBy(F.col("run").bitwiseAND(F.lit(mask)).alias("run")).agg(
            *[F.sum(c).alias(c) for c in ("total", "c0", "c1", "c2", "c3")])
        context = Window.partitionBy(F.shiftright("run", BITS))  # at most as many rows as symbols
        held = {}
        for name, *both in MODELS:
            for verdict, of in zip("ab", both):
                n = sum((F.col(c) for c in of[1:]), F.col(of[0]))
                held[f"{name}_{verdict}"] = n, F.sum(n).over(context)
        here = here.select("run", "total", *[n.alias(f"n_{x}") for x, (n, _) in held.items()],
                           *[t.alias(f"t_{x}") for x, (_, t) in held.items()])
        if lower is None:
            below = {x: F.lit(1 / 256) for x in held}
        else:
            here = here.join(lower, F.col("run").bitwiseAND(F.lit(mask >> BITS)) == F.col("_run"))
            below = {x: F.col(f"p_{x}") for x in held}
        here = here.select("run", "total", *[((F.col(f"n_{x}") + PRIOR * below[x]) / (F.col(f"t_{x}") + PRIOR)).alias(f"q_{x}") for x in held])
        lower = here.select(F.col("run").alias("_run"), *[F.col(f"q_{x}").alias(f"p_{x}") for x in held])
    return here.select("run", "total", *[
        F.round((F.log(f"q_{name}_a") - F.log(f"q_{name}_b")) * UNIT).cast("long").alias(name) for name, *_ in MODELS])


def summed_ratios(urls: DataFrame, table: DataFrame, hot: int = HOT) -> DataFrame:
    """(url, size, all, first, second) of distinct URLs: the sums of the ratios of their runs."""
    names = [m[0] for m in MODELS]
    n_all = table.agg(F.sum("total")).first()[0] or 0
    limit = n_all // hot
    top = table.where(F.col("total") > limit).select("run", *names).toArrow()  # fewer than ``hot`` rows
    order = np.argsort(top["run"].to_numpy())
    known = top["run"].to_numpy()[order], np.stack([top[c].to_numpy()[order] for c in names])
    sent = urls.sparkSession.sparkContext.broadcast(known)

    def look_up(batches):
        runs_known, values = sent.value
        for batch in batches:
            for a, b in W.slices(batch.column(0), W.SEGMENT):
                urls = batch.column(0)[a:b]
                run, row = runs(urls)
                at = np.minimum(np.searchsorted(runs_known, run), max(len(runs_known) - 1, 0))
                hit = runs_known[at] == run if len(runs_known) else np.zeros(len(run), bool)
                sums = np.zeros((len(names), b - a), np.int64)
                for x, v in zip(sums, values):
                    np.add.at(x, row[hit], v[at[hit]])
                rest = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=b - a))])
                yield pa.RecordBatch.from_arrays(
                    [urls, pa.array(np.bincount(row, minlength=b - a)), *map(pa.array, sums),
                     pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(run[~hit]))], ["url", "size", *names, "rest"])

    schema = f"url string, size long, {', '.join(f'{c} long' for c in names)}, rest array<long>"
    found = written(urls.select("url").mapInArrow(look_up, schema).withColumn("id", F.monotonically_increasing_id()), "url-sums")
    rare = table.where(F.col("total") <= limit).select(F.col("run").alias("_run"), *[F.col(c).alias(f"_{c}") for c in names])
    rest = found.where(F.size("rest") > 0).select("id", F.explode("rest").alias("run")).join(rare, F.col("run") == F.col("_run"))
    rest = rest.groupBy(F.col("id").alias("_id")).agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in names])
    both = found.drop("rest").join(rest, F.col("id") == F.col("_id"), "left")
    return both.select("url", "size", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names])


def threshold_of(scored: DataFrame) -> float:
    """The score that parts allowed from blocked URLs best, from (blocked, cross, n)."""
    tally = np.zeros((2, BINS))
    place = F.floor((F.col("cross") + REACH) * BINS / (2 * REACH))
    place = F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int")
    for r in scored.groupBy("blocked", place.alias("bin")).agg(F.sum("n")).collect():  # at most two rows a bin
        tally[r[0], r[1]] = r[2]
    allowed, blocked = tally / tally.sum(1, keepdims=True)
    kept = np.concatenate([np.cumsum(allowed[::-1])[::-1], [0.0]])  # allowed URLs at or above each bin's edge
    gone = np.concatenate([[0.0], np.cumsum(blocked)])
    best = np.flatnonzero(kept + gone >= (kept + gone).max() - 1e-12)
    return float(best[len(best) // 2] * 2 * REACH / BINS - REACH)  # the middle of equally good ones


def scores(urls: DataFrame, hot: int = HOT) -> tuple[DataFrame, float]:
    """(url, url_score) of distinct URLs (url, n, blocked, half), and the threshold."""
    trained = {(r[0], r[1]) for r in urls.where("blocked IS NOT NULL").select("blocked", "half").distinct().collect()}
    if {b for b, _ in trained} != {0, 1}:
        return urls.select("url", F.lit(0.0).alias("url_score")), 0.0
    table = written(ratios(written(run_counts(urls), "url-runs")), "url-ratios")
    sums = written(summed_ratios(urls, table, hot), "url-scores")
    mean = lambda c: F.col(c) / F.lit(float(UNIT)) / F.col("size")
    threshold = 0.0
    if len(trained) == 4:
        ruled = urls.where("blocked IS NOT NULL").select(F.col("url").alias("_url"), "n", "blocked", "half")
        cross = F.when(F.col("half") == 0, mean("second")).otherwise(mean("first"))
        threshold = threshold_of(ruled.join(sums, F.col("url") == F.col("_url")).select("blocked", "n", cross.alias("cross")))
    return sums.select("url", mean("all").alias("url_score")), threshold


def url_filter(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, url_score and verdict of every URL."""
    bound_batches(pages.sparkSession, 10_000)
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rule, verdict = rule_columns(host_of(text), path_of(text), rules)
    counted = pages.groupBy(text.alias("url")).agg(F.count(F.lit(1)).alias("n"))
    _, kind = rule_columns(host_of(F.col("url")), path_of(F.col("url")), rules)
    urls = written(counted.select("url", "n", (kind == "block").cast("long").alias("blocked"),
                                  (F.crc32(F.col("url").cast("binary")) % 2).alias("half")), "urls")
    scored, threshold = scores(urls)
    judged = F.when(F.col("_score") >= F.lit(threshold), F.lit("allow")).otherwise(F.lit("block"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "url_score", "verdict")]
    both = pages.join(scored.select(F.col("url").alias("_url_text"), F.col("url_score").alias("_score")), text == F.col("_url_text"))
    return both.select(*kept, F.col("_score").alias("url_score"), host_of(text).alias("host"), path_of(text).alias("path"),
                       rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"))
