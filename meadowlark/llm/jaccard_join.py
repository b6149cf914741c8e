"""Near-duplicate documents: an n-gram Jaccard join with Bayesian candidate pruning.

1. A text becomes the set of hashes of its five-word shingles; shorter texts are one
   shingle. Texts with equal sets are copies of each other and go on as one node.
2. Nodes meet in buckets of BANDS bands of ROWS MinHash values each. In a bucket, every
   node is paired with one pivot only, so a bucket of any size yields as many pairs as
   nodes. A bucket of which all pairs survive is done: its nodes are one cluster. In any
   other, all nodes but the pivot meet again, those that survived as well, with a pruned
   one as the next pivot, for ROUNDS rounds; what is left then stays paired unpruned. So of
   any two nodes of a bucket either they were compared themselves, or they are in one
   cluster.
3. Pruning compares MinHash values step by step and drops a pair once the posterior
   probability that its similarity reaches the threshold, under a uniform prior, is below
   TOLERANCE.
4. The remaining pairs connect nodes to clusters. A cluster is cut into blocks of bounded
   size; every two blocks meet in one task, which prunes in the same way and verifies the
   rest exactly. Only counts and the edges of a spanning forest leave the task, so a large
   group of near copies is never written out as pairs.
5. Components of those edges are the classes.

Defined results: null and empty texts and those of white space have no shingles and are in
a class of their own, without links; rows with equal ids are documents each; a row without
id takes part, and a class without any id has a null class id; an empty table gives an
empty result. Extra columns are ignored. Ids are whole numbers, or texts of such; other texts
are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm import words as W
from meadowlark.llm.batches import append_columns, bound_batches, written
from meadowlark.llm.components import Forest, components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
TOLERANCE = 1e-6
STEP = 16  # values compared before each look at the posterior
ROUNDS = 3
BLOCK_NODES, BLOCK_SHINGLES = 256, 400_000
BROADCAST_NODES = 1_000_000  # clustered nodes sent to every executor, some 60 bytes each; more are joined by a shuffle
_rng = np.random.default_rng(11)
_A = _rng.integers(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS).astype(np.uint32)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, offsets = W.word_hashes(*W.utf8(texts))
    found, at = W.windows(h, offsets, SHINGLE)
    begin = np.searchsorted(at, offsets)
    out = [np.sort(found[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    n_words = np.diff(offsets)
    for n in range(1, SHINGLE):
        if (few := np.flatnonzero(n_words == n)).size:
            whole, pos = W.windows(h, offsets, n)
            for i, x in zip(few, whole[np.searchsorted(pos, offsets[few])]):
                out[i] = W.mix(np.array([x ^ np.uint64(n)]))
    return [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x for x in out]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS * ROWS MinHash values, 16 bits each, of each non-empty set."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        size = np.array([len(sets[i]) for i in full])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        h = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                least = np.minimum.reduceat(h * _A[k] + _B[k], begin)
                out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def fingerprints(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that stand for a set; none for the empty set."""
    out = []
    for s in sets:
        if not len(s):
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            pair = W.mix(s).sum(dtype=np.uint64), W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        out.append(np.array(pair, np.uint64).tobytes())
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on). With a uniform prior the posterior after m of n
    matches is Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in [*range(STEP, BANDS * ROWS, STEP), BANDS * ROWS]:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, needed=None) -> np.ndarray:
    """Which of the rows of two signature matrices are still worth an exact look."""
    alive, matches, begin = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, m in needed or least_matches():
        matches = matches + (left[alive, begin:n] == right[alive, begin:n]).sum(1)
        go = matches >= m
        alive, matches, begin = alive[go], matches[go], n
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _facts(texts: pa.Array) -> list:
    ids, sizes, sigs = [], [], []
    for a, b in W.slices(texts, W.SEGMENT):
        sets = shingle_sets(texts[a:b])
        ids += fingerprints(sets)
        sizes += [len(s) for s in sets]
        sigs += [x.tobytes() for x in signatures(sets)]
    return [ids, sizes, sigs]


def _prune(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (node, pivot) with whether they survive."""
    @F.arrow_udf("boolean")
    def alive(left: pa.Array, right: pa.Array) -> pa.Array:
        both = [np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), -1) for x in (left, right)]
        return pa.array(survivors(*both))

    sigs = nodes.select("node", "sig")
    other = sigs.select(F.col("node").alias("pivot"), F.col("sig").alias("sig2"))
    return pairs.join(sigs, "node").join(other, "pivot").select("node", "pivot", alive("sig", "sig2").alias("alive"))


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b) that connect all nodes which share a bucket and survive pruning."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)])
    left = nodes.select("node", F.explode(keys).alias("band"), F.lit(True).alias("alive"))
    edges = None
    for turn in range(ROUNDS + 1):
        # the next pivot is a pruned node if there is one: false sorts first
        pivots = left.groupBy("band").agg(F.min(F.struct("alive", "node")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
        met = left.select("node", "band").join(pivots.select("band", F.col("least.node").alias("pivot")), "band").where("node <> pivot")
        if turn == ROUNDS:
            return edges.unionAll(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
        met = written(met, "bucket-members")
        judged = written(_prune(met.select("node", "pivot").distinct(), nodes), "judged-pairs")
        kept = judged.where("alive").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        edges = kept if edges is None else edges.unionAll(kept)
        dropped = judged.where("NOT alive").select("node", "pivot")
        if dropped.isEmpty():
            return edges
        opened = met.join(dropped, ["node", "pivot"], "left_semi").select("band").distinct()
        left = met.join(opened, "band", "left_semi").join(judged, ["node", "pivot"]).select("node", "band", "alive")


def _verified(sets, sigs, copies, ids, block, across, threshold, needed):
    """Links of a group of nodes: for each node the copies it links to, and a spanning forest."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    links, forest = np.zeros(n, np.int64), Forest()
    order = np.argsort(size, kind="stable")
    dense = _Dense(sets) if n > 64 else None
    for place, i in enumerate(order[:-1]):
        others = order[place + 1:]
        others = others[: np.searchsorted(size[others], size[i] / threshold * (1 + 1e-12), "right")]
        if across:
            others = others[block[others] != block[i]]
        if not len(others):
            continue
        others = others[survivors(np.broadcast_to(sigs[i], (len(others), sigs.shape[1])), sigs[others], needed)]
        if not len(others):
            continue
        if dense is not None and len(others) > 8:
            shared = dense.shared(i, others)
        else:
            shared = np.array([_common(sets[i], sets[j]) for j in others])
        linked = others[shared >= threshold * (size[i] + size[others] - shared) - 1e-9]
        links[i] += copies[linked].sum()
        links[linked] += copies[i]
        for j in linked:
            forest.join(ids[i], ids[j])
    return links, [forest.find(x) for x in ids]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class _Dense:
    """Which sets of a group hold which shingle, for shingles that two or more of them hold."""

    def __init__(self, sets):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values, which, n = np.unique(flat, return_inverse=True, return_counts=True)
        keep = n[which] > 1
        number = np.cumsum(n > 1) - 1
        self.bits = np.zeros((len(sets), (int((n > 1).sum()) + 7) // 8), np.uint8)
        column = number[which[keep]]
        np.bitwise_or.at(self.bits, (owner[keep], column >> 3), (1 << (column & 7)).astype(np.uint8))

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)


def _link(threshold: float):
    needed = least_matches(threshold)

    def link(batches):
        def done(group):
            rows = {r[0]: r for r in group}  # a node whose text came twice counts once
            if len(rows) < 2:
                return None
            rows = list(rows.values())
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            block = np.array([r[3] for r in rows])
            ids = [r[0] for r in rows]
            links, roots = _verified(sets, signatures(sets), np.array([r[1] for r in rows]), ids, block, key[1] != key[2], threshold, needed)
            at = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[at]), pa.array(np.array(roots, np.int64)[at]),
                                               pa.array(links[at])], ["node", "other", "links"])

        key, group = None, []
        for batch in batches:
            for *now, node, copies, shingles, block in zip(*[c.to_pylist() for c in batch.columns]):
                if now != key:
                    if group and (out := done(group)) is not None:
                        yield out
                    key, group = now, []
                group.append((node, copies, shingles, block))
        if group and (out := done(group)) is not None:
            yield out

    return link


def exact_links(docs: DataFrame, clustered: DataFrame, threshold: float) -> DataFrame:
    """(node, other, links) of every task: the copies linked to a node, and a node it is connected to.

    ``docs`` (key, text) give the shingles of the nodes in ``clustered`` (key, sid, node, copies, root, blocks).
    """
    if clustered.count() <= BROADCAST_NODES:
        clustered = F.broadcast(clustered)

    def sets(texts):
        found = [s for a, b in W.slices(texts, W.SEGMENT) for s in shingle_sets(texts[a:b])]
        return [[s.tobytes() for s in found], fingerprints(found)]

    texts = append_columns(docs.join(clustered, "key"), "text", sets, {"shingles": "binary", "own": "binary"}).where("own = sid")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    paired = texts.select("root", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_j"), "node", "copies", "shingles")
    keyed = paired.select("root", F.least("block", "_j").alias("bi"), F.greatest("block", "_j").alias("bj"), "node", "copies", "shingles", "block")
    dealt = keyed.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    return dealt.mapInArrow(_link(threshold), "node long, other long, links long")


def _key(key: str, text: str):
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.xxhash64(F.col(f"`{text}`").cast("string")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, key) of every document: the smallest id of its class, the number of
    other documents at the threshold or above, and its id or, without one, a hash of its text."""
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    plain = plain.withColumn("key", _key("doc_id", "text"))
    facts = written(append_columns(plain, "text", _facts, {"sid": "binary", "n": "long", "sig": "binary"}).drop("text"), "shingle-facts")
    grouped = facts.where("sid IS NOT NULL").groupBy("sid").agg(
        F.min("key").alias("key"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")

    clusters = components(candidate_edges(nodes))
    members = clusters.join(nodes.select("node", "sid", "key", "copies", "n"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_NODES, F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    clustered = members.join(sizes.select("root", blocks), "root").select("key", "sid", "node", "copies", "root", "blocks")
    found = written(exact_links(plain.select("key", "text"), written(clustered, "clustered-nodes"), threshold), "links")

    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("sid", "node", "first_id", "copies").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    per_set = named.join(ids, "root").join(links, "node", "left").select(
        "sid", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return facts.select("doc_id", "key", "sid").join(per_set, "sid", "left").select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "key")


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of every class, once if its row is repeated. Rows without
    id stay if no row of their class has one, once for each text.

    Texts are shuffled for rows with a repeated id only.
    """
    judged = written(near_duplicates(docs, key, text, **options), "near-duplicates")
    first = judged.where("doc_id <=> class_id").groupBy(F.col("key").alias("_key")).agg((F.count(F.lit(1)) > 1).alias("_many"))
    if first.count() <= BROADCAST_NODES:
        first = F.broadcast(first)
    kept = docs.join(first, _key(key, text) == F.col("_key"))
    own = F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)
    once = kept.where("_many").withColumn("_own", own).dropDuplicates(["_key", "_own"]).drop("_own")
    return kept.where("NOT _many").unionByName(once).drop("_key", "_many")
