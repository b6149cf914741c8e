"""JSON objects of large files, read by many tasks.

A file that is one array, or one object around an array, has no line ends to split at. It is
read as text whose lines end at ``}``, so the files are split as any text is. Where a split
begins, in a string or not and how deep, depends on all before it; a first pass therefore sums
up every split for both cases, the splits of a file are chained (one row each), and a second
pass cuts the objects out. What crosses the end of a split is joined again by the split in
which it began.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\\.|["{]', re.S)


def _braces(piece: str, quoted: bool) -> tuple[list[int], bool]:
    """Places of the opening braces outside strings, and whether the piece ends in a string."""
    found = []
    for m in _TOKEN.finditer(piece):
        if m[0] == '"':
            quoted = not quoted
        elif m[0] == "{" and not quoted:
            found.append(m.start())
    return found, quoted


def _by_split(batches):
    """(file, begin, pieces) of the splits in a partition's rows, as iterators in order."""
    from itertools import chain, groupby

    rows = chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in batches)
    for (file, begin), group in groupby(rows, key=lambda r: r[:2]):
        yield file, begin, (r[2] for r in group)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")


def _summaries(inner: str | None):
    head = re.compile(rf'"{re.escape(inner)}"\s*:\s*\[') if inner else None

    def summed(batches):
        for file, begin, pieces in _by_split(batches):
            state = [[0, 0, False], [0, 0, True]]  # depth, least depth and in a string, for either beginning
            nested, first = False, True
            for piece in pieces:
                if first and head:
                    nested = head.search(piece) is not None
                first = False
                for s in state:
                    opened, s[2] = _braces(piece, s[2])
                    s[0] += len(opened) - (not s[2])
                    s[1] = min(s[1], s[0])
            yield pa.RecordBatch.from_pylist([{"file": file, "begin": begin, "nested": nested, "plain": state[0][:2] + [int(state[0][2])],
                                              "quoted": state[1][:2] + [int(state[1][2])]}], schema=_SUMMARY)

    return summed


_SUMMARY = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("nested", pa.bool_()), ("plain", pa.list_(pa.int64())), ("quoted", pa.list_(pa.int64()))])
_SUMMARY_COLUMNS = "file string, begin long, nested boolean, plain array<long>, quoted array<long>"


def _chained(rows) -> dict:
    """(file, begin) -> in a string, depth, the depth around the objects, and where the open object began."""
    out, now = {}, None
    for r in sorted(rows, key=lambda r: (r["file"], r["begin"])):
        if now is None or now[0] != r["file"]:
            now = [r["file"], False, 0, int(r["nested"]), r["begin"]]
        file, quoted, depth, around, began = now
        out[file, r["begin"]] = quoted, depth, around, began
        change, least, ends_quoted = r["quoted"] if quoted else r["plain"]
        now = [file, bool(ends_quoted), depth + change, around, r["begin"] if depth + least <= around else began]
    return out


def _objects(starts):
    def cut(batches):
        for file, begin, pieces in _by_split(batches):
            quoted, depth, around, began = starts.value[file, begin]
            held, mine, out = [] if depth > around else None, False, []
            for piece in pieces:
                opened, quoted = _braces(piece, quoted)
                if held is None and depth + len(opened) > around:
                    held, mine = [piece[opened[around - depth]:] if depth <= around else piece], True
                elif held is not None:
                    held.append(piece)
                depth += len(opened) - (not quoted)
                if held is not None:
                    held.append("}")
                    if depth <= around:
                        out.append((None if mine else began, "".join(held)))
                        held = None
                if len(out) >= 1000:
                    yield record(file, begin, out)
                    out = []
            if held is not None:
                out.append((begin if mine else began, "".join(held)))
            if out:
                yield record(file, begin, out)

    def record(file, begin, out):
        return pa.RecordBatch.from_arrays([pa.array([file] * len(out)), pa.array([begin] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int64()),
                                           pa.array([t for _, t in out], pa.string())], ["file", "begin", "began", "value"])

    return cut


def json_objects(spark: SparkSession, path: str, inner: str | None = None) -> DataFrame:
    """(value): the objects of JSON files as texts. A file holds an array of them, or one after the
    other; with ``inner``, a file whose first object starts with an array of that name holds them there."""
    pieces = _pieces(spark, path)
    rows = pieces.mapInArrow(_summaries(inner), _SUMMARY_COLUMNS).collect()  # one row a split
    starts = spark.sparkContext.broadcast(_chained(rows))
    found = pieces.mapInArrow(_objects(starts), "file string, begin long, began long, value string")
    parts = found.where("began IS NOT NULL").groupBy("file", "began").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "value"))), lambda x: x["value"]), "").alias("value"))
    return found.where("began IS NULL").select("value").unionByName(parts.select("value"))
