"""Column functions for dense vectors kept as array<float> or array<double>."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType

from meadowlark.functions.text import col


def _as_doubles(c) -> Column:
    return col(c).cast("array<double>")


def l2_normalize(c) -> Column:
    v = _as_doubles(c)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def quantize(c, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Codes 0..255 of the range."""
    span = float(hi) - float(lo)
    return F.transform(_as_doubles(c), lambda x: F.least(F.lit(255), F.greatest(
        F.lit(0), F.floor((x - F.lit(float(lo))) / F.lit(span) * 255).cast("int"))))


def dequantize(codes, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.transform(col(codes), lambda b: b * (F.lit(float(hi)) - F.lit(float(lo))) / 255 + F.lit(float(lo)))


def _bytes_of(lists: pa.Array, kind: pa.DataType) -> pa.Array:
    """The values of each list as raw little-endian bytes: the value buffer, cut at other offsets."""
    lists = lists.cast(pa.large_list(kind))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    cuts = pa.array(offsets * values.itemsize).buffers()[1]
    whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, cuts, pa.py_buffer(np.ascontiguousarray(values))])
    return pc.if_else(lists.is_valid(), whole, None).cast(pa.binary())


def _lists_of(packed: pa.Array, kind: pa.DataType, out: pa.DataType) -> pa.Array:
    whole = packed.cast(pa.large_binary())
    kept = np.dtype(kind.to_pandas_dtype())
    _, cuts, data = whole.buffers()
    offsets = np.frombuffer(cuts, np.int64)[whole.offset: whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and len(whole) else np.zeros(0, np.uint8)
    flat = np.frombuffer(raw.tobytes(), kept)
    cut = pa.array(((offsets - offsets[0]) // kept.itemsize).astype(np.int32))
    return pc.if_else(whole.is_valid(), pa.ListArray.from_arrays(cut, pa.array(flat).cast(out)), None)


@F.arrow_udf(BinaryType())
def _code_bytes(codes: pa.Array) -> pa.Array:
    return _bytes_of(codes, pa.uint8())


@F.arrow_udf(ArrayType(IntegerType()))
def _byte_codes(packed: pa.Array) -> pa.Array:
    return _lists_of(packed, pa.uint8(), pa.int32())


@F.arrow_udf(BinaryType())
def _float_bytes(vectors: pa.Array) -> pa.Array:
    return _bytes_of(vectors, pa.float32())


@F.arrow_udf(ArrayType(FloatType()))
def _byte_floats(packed: pa.Array) -> pa.Array:
    return _lists_of(packed, pa.float32(), pa.float32())


def _one_line(c: Column) -> Column:
    """Without the line ends that Spark puts into long base64 texts."""
    return F.translate(c, "\r\n", "")


def pack_codes(codes) -> Column:
    """Codes as base64 bytes."""
    return _one_line(F.base64(_code_bytes(col(codes))))


def unpack_codes(packed) -> Column:
    return _byte_codes(F.unbase64(col(packed)))


def pack_f32(vector) -> Column:
    """Little-endian float32 values as base64."""
    return _one_line(F.base64(_float_bytes(col(vector))))


def unpack_f32(packed) -> Column:
    return _byte_floats(F.unbase64(col(packed)))
