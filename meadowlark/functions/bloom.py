"""A filter of 64-bit hashes of bounded size, built by tasks and sent to tasks.

It answers "maybe" or "no", so what passes must be compared again. Its size follows the number
of hashes up to ``MOST_BITS``; beyond that more hashes pass, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 27  # 16 MB at most
_PROBES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def n_bits(keys: int) -> int:
    return min(max(1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _places(h: np.ndarray, bits: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and bit that a probe looks at."""
    with np.errstate(over="ignore"):
        at = (h * np.uint64(_PROBES[probe])) >> np.uint64(64 - (bits.bit_length() - 1))
    return (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)


def add(cells: np.ndarray, h: np.ndarray) -> None:
    for k in range(len(_PROBES)):
        cell, bit = _places(h, 64 * len(cells), k)
        np.bitwise_or.at(cells, cell, np.uint64(1) << bit)


def maybe(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may have been added."""
    at = np.arange(len(h))
    for k in range(len(_PROBES)):
        cell, bit = _places(h[at], 64 * len(cells), k)
        at = at[((cells[cell] >> bit) & np.uint64(1)).astype(bool)]
    return at


def build(hashes: DataFrame, keys: int) -> np.ndarray:
    """The filter of the one long column of ``hashes``. Tasks fill their own; at most
    ``MOST_BITS / 64`` numbers reach the driver."""
    bits = n_bits(keys)

    def fill(batches):
        cells = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            add(cells, batch.column(0).to_numpy().view(np.uint64))
        at = np.flatnonzero(cells)
        for a in range(0, len(at), 8192):
            some = at[a: a + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some].view(np.int64))], ["cell", "bits"])

    parts = hashes.where(F.col(hashes.columns[0]).isNotNull()).mapInArrow(fill, "cell long, bits long")
    found = parts.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(bits // 64, np.uint64)
    cells[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return cells
