"""The filter of hashes (``meadowlark.functions.bloom``)."""

from meadowlark.functions.bloom import BITS_PER_KEY, LEAST_BITS, MOST_BITS, add, build, maybe, n_bits  # noqa: F401
