"""The short content hash of a line: XXH32 (seed 0) of its characters that aren't blank, modulo 256, as two hex digits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import squeezed

try:
    from xxhash import xxh32_intdigest
except ImportError:  # the module is optional; results are the same
    xxh32_intdigest = None

#: The five primes of the hash.
P1, P2, P3, P4, P5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
_M = 0xFFFFFFFF


def _rotate(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & _M


def plain_xxh32(data: bytes) -> int:
    """XXH32 with seed 0, from its published description."""
    at, end = 0, len(data)
    word = lambda i: int.from_bytes(data[i : i + 4], "little")
    if end >= 16:
        lanes = [(P1 + P2) & _M, P2, 0, -P1 & _M]
        while at + 16 <= end:
            for j in range(4):
                lanes[j] = _rotate((lanes[j] + word(at + 4 * j) * P2) & _M, 13) * P1 & _M
            at += 16
        h = sum(_rotate(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True))
    else:
        h = P5
    h = (h + end) & _M
    while at + 4 <= end:
        h = _rotate((h + word(at) * P3) & _M, 17) * P4 & _M
        at += 4
    for byte in data[at:]:
        h = _rotate((h + byte * P5) & _M, 11) * P1 & _M
    for shift, prime in ((15, P2), (13, P3)):
        h = (h ^ (h >> shift)) * prime & _M
    return h ^ (h >> 16)


def two_digits(squeezed_text: str) -> str:
    data = squeezed_text.encode("utf-8", "surrogatepass")
    return f"{(xxh32_intdigest(data) if xxh32_intdigest else plain_xxh32(data)) % 256:02x}"


@F.arrow_udf(StringType())
def _hashes(column: pa.Array) -> pa.Array:
    known: dict[str, str] = {}
    out = []
    for s in column.to_pylist():
        h = None if s is None else known.get(s)
        if h is None and s is not None:
            h = known[s] = two_digits(s)
        out.append(h)
    return pa.array(out, pa.string())


def line_hash(text: Column | str) -> Column:
    """Blanks are taken out in the JVM; Arrow batches go to the hash."""
    return _hashes(squeezed(text))
