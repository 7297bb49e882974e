"""Whole texts of an Arrow batch as flat byte arrays, for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values; the output of one seed is a fixed permutation."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + _ODD * np.uint64(seed + 1))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay near ``limit`` bytes (one longer text is its own piece)."""
    if batch.num_rows == 0:
        return
    _, ends = flat_text(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row borders in them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    if n == 0 or data is None or borders[-1] == borders[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8, count=int(borders[-1] - borders[0]), offset=int(borders[0]))
    return raw, borders - borders[0]


def spans_hash(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of every span ``raw[start:stop]``: a sum of one spread value per (byte, place in the span), with the length.

    The values come from a finaliser and no power series, so texts that cancel out in a polynomial
    (a Thue-Morse word and its complement) do not meet.
    """
    sizes = stops - starts
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    total = np.zeros(len(place) + 1, np.uint64)
    with np.errstate(over="ignore"):
        code = (place << 8) | raw[place + np.repeat(starts, sizes)]
        far = code >= len(_SPREAD)
        value = _SPREAD[np.where(far, 0, code)] if far.any() else _SPREAD[code]
        value[far] = _spread(code[far])
        np.cumsum(value, out=total[1:])
        return mix((total[ends] - total[ends - sizes]) ^ mix(sizes.astype(np.uint64) + _ODD))


def _spread(code: np.ndarray) -> np.ndarray:
    """The value of a byte at a place, ``code`` being ``place * 256 + byte``."""
    with np.errstate(over="ignore"):
        return mix(code.astype(np.uint64) * _ODD + _M2)


_SPREAD = _spread(np.arange(1 << 16))
