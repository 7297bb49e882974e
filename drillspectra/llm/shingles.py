"""Word shingles of whole texts and their fast similarity sketches, vectorised over a slice of rows.

Words are the runs of non-whitespace bytes (``[^\\x20\\x09-\\x0D]+``) after lower-casing A-Z. A row's
set holds the 64-bit hashes of its distinct runs of ``width`` words; a row with fewer words has the
whole sequence as its one shingle, a row without words has the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrays import flat_text, mix, seeded, spans_hash

WIDTH = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_spans(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of every word; a row border always ends a word."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1]
    first = borders[:-1][borders[:-1] < borders[1:]]
    begin[first] = word[first]
    finish = word.copy()
    finish[:-1] &= space[1:]
    last = borders[1:][borders[:-1] < borders[1:]] - 1
    finish[last] = word[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(borders, starts, side="right") - 1


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, row after row, and the row borders in them."""
    raw, borders = flat_text(column)
    rows = len(borders) - 1
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    starts, stops, row = word_spans(raw, borders)
    words = spans_hash(lower_ascii(raw), starts, stops)
    counts = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(words)) - begin[row]
    usable = (place + width <= counts[row]) | ((place == 0) & (counts[row] < width))
    at = np.flatnonzero(usable)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(width):
            inside = place[at] + step < counts[row[at]]
            word = np.where(inside, words[np.minimum(at + step, len(words) - 1)], np.uint64(step + 1))
            value = mix(value * np.uint64(0x2545F4914F6CDD1D) + word)
    owner = row[at]
    order = np.argsort(value)
    if rows <= 65536:  # a stable sort of 16-bit keys is a radix sort
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def fingerprints(values: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums per set; equal sets agree in both."""
    with np.errstate(over="ignore"):
        return tuple(_row_sums(seeded(values, seed), borders) for seed in (101, 202))


def _row_sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[borders[1:]] - total[borders[:-1]]


def fast_sketches(values: np.ndarray, borders: np.ndarray, coordinates: int) -> np.ndarray:
    """One sketch row per set, filled round by round.

    Round ``i`` throws every element into one bin: a hashed bin in the first ``coordinates`` rounds,
    bin ``i - coordinates`` in the next ones, so that every bin fills. A bin keeps its smallest
    (round, hash) and a set leaves the rounds once its bins are full. Empty sets stay empty.
    """
    rows = len(borders) - 1
    sketch = np.full((rows, coordinates), _EMPTY, np.uint64)
    sizes = np.diff(borders)
    owner = np.repeat(np.arange(rows), sizes)
    low = np.uint64((1 << 55) - 1)
    for turn in range(2 * coordinates):
        if len(values) == 0:
            break
        hashed = seeded(values, turn)
        if turn < coordinates:
            bins = (hashed >> np.uint64(40)).astype(np.int64) % coordinates
        else:
            bins = np.full(len(values), turn - coordinates)
        candidate = (np.uint64(turn) << np.uint64(55)) | (mix(hashed) & low)
        if turn >= 256:
            raise ValueError("at most 128 coordinates")
        np.minimum.at(sketch.reshape(-1), owner * coordinates + bins, candidate)
        open_rows = (sketch == _EMPTY).any(axis=1)
        stay = open_rows[owner]
        values, owner = values[stay], owner[stay]
    return sketch


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One key per band and row, over the band's coordinates and its number."""
    rows, coordinates = sketch.shape
    width = coordinates // bands
    key = np.zeros((rows, bands), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(width):
            key = mix(key * np.uint64(0x2545F4914F6CDD1D) + sketch[:, step : width * bands : width])
        return mix(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
