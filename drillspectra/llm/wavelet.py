"""Wavelet matrix of a token sequence: bit planes with rank blocks in one self-describing file."""

from __future__ import annotations

import json

import numpy as np

MAGIC = b"WVLM0001"
#: Bits between two stored rank counts.
BLOCK = 512


class WaveletMatrix:
    """Access, rank, select and counting without unpacking the planes.

    Ids are numbered by the sorted table of those that occur; plane 0 holds the top bit of the
    numbers. Each plane sends its zeros to the front of the next one and its ones behind them, both
    in order.
    """

    def __init__(self, alphabet: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int], size: int):
        self.alphabet, self.planes, self.ranks, self.zeros, self.size = alphabet, planes, ranks, zeros, size

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        used = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype(np.uint32)
        number = np.cumsum(used) - 1
        depth = max(int(len(alphabet) - 1).bit_length(), 1)
        now = number.astype(np.uint16 if depth <= 16 else np.uint32)[ids]
        planes, ranks, zeros = [], [], []
        for shift in range(depth - 1, -1, -1):
            bit = (now & (1 << shift)) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            ranks.append(_ranks(packed))
            low = now.compress(~bit)
            zeros.append(len(low))
            now = np.concatenate([low, now.compress(bit)])
        return cls(alphabet, planes, ranks, zeros, len(ids))

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        values = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.size).view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~bit)] = values[: self.zeros[level]]
            above[np.flatnonzero(bit)] = values[self.zeros[level] :] | values.dtype.type(1 << (len(self.planes) - 1 - level))
            values = above
        return self.alphabet[values] if len(self.alphabet) else values.astype(np.uint32)

    def _ones(self, level: int, position: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        position = np.asarray(position, np.int64)
        block, byte = position // BLOCK, position // 8
        out = self.ranks[level][block].astype(np.int64)
        plane = self.planes[level]
        for step in range(BLOCK // 8):
            at = block * (BLOCK // 8) + step
            whole = at < byte
            if not whole.any():
                break
            out += np.where(whole, _POP[plane[np.minimum(at, max(len(plane) - 1, 0))]], 0)
        rest = position % 8
        if len(plane):
            out += np.where(rest > 0, _POP[plane[np.minimum(byte, len(plane) - 1)] >> (8 - rest).astype(np.uint8).clip(0, 7)] , 0)
        return out

    def access(self, position) -> np.ndarray:
        """Ids at positions."""
        at = np.atleast_1d(np.asarray(position, np.int64))
        value = np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[at // 8] >> (7 - at % 8).astype(np.uint8)) & 1
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            value = value * 2 + bit
        return self.alphabet[value]

    def rank(self, token: int, position: int) -> int:
        """Occurrences of an id before a position."""
        start, stop = self._range(token, position)
        return stop - start

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        place = int(np.searchsorted(self.alphabet, token))
        if place == len(self.alphabet) or self.alphabet[place] != token:
            return 0, 0
        start = 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, np.array([start, stop])).tolist()
            if (place >> (len(self.planes) - 1 - level)) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def select(self, token: int, occurrence: int) -> int:
        """Position of the n-th occurrence (from 0) of an id."""
        start, stop = self._range(token, self.size)
        if not 0 <= occurrence < stop - start:
            raise IndexError("no such occurrence")
        at = start + occurrence
        for level in range(len(self.planes) - 1, -1, -1):
            one = at >= self.zeros[level]
            wanted = at - self.zeros[level] if one else at
            lo, hi = 0, self.size
            while lo < hi:  # first position with more than ``wanted`` such bits up to it
                mid = (lo + hi) // 2
                ones = int(self._ones(level, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) > wanted:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def write(self, out, documents: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> None:
        """Planes with the document table: ids of documents, which of them are known, tokens of each."""
        parts = [self.alphabet.astype("<u4"), documents.astype("<i8"), np.packbits(known), lengths.astype("<i8")]
        for plane, ranks in zip(self.planes, self.ranks):
            parts += [plane, ranks.astype("<u4")]
        head = json.dumps({"size": self.size, "documents": len(documents), "zeros": self.zeros, "bytes": [p.nbytes for p in parts]}).encode()
        out.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for part in parts:
            out.write(memoryview(part).cast("B") if part.nbytes else b"")

    @classmethod
    def read(cls, file) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        head = json.loads(file.read(int.from_bytes(file.read(8), "little")))
        parts = []
        for size in head["bytes"]:
            raw = file.read(size)
            if len(raw) != size:
                raise ValueError("the file is cut short")
            parts.append(raw)
        alphabet, documents, known, lengths = parts[:4]
        matrix = cls(np.frombuffer(alphabet, "<u4"), [np.frombuffer(p, np.uint8) for p in parts[4::2]],
                     [np.frombuffer(p, "<u4") for p in parts[5::2]], head["zeros"], head["size"])
        lengths = np.frombuffer(lengths, "<i8")
        if lengths.sum() != head["size"] or len(lengths) != head["documents"]:
            raise ValueError("document lengths and tokens disagree")
        return matrix, np.frombuffer(documents, "<i8"), np.unpackbits(np.frombuffer(known, np.uint8), count=len(lengths)).astype(bool), lengths


_POP = np.array([bin(v).count("1") for v in range(256)], np.int64)


def _ranks(packed: np.ndarray) -> np.ndarray:
    """Ones before every block, and before the end."""
    step = BLOCK // 8
    counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % step))).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])
