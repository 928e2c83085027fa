"""Elias-Fano code of ascending integers, with sampled select.

Of each value the lowest `low_bits` bits lie packed side by side; the rest is a bit vector in which value i sets bit
(value >> low_bits) + i. That takes about 2 + log2(largest / count) bits a value. Every `SAMPLE`-th set bit has its place
in a table of 32-bit numbers, so that any value is found by looking at a bounded number of ones.
"""

from __future__ import annotations

import json

import numpy as np

SAMPLE = 512


def _packed(values: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` bits of every value, least significant first, without gaps."""
    if not bits or not len(values):
        return b""
    spread = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Code of non-decreasing integers. Only the first value's size is free; the others are stored as distances from it."""
    values = np.asarray(values, np.int64)
    n = len(values)
    base = int(values[0]) if n else 0
    away = values.view(np.uint64) - np.uint64(base % 2**64)  # modulo 2^64, so any span fits
    largest = int(away[-1]) if n else 0
    bits = max(0, (largest // n).bit_length() - 1) if n else 0
    places = (away >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
    size = int(places[-1]) + 1 if n else 0
    if size >= 2**32:
        raise ValueError("too many values for 32-bit samples")
    ones = np.zeros(size, np.uint8)
    ones[places.astype(np.int64)] = 1
    low, high, samples = _packed(away, bits), np.packbits(ones, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes()
    head = json.dumps({"n": n, "base": base, "bits": bits, "size": size, "low": len(low), "high": len(high)}).encode()
    return len(head).to_bytes(4, "little") + head + low + high + samples


class EliasFano:
    """The coded values; nothing is decoded but what is asked for."""

    def __init__(self, code: bytes):
        end = 4 + int.from_bytes(code[:4], "little")
        head = json.loads(code[4:end])
        self.n, self.base, self.bits, self.size = head["n"], head["base"], head["bits"], head["size"]
        raw = np.frombuffer(code, np.uint8, offset=end)
        self._low, self._high = raw[: head["low"]], raw[head["low"] : head["low"] + head["high"]]
        self._samples = np.frombuffer(code, "<u4", offset=end + head["low"] + head["high"])

    def __len__(self) -> int:
        return self.n

    def select(self, first: int, stop: int) -> np.ndarray:
        """Values first to stop - 1: from the sample before the first to the sample after the last."""
        stop = min(stop, self.n)
        if first >= stop:
            return np.zeros(0, np.int64)
        block = first // SAMPLE
        begin = int(self._samples[block])
        after = (stop - 1) // SAMPLE + 1
        end = int(self._samples[after]) if after < len(self._samples) else self.size
        bits = np.unpackbits(self._high[begin // 8 : (end + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :])[first - block * SAMPLE : stop - block * SAMPLE] + begin
        values = (ones.astype(np.uint64) - np.arange(first, stop, dtype=np.uint64)) << np.uint64(self.bits)
        if self.bits:
            at, to = first * self.bits, stop * self.bits
            low = np.unpackbits(self._low[at // 8 : (to + 7) // 8], bitorder="little")[at % 8 :][: to - at].reshape(-1, self.bits)
            values |= low.astype(np.uint64) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))
        return (values + np.uint64(self.base % 2**64)).view(np.int64)

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])

    def find(self, value: int) -> int:
        """Place of the first value that is not less; `len` if there is none."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self[mid] < value else (low, mid)
        return low
