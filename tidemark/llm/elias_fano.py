"""Elias-Fano sequences in memory-mapped files, searched many values at a time.

A sorted sequence keeps the low bits of its values packed side by side and the
high bits as a unary bit vector in which bucket h is a run of ones closed by
the h-th zero. A directory of the zeros before every 64 bits makes selection
one search in the directory and one word. Files are written under a
temporary name and renamed, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np

U64 = np.uint64
_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.int64)


def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """The arrays of one sequence of sorted, unsigned values, under names with the prefix."""
    values = values.astype(U64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    at = (values >> U64(low)).astype(np.int64) + np.arange(n)
    size = (top >> low) + n + 1
    words = -(-size // 64)
    bits = np.zeros(words * 64, np.uint8)
    bits[at] = 1
    high = np.packbits(bits, bitorder="little").view(U64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))[:-1]]).astype(np.uint32)
    packed = np.zeros(n * low // 64 + 2, U64)
    if low and n:
        part = values & U64((1 << low) - 1)
        bit = np.arange(n, dtype=np.int64) * low
        word, shift = bit >> 6, (bit & 63).astype(U64)
        np.bitwise_or.at(packed, word, part << shift)
        spill = (bit & 63) + low > 64
        np.bitwise_or.at(packed, word[spill] + 1, part[spill] >> (U64(64) - shift[spill]))
    return {f"{prefix}.meta": np.array([n, low, top >> low], np.int64), f"{prefix}.high": high, f"{prefix}.zeros": zeros, f"{prefix}.low": packed}


class Sequence:
    """A sequence over the arrays that build() made."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.n, self.low, self.buckets = (int(x) for x in arrays[f"{prefix}.meta"])
        self.high, self.zeros, self.packed = (arrays[f"{prefix}.{k}"] for k in ("high", "zeros", "low"))

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Positions of the k-th zeros or ones."""
        before = self.zeros if zero else np.arange(len(self.zeros), dtype=np.uint32) * np.uint32(64) - self.zeros
        k = k.astype(np.uint32)
        block = np.searchsorted(before, k, "right") - 1
        word, rest = self.high[block], k - before[block]
        if zero:
            word = ~word
        at = block * 64
        for half in (32, 16, 8):
            low = word & U64((1 << half) - 1)
            held = np.bitwise_count(low)
            above = rest >= held
            rest = rest - held * above
            word = np.where(above, word >> U64(half), low)
            at += half * above
        return at + _BYTE[word, rest]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U64)
        bit = i * self.low
        if self.low <= 57:
            # The eight bytes from a value's first bit on hold all of it.
            eight = np.ndarray(self.packed.nbytes - 7, "<u8", self.packed, strides=(1,))
            return (eight[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.low) - 1)
        word, shift = bit >> 6, (bit & 63).astype(U64)
        both = (self.packed[word] >> shift) | np.where(shift > 0, self.packed[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return both & U64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions."""
        if not len(i):
            return np.zeros(0, U64)
        return ((self._select(i, False) - i).astype(U64) << U64(self.low)) | self._lows(i)

    def find(self, values: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
        """Position of each value, -1 where the sequence doesn't hold it."""
        return np.concatenate([self._find(values[k : k + chunk]) for k in range(0, len(values), chunk)]) if len(values) else np.zeros(0, np.int64)

    def _find(self, values: np.ndarray) -> np.ndarray:
        values = values.astype(U64)
        bucket = values >> U64(self.low)
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(bucket <= U64(self.buckets)) if self.n else np.zeros(0, np.int64)
        if not len(inside):
            return out
        b, want = bucket[inside].astype(np.int64), values[inside] & U64((1 << self.low) - 1)
        begin = np.where(b > 0, self._select(np.maximum(b - 1, 0), True) + 1, 0)
        # The bucket is the run of ones from here on.
        word, shift = begin >> 6, (begin & 63).astype(U64)
        here = (self.high[word] >> shift) | np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((U64(64) - shift) & U64(63)), U64(0))
        run = np.where(here == ~U64(0), 64, np.bitwise_count((here ^ (here + U64(1))) >> U64(1)).astype(np.int64))
        long = np.flatnonzero(run >= 63)
        if len(long):
            run[long] = self._select(b[long], True) - begin[long]
        # The last value of the bucket that is not above the wanted one; the open searches are kept together.
        at = begin - b
        open_ = np.flatnonzero(run > 1)
        low, left, aim = at[open_], run[open_], want[open_]
        while len(open_):
            half = left >> 1
            low = np.where(self._lows(low + half) <= aim, low + half, low)
            left -= half
            still = np.flatnonzero(left > 1)
            if 2 * len(still) <= len(open_):
                at[open_] = low
                open_, low, left, aim = open_[still], low[still], left[still], aim[still]
        hit = (run > 0) & (self._lows(np.minimum(at, self.n - 1)) == want)
        out[inside[hit]] = at[hit]
        return out


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else None


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays to one file in the shared folder."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [str(a.dtype), at, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text = text.ljust(-(-(len(text) + 8) // 64) * 64 - 8)
    blob = b"".join([len(text).to_bytes(8, "little"), text, *(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0") for a in arrays.values())])
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{local}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.write(blob)
        os.replace(draft, local)
    else:
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        with fs.open_output_stream(f"{inner}.draft") as f:
            f.write(blob)
        fs.move(f"{inner}.draft", inner)


def there(path: str) -> bool:
    """Whether the shared folder has this file."""
    if local := _local(path):
        return os.path.exists(local)
    from pyarrow.fs import FileSystem, FileType

    fs, inner = FileSystem.from_uri(path)
    return fs.get_file_info(inner).type == FileType.File


def _arrays(raw: np.ndarray) -> dict[str, np.ndarray]:
    raw = raw.view(np.ndarray)
    size = int(raw[:8].view(np.int64)[0])
    head = json.loads(bytes(raw[8 : 8 + size]))
    return {name: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in head.items()}


#: Open files, the one used longest ago first: those of a local shared folder, and copies of those of a remote one.
_MAPS: dict[str, np.ndarray] = {}
_COPIES: dict[str, np.ndarray] = {}
#: How many bytes of each kind a worker keeps open; mapping a local file again costs little, as its pages stay cached.
MAPPED_BYTES, COPIED_BYTES = 192 << 20, 2 << 30


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped and not read; none if there is no such file.

    A file that is not local is first copied to a nameless temporary file. A
    worker keeps the files it used last, MAPPED_BYTES or COPIED_BYTES of them at
    most.
    """
    local = _local(path)
    held, most = (_MAPS, MAPPED_BYTES) if local else (_COPIES, COPIED_BYTES)
    raw = held.pop(path, None)
    if raw is None:
        if not there(path):
            return {}
        raw = np.memmap(local, np.uint8, "r") if local else _copy(path)
    held[path] = raw
    while len(held) > 1 and sum(map(len, held.values())) > most:
        del held[next(iter(held))]
    return _arrays(raw)


def _copy(path: str) -> np.ndarray:
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    with fs.open_input_stream(inner) as f, tempfile.TemporaryFile() as t:
        while part := f.read(1 << 20):
            t.write(part)
        t.flush()
        return np.memmap(t, np.uint8, "r")
