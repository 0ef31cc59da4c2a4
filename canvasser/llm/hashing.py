"""Vectorised hashes over UTF-8 bytes, shared by the text operators.

All hashes are polynomials modulo 2**64 computed from prefix sums, so a hash of any slice costs
two look-ups. Equal bytes give equal hashes at any place of any text, whatever task computes
them. Long repetitive strings can be made to clash under any such polynomial, so words of more
than ``LONGEST`` bytes take a cryptographic hash. Work goes in pieces of about ``PIECE`` bytes: memory is bounded by a piece (or by one
word, if that is longer), not by a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 20
LONGEST = 512
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

# Bytes of words: digits, letters (A-Z folded to a-z) and everything outside ASCII; 0 elsewhere.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values; another salt gives another function."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Weighted sums of the first 0, 1, ... len(values) values (small unsigned integers)."""
    up, _ = _powers(max(1, len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end) of what ``prefix_sums`` has summed."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts])


def digest(raw: bytes) -> np.uint64:
    """A cryptographic hash of the bytes, cut to 64 bits."""
    return np.uint64(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"))


def join_texts(texts) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of the texts, each followed by a line feed, and where each begins (and the end)."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return b"\n".join([*parts, b""]), starts


def words(data: bytes, table: np.ndarray = WORD_BYTES, halved: int = 0) -> tuple[np.ndarray, ...]:
    """Start, end and hash of every maximal run of bytes that ``table`` maps above 0.

    With ``halved`` also the hashes of the first and second halves (in bytes) of the words of so
    many bytes or more.
    """
    raw = np.frombuffer(data, np.uint8)
    found, begin = [], 0
    while begin < len(raw):
        end = min(begin + PIECE, len(raw))
        step = 4096
        while end < len(raw) and table[raw[end - 1]]:  # a piece ends behind a separator
            tail = np.flatnonzero(table[raw[end : end + step]] == 0)
            end = end + int(tail[0]) + 1 if len(tail) else min(end + step, len(raw))
            step *= 2
        folded = table[raw[begin:end]]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], folded > 0, [False])).astype(np.int8)))
        s, e = edges[::2], edges[1::2]
        sums = prefix_sums(folded)
        value = slice_hashes(sums, s, e)
        for k in np.flatnonzero(e - s > LONGEST).tolist():
            value[k] = digest(folded[s[k] : e[k]].tobytes())
        part = (s + begin, e + begin, value)
        if halved:
            long = e - s >= halved
            s, e = s[long], e[long]
            middle = (s + e) // 2
            part += (slice_hashes(sums, s, middle), slice_hashes(sums, middle, e))
        found.append(part)
        begin = end
    if not found:
        return (*(np.zeros(0, np.int64),) * 2, *(np.zeros(0, np.uint64),) * (3 if halved else 1))
    return tuple(np.concatenate(x) for x in zip(*found))


def beginnings(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int, table: np.ndarray = WORD_BYTES) -> np.ndarray:
    """Hashes of the first ``size`` characters of the words [start, end); other values than those of whole words."""
    raw = np.frombuffer(data, np.uint8)
    out, seen = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    going = np.arange(len(starts))
    for step in range(4 * size):  # a character has four bytes at most
        going = going[starts[going] + step < ends[going]]
        byte = table[raw[starts[going] + step]]
        seen[going] += (byte & 0xC0) != 0x80
        inside = seen[going] <= size
        going = going[inside]
        with np.errstate(over="ignore"):
            out[going] = out[going] * _BASE + byte[inside].astype(np.uint64) + np.uint64(1)
    return mix(out, 60)


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values (order matters)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * _BASE + hashes[i : i + n]
    return mix(out, salt)


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: group of each member, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - np.repeat(first, counts)
