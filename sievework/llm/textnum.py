"""Words of many texts at once, as numbers: vector code for Arrow batches, no Spark inside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Kinds of words, by which bytes (once A-Z are lower case) belong to one; bytes of a multi-byte
#: character always do, so bytes and characters give the same words.
KINDS = {"word": _ALNUM, "token": _SOLID}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_R = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes of text that are worked on at a time; one longer text is worked on alone.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of a base and of its inverse modulo a prime, as far as they were needed."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime, self.base = prime, base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = np.uint64(self.prime)
        while n > len(self.up):
            k = len(self.up)
            ahead, back = (np.uint64(pow(b, k, self.prime)) for b in (self.base, pow(self.base, -1, self.prime)))
            self.up, self.down = np.concatenate([self.up, self.up * ahead % p]), np.concatenate([self.down, self.down * back % p])
        return self.up, self.down


#: Two primes below 2**31 with a base each: a word's hash is its polynomial modulo both. Powers of two
#: as moduli would let different words of a regular form, such as Thue and Morse's, hash alike.
_POWERS = (_Powers(2147483647, 1103515245), _Powers(2147483629, 1664525013))
#: So many bytes can be summed up before a sum of terms below 2**40 must be reduced.
_SAFE = 1 << 23


def _polynomials(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Each word's polynomial modulo the prime, whatever stands before the word."""
    p = np.uint64(powers.prime)
    up, down = powers.upto(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    terms = body.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(body)]
    if len(body) > _SAFE:
        terms %= p
    np.cumsum(terms, out=sums[1:])
    return (sums[ends] - sums[starts]) % p * down[starts] % p


def _bounds(body: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in lower-case bytes."""
    inside = KINDS[kind][body]
    cut = np.zeros(len(body) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(body) else inside
    after = np.concatenate([inside[1:], [False]]) if len(body) else inside
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def word_counts(body: np.ndarray, offsets: np.ndarray, kind: str) -> np.ndarray:
    """How many words each text has."""
    return np.diff(np.searchsorted(_bounds(_LOWER[body], offsets, kind)[0], offsets))


class Words:
    """hashes: of all words of all texts in order; first: where each text's words begin, and the
    end; starts, ends: the words' bytes within the slice."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, kind: str) -> None:
        body = _LOWER[body]
        starts, ends = _bounds(body, offsets, kind)
        low, high = (_polynomials(body, starts, ends, x) for x in _POWERS)
        self.hashes = mix(mix(high << np.uint64(32) | low) + (ends - starts).astype(np.uint64))
        self.first = np.searchsorted(starts, offsets)
        self.starts, self.ends, self.body = starts, ends, body


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about SLICE_BYTES of text.
    A null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        own = offsets[row : end + 1]
        yield row, end, data[own[0] : own[-1]], own - own[0]
        row = end


def runs(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words of each text that begin at each word, and where each
    text's begin. A text of fewer words, but some, has one: of all its words."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(hashes)) - first[:-1][doc]
    keep = (at + n <= count[doc]) | ((at == 0) & (count[doc] < n))
    left = count[doc] - at  # words from here to the text's end
    out = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        step = np.zeros(len(hashes), np.uint64)
        step[: len(hashes) - k] = hashes[k:]
        out = mix(out * _R + np.where(left > k, step, np.uint64(k + 1)))
    begins = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(count)))]).astype(np.int64)
    return out[keep], begins


def pack(x: np.ndarray) -> bytes:
    """Numbers of a narrow range or sorted ones' steps, by byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    found = np.frombuffer(zstandard.decompress(blob), np.uint8)
    planes = found.reshape(width, len(found) // width)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
