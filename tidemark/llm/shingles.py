"""Word shingles of whole texts as 64-bit hashes, computed over Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed in one numpy pass, about.
CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5
#: A-Z to a-z, and the bytes \x20 and \x09-\x0D that part words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS


def word_hashes(texts: list[bytes], lower: bytes = LOWER, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word's index of each text (one more at the end).

    Bytes are translated by `lower`; those that `parts` marks stand between words, a space among them.
    """
    joined = b" ".join([*texts, b""]).translate(lower)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    buf = np.frombuffer(joined, np.uint8)
    inside = np.concatenate([[False], ~parts[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(buf) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * power[: len(buf)])])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def _pieces(text: bytes, lower: bytes, parts: np.ndarray) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK_BYTES, cut between words."""
    text = text.translate(lower)
    buf, begin = np.frombuffer(text, np.uint8), 0
    while begin < len(text):
        end = begin + CHUNK_BYTES
        while end < len(text) and not len(gap := np.flatnonzero(parts[buf[end : end + 4096]])):
            end += 4096
        end = min(len(text), end + int(gap[0]) if end < len(text) else end)
        yield text[begin:end]
        begin = end


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Runs of texts of about CHUNK_BYTES; a longer text is a run of its own."""
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if chunk and size + len(text) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def _hashed(texts: list[bytes], lower: bytes, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
        words = np.concatenate([word_hashes([p], lower, parts)[0] for p in _pieces(texts[0], lower, parts)])
        return words, np.array([0, len(words)])
    return word_hashes(texts, lower, parts)


def word_stream(texts: list[bytes | None], lower: bytes = LOWER, parts: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order; none for null."""
    for chunk in _chunks(texts):
        words, first = _hashed(chunk, lower, parts)
        yield from (words[a:b] for a, b in zip(first[:-1], first[1:], strict=True))


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted hashes.

    A text of fewer than five words has one shingle, its whole sequence; a
    text without words, or null, has none.
    """
    for chunk in _chunks(texts):
        yield from _sets(chunk)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    words, first = _hashed(texts, LOWER, SPACE)
    n = len(words) - SHINGLE_WORDS + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE_WORDS if n > 0 else 0):
        rolled += words[k : k + n] * _PLACE[k]
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE_WORDS:
            yield np.unique(rolled[a : b - SHINGLE_WORDS + 1])
        elif b > a:
            short = np.array([sum(int(w) * int(c) for w, c in zip(words[a:b], _PLACE, strict=False)) + int(b - a) & (1 << 64) - 1], np.uint64)
            yield mix(mix(short) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
