"""Words and shingles of texts as 64-bit numbers, computed for many texts at once with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
#: Bytes of text that are hashed at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit numbers (a multiply and shift finaliser)."""
    x = (x + _A) * _B
    x ^= x >> np.uint64(31)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters, so that memory doesn't follow the batch."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if texts:
        yield first, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, A-Z lowered, and for each text the place where its words begin (one more entry at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    blank = _BLANK[joined]
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    text_at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
    bounds = np.searchsorted(begins, text_at)
    if not len(begins):
        return np.zeros(0, dtype=np.uint64), bounds
    places = np.flatnonzero(~blank)
    heads = np.searchsorted(places, begins)
    lengths = np.diff(np.concatenate((heads, [len(places)])))
    at = (np.arange(len(places)) - np.repeat(heads, lengths)).astype(np.uint64)
    h = np.add.reduceat(mix((at << np.uint64(8)) + joined[places]), heads)
    return mix(h ^ lengths.astype(np.uint64)), bounds


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; place matters."""
    out = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(n):
        out += words[k : k + len(out)] * factors[k]
    return mix(out)


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, ascending: all runs of ``width`` words, or the whole sequence where it is shorter."""
    for first, last in slices(texts):
        words, bounds = word_hashes(texts[first:last])
        grams = gram_hashes(words, width)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= width:
                s = np.sort(grams[lo : hi - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif hi > lo:
                yield mix(gram_hashes(words[lo:hi], hi - lo) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """One signed 64-bit number for a set: equal sets have equal keys; among N different sets the chance of any clash is about N^2 / 2^65."""
    total = mix(np.array([mix(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))], dtype=np.uint64))
    return int(total.view(np.int64)[0])
