"""Words and word n-grams of whole texts as 64-bit hashes, computed for an Arrow batch at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; one longer text is a piece of its own.
PIECE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WEIGHTS = mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_LOW = np.array([np.prod(np.full(i, 0xD1342543DE82EF95, dtype=_U), dtype=_U) for i in range(256)], dtype=_U)


def byte_codes(separators: str | None = None, letters: bool = False) -> np.ndarray:
    """A code per byte, 0 for what separates words; A-Z have the codes of a-z.

    ``separators``: those characters separate words. ``letters``: all ASCII but letters and digits separates words.
    """
    codes = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
    codes[65:91] = codes[97:123]
    if letters:
        low = np.arange(128)
        codes[:128][~((low >= 48) & (low < 58) | (low >= 65) & (low < 91) | (low >= 97) & (low < 123))] = 0
    else:
        codes[[ord(c) for c in separators]] = 0
    return codes


SPACES = byte_codes(" \t\n\v\f\r")
LETTERS = byte_codes(letters=True)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, row after the last, bytes, offsets``: runs of rows of about PIECE bytes. A null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        yield row, last, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where the words of each row begin in them (one more than rows)."""
    if len(data) == 0:
        return np.empty(0, _U), np.zeros(len(offsets), np.int64)
    values = codes[data]
    inside = values != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.empty(0, _U), bounds
    spans = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    powers = _LOW[place & 255]
    if len(place) and place.max() > 255:
        high = place >> 8
        powers = powers * _high_powers(int(high.max()))[high]
    return mix(np.add.reduceat(values[starts[0]:] * powers, starts - starts[0])), bounds


def _high_powers(most: int) -> np.ndarray:
    step = (_LOW[255:] * _LOW[1:2])[0]
    return np.cumprod(np.concatenate([[_U(1)], np.full(most, step, _U)]), dtype=_U)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, rows not regarded: item i starts at word i."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, _U)
    total = hashes[:count] * _WEIGHTS[0]
    for j in range(1, n):
        total = total + hashes[j:count + j] * _WEIGHTS[j]
    return mix(total + _U(n))


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of one short run of words."""
    return ngrams(hashes, len(hashes))[0]


def skipgrams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of words with one word between them."""
    if len(hashes) < 3:
        return np.empty(0, _U)
    return mix(hashes[:-2] * _WEIGHTS[0] + hashes[2:] * _WEIGHTS[2] + _U(1000))
