"""Vectorised word splitting and hashing of document batches, shared by the word-based operators.

A batch of texts becomes one byte buffer; words are runs of bytes that are no separators. No
Python object is made per word. Hashes are 64-bit, stable between processes and depend on the
bytes of the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of a task whatever the batch size.
CHUNK_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def separators(spec: str) -> np.ndarray:
    """256 flags: byte is no part of a word. `space`: white space of ASCII; `alnum`, `letters`: all ASCII but 0-9A-Za-z, or but A-Za-z."""
    out = np.zeros(256, bool)
    if spec == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    elif spec == "alnum":
        out[:128] = [not chr(c).isalnum() for c in range(128)]
    elif spec == "letters":
        out[:128] = [not chr(c).isalpha() for c in range(128)]
    else:
        raise ValueError(f"unknown word rule {spec!r}")
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer: spreads every input bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about `limit` bytes: (index of the first, UTF-8 bytes); null is empty."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        raw = b"" if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def pieces(rows: pa.RecordBatch | pa.Array, column: int = 0, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """Consecutive slices of a batch with about `limit` bytes of text, one row at least.

    Only a slice at a time becomes Python objects, so a worker holds little besides the batch itself.
    """
    texts = rows if isinstance(rows, pa.Array) else rows.column(column)
    reach = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, before = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(reach, before + limit, "right")))
        yield rows.slice(first, last - first)
        first, before = last, int(reach[last - 1])


def split(docs: list[bytes], spec: str, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some documents: (buffer, starts, ends, first word of each document and the total).

    `lower` folds A-Z only. Starts and ends are byte offsets into the buffer.
    """
    joined = b" ".join(docs) + b" "
    buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    sep = separators(spec)[buf]
    sizes = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    ends_of_docs = np.cumsum(sizes)
    edges = np.flatnonzero(np.diff(sep, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_docs, "left")])
    return buf, starts, ends, bounds


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: mixed polynomial of its bytes and length."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    longest = int(lengths.max())
    power = _powers(1 << max(6, int(longest - 1).bit_length()))
    letters = buf[place + np.repeat(starts, lengths)].astype(_U) + _U(1)
    letters *= power[place]
    return mix(np.add.reduceat(letters, total[:-1]) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct `width`-word shingles of each document, sorted, and the bounds of each document.

    A document of fewer words, but not none, has its whole sequence as the only shingle.
    """
    counts = np.diff(bounds)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), _U)
    for k in range(width):
        rolled = rolled * _U(0xC2B2AE3D27D4EB4F) + words[k : k + len(rolled)] if len(rolled) else rolled
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = owner[: len(rolled)] == owner[width - 1 : width - 1 + len(rolled)]
    held, who = mix(rolled[whole] + _U(width)), owner[: len(rolled)][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for d in short:
            h = 0
            for w in words[bounds[d] : bounds[d + 1]].tolist():
                h = (h * 0xC2B2AE3D27D4EB4F + w) & 0xFFFFFFFFFFFFFFFF
            extra.append((h + int(counts[d])) & 0xFFFFFFFFFFFFFFFF)
        held, who = np.concatenate([held, mix(np.array(extra, _U))]), np.concatenate([who, short])
    order = np.lexsort((held, who))
    held, who = held[order], who[order]
    fresh = np.ones(len(held), bool)
    fresh[1:] = (held[1:] != held[:-1]) | (who[1:] != who[:-1])
    held, who = held[fresh], who[fresh]
    return held, np.searchsorted(who, np.arange(len(counts) + 1))
