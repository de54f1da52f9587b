"""Word arrays for numpy: a batch of texts as 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts, A-Z lower-cased, split at the six ASCII white-space characters.

    ids: the place in `vocab` (64-bit hashes of the distinct words) of each word,
    texts one after the other; ends: where each text ends in ids.
    """

    def __init__(self, texts: list[bytes]):
        seen: dict[bytes, int] = {}
        parts, ends, n = [], [], 0
        for text in texts:
            words = text.lower().split()  # bytes.lower() changes A-Z alone, bytes.split() splits at \x09-\x0d and \x20
            for w in words:
                if w not in seen:
                    seen[w] = len(seen)
            parts.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
            ends.append(n := n + len(words))
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.ends = np.array(ends, np.int64)
        self.vocab = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))

    def spans(self) -> Iterator[tuple[int, int]]:
        start = 0
        for end in self.ends.tolist():
            yield start, end
            start = end


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a shorter text is one shingle, one without words has none."""
    h = words.vocab[words.ids]
    out = []
    for start, end in words.spans():
        w = h[start:end]
        if not len(w):
            out.append(w)
            continue
        n = min(k, len(w))
        s = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            s = mix(s * ODD + w[i : len(w) - n + 1 + i])
        out.append(np.unique(s))
    return out


def text_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch, column: str, most: int = 8 << 20) -> Iterator:
    """Parts of an Arrow batch with about `most` bytes of text each, one row at least."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
