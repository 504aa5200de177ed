"""Words of whole Arrow batches of texts, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from forecourt.llm.near_dup import GOLDEN, Powers, mix

#: White space of the byte range, at which words are cut.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes hashed at once; a longer word is hashed as a whole.
BLOCK = 1 << 20
#: A-Z to a-z.
LOWER = np.array([i | 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def byte_table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


class Words:
    """The words of a batch: byte places `starts` and `ends` in `data`, the row `of` each, and where each row's words begin (`first`, one more than rows).

    A null text has no words. `breaks` are further bytes that end a word, after which a new piece begins: `piece` counts
    them (and rows), so that words of one piece have the same number.
    """

    def __init__(self, texts: pa.Array, spaces: bytes = SPACES, breaks: bytes = b"", lower: bool = False):
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and len(bounds) else np.zeros(0, np.uint8)
        if lower:
            data = LOWER[data]
        bounds = bounds - bounds[0]
        if texts.null_count:  # what a null row may hold is no text
            gone = np.zeros(len(data) + 1, np.int8)
            null = np.asarray(texts.is_null())
            np.add.at(gone, bounds[:-1][null], 1)
            np.add.at(gone, bounds[1:][null], -1)
            gone = np.cumsum(gone[:-1]) > 0
        else:
            gone = None
        inside = ~byte_table(spaces + breaks)[data]
        if gone is not None:
            inside &= ~gone
        edges = np.zeros(len(data) + 1, bool)
        edges[bounds] = True
        before = np.concatenate(([False], inside[:-1])) & ~edges[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edges[1:]
        self.data, self.bounds, self.n_rows = data, bounds, len(texts)
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.of = np.repeat(np.arange(self.n_rows), np.diff(self.first))
        if breaks:
            self.piece = np.searchsorted(np.flatnonzero(byte_table(breaks)[data]), self.starts) + self.of  # neither ever falls

    def hashes(self, powers: Powers) -> np.ndarray:
        """64-bit hash of the bytes of each word."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK, side="right")))
            part = self.data[low : self.ends[to - 1]]
            powers.need(len(part))
            values = VALUES[part] * powers.up[: len(part)]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
            a, b = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix((total[b] - total[a]) * powers.down[a] + (b - a).astype(np.uint64) * GOLDEN)
            at = to
        return out

    def joined(self, kept: np.ndarray) -> list[bytes]:
        """For each row, its kept words joined by one space."""
        change = np.zeros(len(self.data) + 1, np.int8)
        change[self.starts[kept]] += 1
        np.add.at(change, self.ends[kept], -1)
        whole = np.cumsum(change[:-1], dtype=np.int8) > 0
        words = np.flatnonzero(kept)
        more = words[:-1][self.of[words[:-1]] == self.of[words[1:]]]  # another kept word of the row follows, so a separator does
        data = self.data.copy()
        data[self.ends[more]] = 0x20
        whole[self.ends[more]] = True
        places = np.concatenate(([0], np.cumsum(whole)))[self.bounds]
        out = data[whole].tobytes()
        return [out[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, whatever rows they are of."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h ^ words[i : n + i]) + GOLDEN
    return h
