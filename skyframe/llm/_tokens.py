"""Token ids of whole Arrow columns: distinct pieces of text are encoded once, the rest is gathering.

The byte-level vocabularies used here never join text across a single space that stands between two characters that are
no white space: there a new piece begins. So texts are cut in front of such spaces and each distinct piece is
encoded once by the ``tokenizers`` library itself; the ids of a text are those of its pieces in order.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from skyframe.llm._common import prefix_sums, span_hash, text_chunks

#: Large enough that most pieces of a chunk are known from within it.
_CHUNK_BYTES = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of every white space character beyond ASCII.
_MAY_BE_WHITE = np.zeros(256, bool)
_MAY_BE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class PieceEncoder:
    """Encodes with a vocabulary file of the ``tokenizers`` library; one per Python worker."""

    def __init__(self, path: str, remember: int = 750_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __call__(self, texts: pa.Array):
        """Yields ``(i, j, ids, ends)``: the ids of rows [i, j) one after the other, row k ending at ends[k - i]."""
        for i, j, data, offsets in text_chunks(texts, _CHUNK_BYTES):
            starts, ends, row = self._pieces(data, offsets)
            lengths, ids = self._encode(data, starts, ends)
            per_row = np.bincount(row, weights=lengths, minlength=j - i).astype(np.int64)
            yield i, j, ids, np.cumsum(per_row)

    @staticmethod
    def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            white = _WHITE[data]
            ok = (data[1:-1] == 0x20) & ~white[:-2] & ~white[2:] & ~_MAY_BE_WHITE[data[2:]]
            # a character of two or three bytes before the space may be white space, by its first byte
            ok &= ~((data[:-2] >= 0x80) & np.concatenate([[False], data[:-3] == 0xC2]))
            if n > 3:
                ok[2:] &= ~((data[2:-2] >= 0x80) & _MAY_BE_WHITE[data[:-4]]) if n > 4 else True
            cut[1 : n - 1] = ok
        cut[offsets] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        name = span_hash(prefix_sums(data), starts, ends)
        distinct, first, back = np.unique(name, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == distinct[hit]
        if not hit.all():
            if len(self.known) + len(distinct) > self.remember and len(self.known):
                self.clear()
                hit[:] = False
            new = np.flatnonzero(~hit)
            raw = data.tobytes()
            strings = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            n = np.fromiter(map(len, encoded), np.int64, len(encoded))
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.fromiter((x for e in encoded for x in e), np.int32, int(n.sum()))])
            place = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, place, distinct[new])
            self.at, self.n = np.insert(self.at, place, at), np.insert(self.n, place, n)
            place = np.searchsorted(self.known, distinct)
        lengths, at = self.n[place][back], self.at[place][back]
        total = int(lengths.sum())
        step = np.repeat(at - (np.cumsum(lengths) - lengths), lengths)
        return lengths, self.ids[step + np.arange(total)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
