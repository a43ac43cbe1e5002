"""Token ids of whole texts through a vocabulary file of the ``tokenizers`` library.

Both pre-tokenizers in use split text where a word ends, so the ids of a text are the ids of
its pieces one after the other. Pieces repeat far more often than texts: each distinct piece
of a worker is encoded once and kept in a bounded cache, and texts are put together by index.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .kernels import LOWER, SPACE, span_hashes, text_chunks

#: Bytes of text for which pieces are looked up at a time.
CHUNK = 1 << 20
#: Pieces that the library encodes at a time: its results take far more room than their ids.
ENCODE = 4096
#: Distinct pieces that a worker keeps.
CACHE = 1_500_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _other_space(data: np.ndarray) -> np.ndarray:
    """Whether each byte is the last one of a white-space character outside ASCII."""
    out = np.zeros(len(data), bool)
    one, two, three = data[:-2], data[1:-1], data[2:]
    out[1:] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    general = (one == 0xE2) & (two == 0x80) & (((three >= 0x80) & (three <= 0x8A)) | np.isin(three, [0xA8, 0xA9, 0xAF]))
    math = (one == 0xE2) & (two == 0x81) & (three == 0x9F)
    ogham, wide = (one == 0xE1) & (two == 0x9A) & (three == 0x80), (one == 0xE3) & (two == 0x80) & (three == 0x80)
    out[2:] |= general | math | ogham | wide
    return out


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, and each row's first piece (one more at the end).

    A piece is a run of white space (bytes 0x20, 0x09-0x0D) with the run of other bytes behind
    it, unless another white-space character of Unicode stands before the run. It is cut once
    more where punctuation of ASCII follows a Latin letter, and between a single white-space
    byte other than the blank and visible ASCII: there every pre-token of these vocabularies
    ends, whatever comes before or after.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = space[:-1]
    start = space & ~before
    start[1:] &= ~_other_space(data)[:-1]
    letter = _LETTER[data]
    if len(data) > 1:  # two-byte letters: 0xC3 and what follows, but for the signs of times and division
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    start[1:] |= letter[:-1] & _PUNCT[data[1:]]
    single = before & ~space
    if len(data) > 2:
        single[2:] &= ~space[:-2]
    single[1:] &= data[:-1] != 0x20
    single &= (data > 0x20) & (data < 0x7F)
    single[0] = False
    # a lone white-space byte behind other white space belongs to it
    if len(data) > 2:
        single[2:] &= start[1:-1]
    start |= single
    # a row's first byte starts a piece, and white space there isn't part of a run before it
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edge] = True
    start[0] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


class PieceEncoder:
    """Encodes Arrow columns of texts; one for each worker and vocabulary (:func:`encoder`)."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = lower
        # strings that the library takes out of a text before it splits it
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new pieces; ``keys`` are sorted and not known yet."""
        lengths, flats = [], []
        for at in range(0, len(keys), ENCODE):
            some = zip(starts[at : at + ENCODE].tolist(), ends[at : at + ENCODE].tolist())
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([data[a:b].tobytes().decode() for a, b in some], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter((i for x in ids for i in x), np.uint32, int(lengths[-1].sum())))
        length, flat = np.concatenate(lengths), np.concatenate(flats)
        at = len(self.store) + np.cumsum(length) - length
        self.store = np.concatenate((self.store, flat))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.length = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.length, place, length)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, offsets into them) for runs of rows."""
        for first, last, data, offsets in text_chunks(column, CHUNK):
            at = 0
            for row in [*self._with_added(data, offsets), last - first]:
                if row > at:
                    part = data[offsets[at] : offsets[row]]
                    ids, cuts = self._plain(part, offsets[at : row + 1] - offsets[at])
                    yield first + at, first + row, ids, cuts
                if row < last - first:
                    text = data[offsets[row] : offsets[row + 1]].tobytes().decode()
                    ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    yield first + row, first + row + 1, ids, np.array([0, len(ids)])
                at = row + 1

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that hold a string of an added token, in whatever case; encoded as a whole."""
        low, rows = LOWER[data].tobytes(), set()
        for mark in self.added:
            at = low.find(mark)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                rows.add(row)
                at = low.find(mark, int(offsets[row + 1]))
        return sorted(rows)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows without added tokens, and each row's offset into them."""
        data = LOWER[data] if self.lower else data
        starts, head = piece_spans(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys, where, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known = self._find(keys)
        if (new := known < 0).any():
            if len(self.keys) + int(new.sum()) > CACHE:
                self.keys, self.at, self.length, self.store = self.keys[:0], self.at[:0], self.length[:0], self.store[:0]
                new[:] = True
            self._learn(data, keys[new], starts[where[new]], ends[where[new]])
            known = self._find(keys)
        at, length = self.at[known][inverse], self.length[known][inverse]
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(stop) else 0
        index = np.repeat(at - (stop - length), length) + np.arange(total)
        return self.store[index], np.concatenate(([0], stop))[head]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, lower: bool) -> PieceEncoder:
    if (path, lower) not in _encoders:
        _encoders[path, lower] = PieceEncoder(path, lower)
    return _encoders[path, lower]
