"""Token ids of whole texts by a tokenizers file, with a table of pieces seen before.

The library takes some seven microseconds a word on one core. Texts repeat their words, so each worker
names the pieces of a text by vectorised hashing, looks the names up in an open-addressing table and
gives the library only pieces that it has not met. The table is bounded; a full one is started anew.
"""

from __future__ import annotations

import os
import zlib

import numpy as np

from kindred.llm import textkernel as K

#: A piece longer than this is encoded each time and never kept.
LONGEST_KEPT = 64
#: Pieces that one worker keeps.
MOST_KEPT = 1 << 19


class PieceTokenizer:
    """encode() gives what the library's encode(text, add_special_tokens=False) gives, plus an end id a row."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self._reset()

    def _reset(self) -> None:
        self.mask = np.uint64(2 * MOST_KEPT - 1)
        self.keys = np.zeros(2 * MOST_KEPT, np.uint64)  # 0: free
        self.slots = np.zeros(2 * MOST_KEPT, np.int32)
        self.count = 0
        self.at = np.zeros(1, np.int64)  # where each kept piece's ids start in self.ids
        self.ids = np.empty(0, np.int32)

    def _find(self, names: np.ndarray) -> np.ndarray:
        """The number of each name in the table, or -1."""
        out = np.full(len(names), -1, np.int64)
        open_, slot = np.arange(len(names)), names & self.mask
        want = names
        while len(open_):
            key = self.keys[slot]
            hit = key == want
            out[open_[hit]] = self.slots[slot[hit]]
            go = ~hit & (key != 0)
            open_, slot, want = open_[go], (slot[go] + np.uint64(1)) & self.mask, want[go]
        return out

    def _insert(self, names: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct names that are not in the table yet."""
        slot = names & self.mask
        while len(names):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]] = names[take]
            self.slots[slot[take]] = numbers[take]
            rest = np.ones(len(names), bool)
            rest[take] = False
            names, numbers, slot = names[rest], numbers[rest], slot[rest]
            taken = self.keys[slot] != 0
            slot = np.where(taken, (slot + np.uint64(1)) & self.mask, slot)

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each piece: all ids, and how many each has. One call for many pieces: they
        are joined by line feeds, and each id goes to the piece that its offset falls in."""
        enc = self.tokenizer.encode("\n".join(texts), add_special_tokens=False)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        begins = np.fromiter((a for a, _ in enc.offsets), np.int64, len(enc.ids))
        owner = np.searchsorted(starts, begins, "right") - 1
        return np.array(enc.ids, np.int32), np.bincount(owner, minlength=len(texts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids (uint32), each row's followed by the end id, and the offsets of the rows in them."""
        start, end = K.pieces(data, offsets)
        rows = len(offsets) - 1
        names = K.mix(K.Prefixes(data, names=K.FOLDED).name(start, end) + (end - start).astype(np.uint64)) | np.uint64(1)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.empty(0, np.int64)
        alone = end - start > LONGEST_KEPT
        if len(special):
            alone[np.maximum(0, np.searchsorted(start, special, "right") - 1)] = True
        if self.count > MOST_KEPT * 3 // 4:
            self._reset()
        number = self._find(names)
        number[alone] = -1
        missing = np.flatnonzero((number < 0) & ~alone)
        raw = data.tobytes()
        later: list[tuple[int, np.ndarray]] = []
        if len(missing):
            new, first = np.unique(names[missing], return_index=True)
            room = min(len(new), MOST_KEPT - self.count)
            for i in range(0, len(new), 20_000):
                part = first[i : i + 20_000]
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[missing[part]].tolist(), end[missing[part]].tolist(), strict=True)]
                ids, counts = self._encode_pieces(texts)
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
                self.ids = np.concatenate([self.ids, ids])
            if room == len(new):
                self._insert(new, np.arange(self.count, self.count + len(new)))
                self.count += len(new)
                number[missing] = self._find(names[missing])
            else:  # more new pieces in one chunk than the table may keep: use them once
                number[missing] = self.count + np.searchsorted(new, names[missing])
                self.count = MOST_KEPT
        length = np.zeros(len(start), np.int64)
        known = number >= 0
        length[known] = self.at[number[known] + 1] - self.at[number[known]]
        for i in np.flatnonzero(alone):
            ids = np.array(self.tokenizer.encode(raw[start[i] : end[i]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
            length[i] = len(ids)
            later.append((int(i), ids))
        row_pieces = np.searchsorted(start, offsets)
        total = np.concatenate([[0], np.cumsum(length)])
        row_end = total[row_pieces[1:]] + np.arange(1, rows + 1)
        out = np.empty(int(total[-1]) + rows, np.uint32)
        owner = np.repeat(np.arange(rows), np.diff(row_pieces))
        put = total[:-1] + owner
        kn = np.flatnonzero(known)
        n = length[kn]
        before = np.concatenate([[0], np.cumsum(n)])[:-1]
        run = np.arange(int(n.sum()))
        out[run + np.repeat(put[kn] - before, n)] = self.ids[run + np.repeat(self.at[number[kn]] - before, n)]
        for i, ids in later:
            out[put[i] : put[i] + len(ids)] = ids
        out[row_end - 1] = self.end_id
        return out, np.concatenate([[0], row_end])


_loaded: dict[tuple[str, int], PieceTokenizer] = {}


def tokenizer(path: str, end_id: int) -> PieceTokenizer:
    """One for each worker process."""
    if (path, end_id) not in _loaded:
        _loaded[path, end_id] = PieceTokenizer(path, end_id)
    return _loaded[path, end_id]


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
