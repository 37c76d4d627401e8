"""Token ids of whole texts for byte-level BPE, each distinct piece of a slice looked up once.

Pieces (pre-tokens) are found by the boundary transducer. A polynomial hash over code points, taken from one running
sum, names every piece of a slice; pieces of one hash are compared with the first of them, sign by sign, so a
collision cannot pass. What is left are the distinct pieces: known ones are read from a table, others are merged by
the tiktoken library from the tokenizer file's own merges.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

from ledgerline.llm import boundaries, shared

MAX_KNOWN = 300_000
LONGEST_KNOWN = 64
_BASE = 0x9E3779B97F4A7C15
_SIGN = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def piece_names(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each piece, wherever it lies."""
    size = 1 << max(12, int(len(codes)).bit_length())
    up, down = _powers(size)
    signs = (codes.astype(np.uint64) + np.uint64(1)) * _SIGN
    signs ^= signs >> np.uint64(29)
    running = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(signs * up[: len(codes)], out=running[1:])
    return (running[ends] - running[begins]) * down[begins] + (ends - begins).astype(np.uint64) * _SIGN


def distinct_pieces(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the distinct pieces, and for each piece the place of its own in that list."""
    _, first, which = np.unique(piece_names(codes, begins, ends), return_index=True, return_inverse=True)
    length = ends - begins
    alike = length == length[first][which]
    sizes = np.where(alike, length, 0)
    at = _spans(begins, sizes)
    same = codes[at] == codes[_spans(begins[first][which], sizes)]
    wrong = np.zeros(len(begins), bool)
    wrong[np.repeat(np.arange(len(begins)), sizes)[~same]] = True
    wrong |= ~alike
    odd = np.flatnonzero(wrong)  # met by chance once in 2 ** 64 pairs: these stand for themselves
    which = which.copy()
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), which


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of all spans one after the other."""
    after = np.cumsum(sizes)
    return np.repeat(begins - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)


class PieceIds:
    """``plain``: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, kinds: bytes, plain: bool = False):
        merges, vocab, added = shared.read_byte_bpe(path)
        byte_of = shared.byte_of_symbol()
        self.added = {} if plain else {text: np.array([token], np.uint32) for text, token in added.items()}
        self.kinds = np.frombuffer(kinds, np.uint8)
        ranks = {bytes([byte]): byte for byte in range(256)}
        self.id_of_rank = np.zeros(256 + len(merges), np.uint32)
        for symbol, byte in byte_of.items():
            self.id_of_rank[byte] = vocab[symbol]
        for i, pair in enumerate(merges):
            token = "".join(pair)
            if ranks.setdefault(bytes(byte_of[s] for s in token), 256 + i) == 256 + i:
                self.id_of_rank[256 + i] = vocab[token]
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {boundaries.TEXT_END: 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.size = [0], [0]
        self.used = 0

    def _learn(self, pieces: list[str]) -> list[int]:
        """Places of new pieces in the table."""
        encoded = list(map(self.merge.encode_ordinary, pieces))
        sizes = list(map(len, encoded))
        total = sum(sizes)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        ranks = np.fromiter((r for ids in encoded for r in ids), np.int64, total)
        self.flat[self.used : self.used + total] = self.id_of_rank[ranks]
        first = len(self.size)
        at = self.used + np.concatenate([[0], np.cumsum(sizes)])
        self.begin += at[:-1].tolist()
        self.size += sizes
        self.used += total
        places = range(first, first + len(pieces))
        self.known.update((p, i) for p, i in zip(pieces, places) if len(p) <= LONGEST_KNOWN)
        return list(places)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, its ids as unsigned 32-bit integers."""
        if len(self.size) > MAX_KNOWN or self.used > 8 * MAX_KNOWN:
            self._forget()
        segments, segment_bounds, found = boundaries.with_added(texts, list(self.added))
        stream, codes, begins, bounds = boundaries.piece_begins(segments, self.kinds)
        ends = np.append(begins[1:], len(codes))
        first, which = distinct_pieces(codes, begins, ends)
        pieces = [stream[i:j] for i, j in zip(begins[first].tolist(), ends[first].tolist())]
        places = list(map(self.known.get, pieces))
        new = [i for i, place in enumerate(places) if place is None]
        for i, place in zip(new, self._learn([pieces[i] for i in new])):
            places[i] = place
        place = np.array(places, np.int64)
        begin = np.array([self.begin[p] for p in places], np.int64)[which] if len(place) else place
        size = np.array([self.size[p] for p in places], np.int64)[which] if len(place) else place
        flat = self.flat[_spans(begin, size)]
        cuts = np.concatenate([[0], np.cumsum(size)])[bounds]
        out = []
        for text, added in enumerate(found):
            k, last = segment_bounds[text], segment_bounds[text + 1]
            if not added:
                out.append(flat[cuts[k] : cuts[last]])
                continue
            parts = []
            for i, segment in enumerate(range(k, last)):
                parts.append(flat[cuts[segment] : cuts[segment + 1]])
                if i < len(added):
                    parts.append(self.added[added[i]])
            out.append(np.concatenate(parts))
        return out


_HELD: dict[tuple[str, bool], PieceIds] = {}


def piece_ids(path: str, kinds: bytes, plain: bool = False) -> PieceIds:
    """The worker's own table for a tokenizer file."""
    if (path, plain) not in _HELD:
        _HELD[path, plain] = PieceIds(path, kinds, plain)
    return _HELD[path, plain]
