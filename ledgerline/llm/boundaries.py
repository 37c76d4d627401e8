"""Pre-token boundaries of byte-level BPE as a deterministic transducer over classes of code points.

The pattern of the byte-level vocabularies (contractions, letter, number and other runs with one leading space,
white space) is compiled into a transition table. A transition may announce that a piece starts at the symbol it
reads, or at the one before. A stream of many texts is cut into equal chunks wherever that falls; every chunk is
run from all states, which gives its state map, the maps are composed by a parallel prefix scan, and the scan
gives each chunk the state it is entered in.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Regex, normalizers

LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, TAIL, R, V, L, E, END = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE_1, BLANK_1, SPACE_2, BLANK_2, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = (
    range(12)
)
N_STATES, WIDTH = 12, 16
HERE, BEFORE = 1, 2
TEXT_END = "\ud800"  # a code point that no text holds
CHUNK = 256

_OPENS = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: SPACE_1, BLANK: BLANK_1, QUOTE: QUOTED}
_LETTERS = {LETTER, TAIL, R, V, L, E}
_ENDS_QUOTED = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state, and where pieces are known to start after reading a symbol."""
    opened = IN_LETTERS if kind in _LETTERS else _OPENS.get(kind, START)
    white = {SPACE: SPACE_2, BLANK: BLANK_2}.get(kind)
    if kind == END:
        return START, BEFORE if state in _ENDS_QUOTED else 0
    if state == IN_LETTERS and kind in _LETTERS:
        return IN_LETTERS, 0
    if state == IN_NUMBERS and kind == NUMBER:
        return IN_NUMBERS, 0
    if state in (IN_OTHERS, QUOTED) and kind in (OTHER, QUOTE):
        return IN_OTHERS, 0
    if state in (SPACE_1, SPACE_2, BLANK_1, BLANK_2):
        if white is not None:
            return white, 0
        split = BEFORE if state in (SPACE_2, BLANK_2) else 0  # the last of several blanks leaves their run
        if state in (SPACE_1, SPACE_2):  # a space joins what follows; a quote behind it opens no contraction
            return (IN_OTHERS if kind == QUOTE else opened), split
        return opened, split | HERE
    if state == QUOTED and kind in (TAIL, R, V, L):
        return {TAIL: START, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
    if state in _ENDS_QUOTED:
        if kind == _ENDS_QUOTED[state]:
            return START, 0
        after, out = _step(IN_LETTERS, kind)  # no contraction: the letter behind the quote began a run
        return after, out | BEFORE
    return opened, HERE


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    after, out = np.zeros(N_STATES * WIDTH, np.uint8), np.zeros(N_STATES * WIDTH, np.uint8)
    for state in range(N_STATES):
        for kind in range(12):
            after[state * WIDTH + kind], out[state * WIDTH + kind] = _step(state, kind)
    return after, out


@lru_cache(maxsize=1)
def code_classes() -> bytes:
    """Class of every code point as the tokenizers library's own patterns see it (1.1 MB whatever the data)."""
    probe = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = np.full(0x110000, BLANK, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"[^\s\p{L}\p{N}]", OTHER)):
        rest = normalizers.Replace(Regex(pattern), "").normalize_str(probe)
        taken = np.ones(0x110000, bool)
        taken[0xD800:0xE000] = False
        taken[np.frombuffer(rest.encode("utf-32-le"), np.uint32)] = False
        kinds[taken] = kind
    for text, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", TAIL), ("r", R), ("v", V), ("l", L), ("e", E)):
        for char in text:
            kinds[ord(char)] = kind
    kinds[ord(TEXT_END)] = END
    return kinds.tobytes()


def chunk_maps(grid: np.ndarray) -> np.ndarray:
    """State map of every chunk: ``maps[chunk, entry] = exit``; ``grid`` holds one chunk per column."""
    after, _ = _tables()
    states = np.repeat(np.arange(N_STATES, dtype=np.uint16)[:, None], grid.shape[1], axis=1)
    for k, kinds in enumerate(grid):
        states = after[(states << 4) | kinds].astype(np.uint16)
        if len(states) > 1 and k % 4 == 3 and (states == states[0]).all():
            states = states[:1]  # all entries have met; from here on one run stands for all
    return np.broadcast_to(states, (N_STATES, grid.shape[1])).T.astype(np.uint8)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Map of each chunk together with all before it, in log2(chunks) rounds of composition."""
    maps, shift = maps.copy(), 1
    while shift < len(maps):
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.int64), axis=1)
        shift *= 2
    return maps


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """For a stream of classes in which every text ends in END: whether a piece starts at each symbol."""
    after, out = _tables()
    n_chunks = max(1, -(-len(kinds) // CHUNK))
    padded = np.full(n_chunks * CHUNK, END, np.uint8)
    padded[: len(kinds)] = kinds
    grid = np.ascontiguousarray(padded.reshape(n_chunks, CHUNK).T)
    scanned = prefix_scan(chunk_maps(grid))
    states = np.concatenate([[START], scanned[:-1, START]]).astype(np.uint16)
    said = np.empty((CHUNK, n_chunks), np.uint8)
    for k, row in enumerate(grid):
        at = (states << 4) | row
        said[k] = out[at]
        states = after[at].astype(np.uint16)
    said = said.T.reshape(-1)[: len(kinds)]
    starts = (said & HERE).astype(bool)
    starts[:-1] |= (said[1:] & BEFORE).astype(bool)
    return starts


def piece_begins(texts: list[str], kinds_of: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one stream, its code points, where its pieces begin (each text's last one is TEXT_END), and which
    of them is the first of each text (with the number of all at the end)."""
    stream = TEXT_END.join([*texts, ""])
    codes = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kinds_of[codes]
    ends = kinds == END
    begins = np.flatnonzero(piece_starts(kinds) | ends)
    return stream, codes, begins, np.concatenate([[0], np.flatnonzero(ends[begins]) + 1])


def split_pieces(texts: list[str], kinds_of: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Pieces of all texts in order, and which of them is the first of each text, as ``piece_begins`` has them."""
    stream, _, begins, bounds = piece_begins(texts, kinds_of)
    cuts = [*begins.tolist(), len(stream)]
    return [stream[i:j] for i, j in zip(cuts, cuts[1:])], bounds


def with_added(texts: list[str], added: list[str]) -> tuple[list[str], list[int], list[list[str]]]:
    """Cut texts at the strings of added tokens, which the library takes out before anything else.

    Returns all segments, the number of segments before each text's end (with a leading zero), and per text the
    added strings between its segments.
    """
    import re

    segments, bounds, found = [], [0], []
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    for text in texts:
        parts = cut.split(text) if cut and any(a in text for a in added) else [text]
        segments.extend(parts[::2])
        bounds.append(len(segments))
        found.append(parts[1::2])
    return segments, bounds, found
