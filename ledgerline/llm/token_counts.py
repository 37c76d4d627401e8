"""Token counts by compiled finite-state transducers.

Two deterministic transducers do the work. The first cuts the text into pieces (``boundaries``). The second reads
the bytes of a piece; each transition carries the change of the token count, so that the count of a piece is the
sum along its path. Its state is what the rest of the piece can depend on: for every earlier position from which a
token may still be under way, the place in the token trie, the last token of the encoding up to there, and the
count relative to now. Byte pair encoding has one last token for each prefix: the suffix token that stays apart
from the last token before it. States are compiled when first met and forgotten when the table is full, which
costs time but changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import boundaries, shared

MAX_STATES = 120_000
MAX_KNOWN = 250_000
LONGEST_KNOWN = 64
SHIFT = 128


class PieceTransducer:
    """Lazily compiled transducer from the bytes of one piece to its number of tokens."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        byte_of = shared.byte_of_symbol()
        self.pairs, self.halves, self.made = {}, {}, {}
        for rank, (left, right) in enumerate(merges):
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a, b] = rank
            self.halves[ab], self.made[ab] = (a, b), rank
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for symbols, token in vocab.items():
            if token not in self.made and len(symbols) > 1:
                continue  # never produced by merges
            node = 0
            for symbol in symbols:
                key = node << 8 | byte_of[symbol]
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                node = self.trie[key]
            self.token_at[node] = token
        self.apart: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        begin = ((0, None, 0),)
        self.states, self.ids, self.steps = [begin], {begin: 0}, {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens together gives just these two.

        Both are taken back along the border in the reverse order of their merges; a merge across the border
        that comes before the merge just taken back would have happened first.
        """
        known = self.apart.get((left, right))
        if known is not None:
            return known
        a, b, limit, result = left, right, None, True
        while True:
            rank = self.pairs.get((a, b))
            if rank is not None and (limit is None or rank < limit):
                result = False
                break
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                limit, a = made_a, self.halves[a][1]
            else:  # of two equal merges the left one comes first, so the border may still merge at this rank
                limit, b = made_b + 1, self.halves[b][0]
        if len(self.apart) >= 4 * MAX_STATES:
            self.apart.clear()
        self.apart[left, right] = result
        return result

    def _compile(self, state: int, byte: int) -> int:
        alive, token, change = [], None, 0
        for node, last, relative in self.states[state]:
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            alive.append((node, last, relative))
            found = self.token_at.get(node)
            if token is None and found is not None and (last is None or self.stays_apart(last, found)):
                token, change = found, relative + 1
        after = (*((node, last, relative - change) for node, last, relative in alive), (0, token, 0))
        target = self.ids.get(after)
        if target is None:
            target = self.ids[after] = len(self.states)
            self.states.append(after)
        step = self.steps[state << 8 | byte] = target << 8 | (change + SHIFT)
        return step

    def count(self, piece: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self._forget()
        state, total, get = 0, 0, self.steps.get
        for byte in piece:
            step = get(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            state = step >> 8
            total += (step & 255) - SHIFT
        return total


class TokenCounter:
    """Counts the tokens of whole texts for one byte-level tokenizer file."""

    def __init__(self, path: str, kinds: bytes):
        merges, vocab, added = shared.read_byte_bpe(path)
        self.added = list(added)
        self.kinds = np.frombuffer(kinds, np.uint8)
        self.transducer = PieceTransducer(merges, vocab)
        self.known: dict[str, int] = {boundaries.TEXT_END: 0}

    def counts(self, texts: list[str]) -> np.ndarray:
        segments, segment_bounds, found = boundaries.with_added(texts, self.added)
        pieces, bounds = boundaries.split_pieces(segments, self.kinds)
        values = list(map(self.known.get, pieces))
        if None in values:
            for i in [i for i, value in enumerate(values) if value is None]:
                piece = pieces[i]
                value = self.known.get(piece)
                if value is None:
                    value = self.transducer.count(piece.encode("utf-8"))
                    if len(piece) <= LONGEST_KNOWN:
                        self.known[piece] = value
                values[i] = value
            if len(self.known) > MAX_KNOWN:
                self.known = {boundaries.TEXT_END: 0}
        running = np.concatenate([[0], np.cumsum(np.array(values, np.int64))])
        at = running[bounds[np.array(segment_bounds)]]
        return np.diff(at) + np.array([len(f) for f in found], np.int64)


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(path: str, kinds: bytes) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, kinds)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Tokens of every whole text as the tokenizer file's library counts them, without added special tokens.

    One row per input row, in no order: ``doc_id, n_bytes, n_tokens, over_limit``. Null text counts as empty (0
    bytes, 0 tokens); a null id stays null; repeated rows give repeated rows; an empty table gives an empty one;
    other columns are not carried. A string of a special token in a text is that token, as the library does by
    default. Texts of any length are read in slices, and a worker holds one slice of text at a time.
    """
    path = path or shared.tokenizer_file(shared.BYTE_BPE)
    kinds = docs.sparkSession.sparkContext.broadcast(boundaries.code_classes())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, kinds.value)
        for batch in batches:
            for part, texts in shared.text_slices(batch):
                tokens = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(tokens > limit),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
