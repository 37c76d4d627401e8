"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text recognises every substring of that text. A text is parsed
greedily into phrases, each the longest match at its place; the fewer phrases a language needs, weighted by the
bits that point into its text, the closer it is. The parse is a walk through a transition table in which a
missing edge ends the phrase and starts the next one, so that thousands of windows are walked in step. A language
has columns for the letters of its own text only, and one for all others; where the table would still be large (scripts
of thousands of signs), its edges are kept as a sorted list instead, three per letter of training text at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import shared

TRAIN_DOCS = 64  # per language
TRAIN_CHARS = 500  # of each
MAX_LANGUAGES = 1_000  # more labels than these are no languages: an error, as their samples go to the driver
TABLE_CELLS = 1 << 26  # in all dense tables of a worker together, 4 bytes each
WINDOW = 512  # a phrase ends where a window of this many symbols ends
UNDETERMINED = "und"
GAP = 0  # class of anything that is no letter
FOREIGN = 1  # column of letters that a language's text does not hold


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Training text per language: the first TRAIN_CHARS of at most TRAIN_DOCS documents that are not held out.

    The documents with the smallest hashes are taken; the limit applies within each task before rows move. More than
    MAX_LANGUAGES labels are an error; none is left out.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out(F.col("id")), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    ids = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN_DOCS)
    short = ids.select("lang", "n", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    parts: dict[str, list[tuple[int, str]]] = {}
    most = MAX_LANGUAGES * TRAIN_DOCS
    for n, row in enumerate(short.limit(most + 1).collect()):
        if n == most:
            raise ValueError(f"{short.select('lang').distinct().count()} labels are too many for a language sample of bounded size")
        parts.setdefault(row["lang"], []).append((row["n"], row["text"]))
    return {lang: "\n".join(text for _, text in sorted(found)) for lang, found in sorted(parts.items())}


class SuffixAutomaton:
    """Smallest automaton of all substrings of a sequence of classes."""

    def __init__(self, symbols: list[int]):
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)

    def _add(self, edges: dict[int, int], link: int, length: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.edges) - 1

    def _extend(self, last: int, symbol: int) -> int:
        new, state = self._add({}, 0, self.length[last] + 1), last
        while state >= 0 and symbol not in self.edges[state]:
            self.edges[state][symbol] = new
            state = self.link[state]
        if state < 0:
            return new
        target = self.edges[state][symbol]
        if self.length[target] != self.length[state] + 1:
            copy = self._add(dict(self.edges[target]), self.link[target], self.length[state] + 1)
            self.link[target] = copy
            while state >= 0 and self.edges[state].get(symbol) == target:
                self.edges[state][symbol] = copy
                state = self.link[state]
            target = copy
        self.link[new] = target
        return new


class DenseParser:
    """Transitions of the greedy parse for states times columns: ``next state * 4 + phrases ended``."""

    def __init__(self, automaton: SuffixAutomaton, width: int):
        self.width = width
        table = np.empty((len(automaton.edges), width), np.int32)
        table[0] = _root(automaton, width)
        table[1:] = table[0] + 1  # end the phrase, then do as the root does
        for state, edges in enumerate(automaton.edges):
            for column, target in edges.items():
                table[state, column] = target * 4
        self.table = table.reshape(-1)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.table[state * self.width + column]


class SparseParser:
    """The same transitions from the sorted edges, for alphabets of many signs."""

    def __init__(self, automaton: SuffixAutomaton, width: int):
        self.width = width
        self.root = _root(automaton, width)
        edges = sorted(
            (state * width + column, target * 4) for state, some in enumerate(automaton.edges) for column, target in some.items()
        )
        self.keys = np.array([key for key, _ in edges] + [len(automaton.edges) * width], np.int64)
        self.next = np.array([target for _, target in edges] + [0], np.int32)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        key = state * self.width + column
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.next[at], self.root[column] + (state != 0))


def _root(automaton: SuffixAutomaton, width: int) -> np.ndarray:
    """Steps out of the root: a letter the text does not hold is a phrase of its own."""
    root = np.ones(width, np.int32)
    for column, target in automaton.edges[0].items():
        root[column] = target * 4
    return root


class CrossParser:
    """Cross-parsing models of several languages over one alphabet of letter classes."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for text in samples.values() for c in text.lower() if c.isalpha()})
        self.other = 1 + len(letters)  # letters that no training text holds
        self.classes = np.full(0x110000, GAP, np.uint32)
        self.classes[[c for c in range(0x110000) if chr(c).isalpha()]] = self.other
        for i, letter in enumerate(letters):
            self.classes[ord(letter)] = 1 + i
        self.parsers, self.columns, self.bits = [], [], []
        for lang in self.langs:
            symbols, _ = self.symbols([samples[lang]])
            own = np.setdiff1d(symbols, [GAP])
            columns = np.full(self.other + 1, FOREIGN, np.uint32)
            columns[own] = 2 + np.arange(len(own))
            columns[GAP] = GAP
            automaton, width = SuffixAutomaton(columns[symbols].tolist()), 2 + len(own)
            dense = len(automaton.edges) * width <= TABLE_CELLS // len(self.langs)
            self.parsers.append((DenseParser if dense else SparseParser)(automaton, width))
            self.columns.append(columns)
            self.bits.append(math.log2(len(symbols) + 1))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of lower-cased texts with runs of other characters as one gap, and each text's share."""
        lowered = [text.lower() for text in texts]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        kinds = self.classes[codes]
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
        keep = np.ones(len(kinds), bool)
        keep[1:] = (kinds[1:] != GAP) | (kinds[:-1] != GAP) | (owner[1:] != owner[:-1])
        return kinds[keep], np.bincount(owner[keep], minlength=len(texts))

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = np.repeat(np.cumsum(sizes) - sizes, windows) + nth * WINDOW
        size = np.minimum(WINDOW, np.repeat(sizes, windows) - nth * WINDOW)
        order = np.argsort(-size, kind="stable")  # long windows first: the lanes still running are a prefix
        first, size, owner = first[order], size[order], owner[order]
        running = np.searchsorted(-size, -np.arange(1, WINDOW + 1), side="right")
        result = np.zeros((len(sizes), len(self.langs)), np.int64)
        for k, parser in enumerate(self.parsers):
            columns = self.columns[k][symbols]
            state, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for step in range(int(size[0]) if len(size) else 0):
                n = running[step]
                found = parser.step(state[:n], columns[first[:n] + step])
                state[:n] = found >> 2
                total[:n] += found & 3
            total += state != 0
            result[:, k] = np.bincount(owner, total, len(sizes)).astype(np.int64)
        return result

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and bits per symbol of the best language (0 where there is none)."""
        symbols, sizes = self.symbols(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(owner, symbols != GAP, len(texts))
        bits = self.phrases(symbols, sizes) * np.array(self.bits)
        best = bits.argmin(axis=1)
        lead = bits - bits.min(axis=1, keepdims=True)
        score = 1 / np.exp2(-np.minimum(lead, 200) / 8).sum(axis=1)
        none = letters == 0
        langs = [UNDETERMINED if empty else self.langs[k] for k, empty in zip(best.tolist(), none.tolist())]
        rate = bits.min(axis=1) / np.maximum(sizes, 1)
        return langs, np.where(none, 0.0, score), np.where(none, 0.0, rate)


_PARSERS: dict[int, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    key = hash(tuple(samples.items()))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def annotate(
    docs: DataFrame, samples: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """All rows and columns with ``lang_pred, score, bits_per_symbol`` of the whole text behind them.

    ``samples`` maps languages to training text; without it, it is drawn from the labelled documents that are not
    held out. Text that is null or has no letter is ``und`` with score 0; texts with letters are an error if
    there is no labelled text to learn from. Equal cost goes to the first language by name. Columns of the added names are replaced. Repeated
    rows are repeated and an empty table gives an empty one. Only text enters a prediction.
    """
    if samples is None:
        samples = training_sample(docs, id_col, text_col, lang_col)
    if not samples and not docs.where(F.col(text_col).rlike(r"\p{L}")).isEmpty():
        raise ValueError("no labelled text to learn a language from")
    model = docs.sparkSession.sparkContext.broadcast(samples)  # TRAIN_DOCS * TRAIN_CHARS per language
    added = ["lang_pred", "score", "bits_per_symbol"]
    rows = docs.drop(*added)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(model.value) if model.value else None
        for batch in batches:
            for part, texts in shared.text_slices(batch, text_col):
                if parser is None:
                    langs, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    langs, score, rate = parser.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rate)],
                    [*part.schema.names, *added],
                )

    schema = T.StructType(rows.schema.fields + [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_symbol", T.DoubleType()),
    ])
    return rows.mapInArrow(predict, schema)


def identify(
    docs: DataFrame, samples: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_symbol`` of every row, as ``annotate`` has them.

    A null id stays null and is not held out.
    """
    if samples is None:
        samples = training_sample(docs, id_col, text_col, lang_col)
    key = F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text_col).alias("text")
    )
    return annotate(rows, samples).drop("text")
