"""Secret scans: patterns, and a character network over every candidate and its context.

Candidates are all runs of six and more key-like characters, or what patterns leave of them. A small convolutional
network, written in numpy, reads windows over the whole of each, and over its parts between marks, with the
characters around them. It is trained on labelled findings (candidates that a pattern confirms, against those that
none does) from a bounded sample of documents, its scores are calibrated on findings held back, and the threshold is
the highest that still finds the wanted share of them. What a pattern finds always stays; the network adds spans
that no pattern touches.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import shared

KINDS = ["assign", "access", "hex", "network"]
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the greedy runs of 24 and more
LEAST = 6  # characters of a candidate, as of an assigned value
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PART = re.compile(r"[^/.=]{6,}")

SAMPLE_DOCS = 20_000  # documents whose findings may be used for training, about
SAMPLE_FINDINGS = 20_000
MIN_POSITIVES = 8
RECALL = 0.99
DRAWS = 6  # variations of the findings held back that scores are calibrated on
SHORTEST = 16  # characters of a key that findings are cut to
BEFORE, INSIDE, AFTER = 20, 32, 12
LENGTH = BEFORE + INSIDE + AFTER
STEP = 8  # between windows over a long run: any 24 characters are inside of one
SCORED_AT_ONCE = 1024
SPAN, FILTERS, EPOCHS, BATCH, RATE = 5, 16, 12, 128, 0.01
REDACTED = "[REDACTED]"
ALPHABETS = ["0123456789ABCDEF", *2 * [string.digits + string.ascii_lowercase], string.digits + string.ascii_uppercase]
ALPHABETS += [string.digits + string.ascii_letters, string.digits + string.ascii_letters + "+/"]

Finding = tuple[int, int, int, float]  # start, kind (place in KINDS), end, score


def base_findings(text: str) -> list[Finding]:
    """What the patterns find, by start and kind."""
    found: list[Finding] = []
    lowered = text.lower()
    if any(word in lowered for word in _WORDS):
        found += [(m.start(), 0, m.end(), 1.0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), 1.0) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def overlaps(spans: list[tuple[int, int]], found: list[Finding]) -> list[bool]:
    """For spans in order that do not overlap each other: whether a finding touches them."""
    covered = sorted((start, end) for start, _, end, _ in found)
    out, at, reach = [], 0, -1
    for start, end in spans:
        while at < len(covered) and covered[at][0] < end:
            reach = max(reach, covered[at][1])
            at += 1
        out.append(reach > start)
    return out


def uncovered(spans: list[tuple[int, int]], found: list[Finding]) -> list[tuple[int, int]]:
    """What findings leave of spans in order, in stretches of LEAST and more characters."""
    covered = sorted((start, end) for start, _, end, _ in found)
    out, at = [], 0
    for start, end in spans:
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        k = at
        while k < len(covered) and covered[k][0] < end:
            if covered[k][0] - start >= LEAST:
                out.append((start, covered[k][0]))
            start = max(start, covered[k][1])
            k += 1
        if end - start >= LEAST:
            out.append((start, end))
    return out


def views(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of at most INSIDE characters to look at: over all of a stretch, and over its parts between marks."""
    out = {}
    for a, b in [(start, end), *(m.span() for m in _PART.finditer(text, start, end))]:
        last = max(a, b - INSIDE)
        for at in [*range(a, last, STEP), last]:
            out[at, min(b, at + INSIDE)] = None
    return sorted(out)


def window(text: str, start: int, end: int) -> str:
    """Fixed window: context, the head of the candidate, context; padded with NUL."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    return before + inside + text[end : end + AFTER].ljust(AFTER, "\0")


# ---- network ----

_MARKS = "\0 \n\"':=+/_.-"
N_CLASSES = 26 + 3 + len(_MARKS)


def _classes() -> np.ndarray:
    table = np.full(128, 28, np.int64)  # anything else
    for i in range(26):
        table[ord("a") + i] = i
        table[ord("A") + i] = 26
    for digit in "0123456789":
        table[ord(digit)] = 27
    for i, mark in enumerate(_MARKS):
        table[ord(mark)] = 29 + i
    return table


def encode(windows: list[str]) -> np.ndarray:
    """Classes (windows x LENGTH), those of the candidate apart from those of the context."""
    codes = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), np.uint32).reshape(len(windows), LENGTH)
    kinds = _classes()[np.minimum(codes, 127)]
    kinds[:, BEFORE : BEFORE + INSIDE] += N_CLASSES
    return kinds


@dataclass
class Network:
    """One convolution over character classes, maximum and mean over places, one output."""

    filters: np.ndarray  # SPAN x classes x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    shift: float
    slope: float = 1.0  # calibration of the output
    offset: float = 0.0
    threshold: float = 0.5
    false_rate: float = 0.0  # share of clean windows held back that reach it

    def _hidden(self, kinds: np.ndarray) -> np.ndarray:
        places = LENGTH - SPAN + 1
        total = self.bias + sum(self.filters[k][kinds[:, k : k + places]] for k in range(SPAN))
        return np.maximum(total, 0.0)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of two neighbouring filter places for every pair of classes (twice), and the last place."""
        if not hasattr(self, "_tables"):
            f = self.filters.astype(np.float32)
            pair = lambda k: (f[k][:, None] + f[k + 1][None]).reshape(-1, FILTERS)
            self._tables = pair(0), pair(2), f[4] + self.bias.astype(np.float32)
        return self._tables

    def fast_logits(self, kinds: np.ndarray) -> np.ndarray:
        """``logits`` in single precision, with three lookups a place instead of five."""
        first, second, last = self.tables()
        places = LENGTH - SPAN + 1
        by_place = np.ascontiguousarray(kinds.T)  # places first, so that sums and maxima run over long rows
        pairs = by_place[:-1] * (2 * N_CLASSES) + by_place[1:]
        hidden = first.take(pairs[:places], axis=0)
        hidden += second.take(pairs[2 : 2 + places], axis=0)
        hidden += last.take(by_place[4 : 4 + places], axis=0)
        np.maximum(hidden, 0, out=hidden)
        top, mean = hidden.max(axis=0), hidden.mean(axis=0)
        return np.concatenate([top, mean], axis=1).astype(float) @ self.out + self.shift

    def logits(self, kinds: np.ndarray) -> np.ndarray:
        hidden = self._hidden(kinds)
        return np.concatenate([hidden.max(axis=1), hidden.mean(axis=1)], axis=1) @ self.out + self.shift

    def scores(self, kinds: np.ndarray) -> np.ndarray:
        parts = [self.fast_logits(kinds[i : i + 128]) for i in range(0, len(kinds), 128)]
        logits = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -60, 60)))


def _fit(kinds: np.ndarray, labels: np.ndarray) -> Network:
    draw = np.random.default_rng(7)
    net = Network(
        draw.normal(0, 0.1, (SPAN, 2 * N_CLASSES, FILTERS)), np.zeros(FILTERS), draw.normal(0, 0.1, 2 * FILTERS), 0.0
    )
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    params = [net.filters, net.bias, net.out, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    places, step = LENGTH - SPAN + 1, 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            x, n = kinds[rows], len(rows)
            hidden = net._hidden(x)
            top = hidden.argmax(axis=1)
            pooled = np.concatenate([hidden.max(axis=1), hidden.mean(axis=1)], axis=1)
            chance = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -60, 60)))
            error = (chance - labels[rows]) * weight[rows] / n
            back = error[:, None] * net.out
            grown = np.repeat(back[:, None, FILTERS:] / places, places, axis=1)
            np.add.at(grown, (np.arange(n)[:, None], top, np.arange(FILTERS)), back[:, :FILTERS])
            grown *= hidden > 0
            for_filters = np.zeros_like(net.filters)
            flat = grown.reshape(-1, FILTERS)
            for k in range(SPAN):
                np.add.at(for_filters[k], x[:, k : k + places].reshape(-1), flat)
            grads = [for_filters, grown.sum(axis=(0, 1)), pooled.T @ error, np.array([error.sum()])]
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            net.shift = float(params[3][0])
    return net


def number_like(rng: random.Random) -> str:
    """Numbers that people write and that are no keys: of telephones, cards, hosts, versions, dates, amounts."""
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    shapes = [
        lambda: f"{digits(3)}-{digits(4)}",
        lambda: f"{rng.choice(['', '+1-', '+49-'])}{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"+{digits(rng.randrange(9, 13))}",
        lambda: rng.choice(["-", "", "."]).join(digits(4) for _ in range(4)),
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: "-".join([digits(4), digits(2), digits(2)]),
        lambda: ".".join(digits(rng.randrange(1, 4)) for _ in range(rng.randrange(2, 5))),
        lambda: digits(rng.randrange(6, 20)),
        lambda: f"{digits(rng.randrange(3, 9))}.{digits(2)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    ]
    return rng.choice(shapes)()


def varied(windows: list[str], labels: list[int], seed: int) -> list[str]:
    """The same findings without what only tells that a pattern confirmed them: keywords around them, and length.

    Most positives stand in the context of a negative, many are cut short, half are drawn anew from other alphabets
    of keys; some negatives are joined by marks, and some are numbers that people write.
    """
    rng = random.Random(seed)
    clean = [w for w, y in zip(windows, labels) if not y]
    inside = lambda w: w[BEFORE : BEFORE + INSIDE].rstrip("\0")
    out = []
    for w, y in zip(windows, labels):
        before, own, after = w[:BEFORE], inside(w), w[BEFORE + INSIDE :]
        if y:
            if rng.random() < 0.75:
                other = rng.choice(clean)
                before, after = other[:BEFORE], other[BEFORE + INSIDE :]
            if len(own) > SHORTEST and rng.random() < 0.5:
                own = own[: rng.randrange(SHORTEST, len(own))]
            if rng.random() < 0.5:
                letters = rng.choice(ALPHABETS)
                own = "".join(rng.choice(letters) for _ in own)
        elif rng.random() < 0.2:
            own = number_like(rng)
        elif rng.random() < 0.25:
            while len(own) < INSIDE and rng.random() < 0.8:
                own += rng.choice("/.-_=") + inside(rng.choice(clean))
        out.append(before + own[:INSIDE].ljust(INSIDE, "\0") + after)
    return out


def train(windows: list[str], labels: list[int], recall: float = RECALL) -> Network | None:
    """Network with calibrated scores and the highest threshold that keeps ``recall`` of the findings held back.

    The share of negatives held back that reach it is in ``false_rate``. None (the patterns alone decide) where the
    sample has fewer than MIN_POSITIVES findings of either kind: nothing can be learned from so few.
    """
    y = np.array(labels, np.int64)
    if min(int(y.sum()), len(y) - int(y.sum())) < MIN_POSITIVES:
        return None
    aside = np.zeros(len(y), bool)
    for value in (0, 1):
        aside[np.flatnonzero(y == value)[::4]] = True  # a quarter of each kind for calibration
    part = lambda mask: ([windows[i] for i in np.flatnonzero(mask)], y[mask])
    fit, fit_y = part(~aside)
    net = _fit(encode(varied(fit, fit_y.tolist(), 1)), fit_y.astype(float))
    held, held_y = part(aside)
    # Findings as patterns mark them are found anyway: what counts is how they score without their marks.
    unmarked = [w for seed in range(2, 2 + DRAWS) for w in varied(held, held_y.tolist(), seed)]
    kinds, truth = encode(unmarked), np.tile(held_y, DRAWS).astype(float)
    logits = np.concatenate([net.logits(kinds[i : i + 4096]) for i in range(0, len(kinds), 4096)])
    # Platt's targets keep the calibration finite where the two kinds are separated
    target = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
    # steps under the bound of 1/4 on the curvature never overshoot, however well the kinds are separated
    design = np.stack([logits, np.ones_like(logits)], axis=1)
    bound = design.T @ design / 4 + 1e-3 * np.eye(2)
    slope, offset = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * logits + offset, -60, 60)))
        change = np.linalg.solve(bound, design.T @ (p - target))
        slope, offset = slope - change[0], offset - change[1]
    net.slope, net.offset = float(slope), float(offset)
    scores = net.scores(kinds)
    found = np.sort(scores[truth == 1])
    net.threshold = float(found[int(np.floor((1 - recall) * len(found)))])
    net.false_rate = float((scores[truth == 0] >= net.threshold).mean())
    return net


def confirmed(text: str) -> list[tuple[int, int]]:
    """Spans of the values that patterns find, without the keywords in front."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST]
    found += [(start, end) for start, kind, end, _ in base_findings(text) if kind != 0]
    return sorted(set(found))


def looks_random(run: str) -> bool:
    """Whether a part between marks changes often between digits, lower and upper case, as keys do.

    Where no pattern confirms such a run, nobody knows what it is: it is no example of clean text.
    """
    for part in re.split(r"[^A-Za-z0-9]+", run):
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in part]
        if sum(a != b for a, b in zip(kinds, kinds[1:])) >= 3:
            return True
    return False


def training_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Windows and labels of candidates in about SAMPLE_DOCS documents, picked by hash of id and text.

    At most half of SAMPLE_FINDINGS have either label, so that clean words do not crowd findings out.
    """
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    picked = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    rows = docs.where(picked & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    thin = int((1 << 32) * min(1.0, 2_000 / max(total * share, 1)))  # clean windows that tasks pass on, by hash

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in shared.text_slices(batch):
                windows, labels = [], []
                for text in texts:
                    known = [window(text, *v) for span in confirmed(text) for v in views(text, *span)]
                    clean = [
                        w
                        for span in uncovered(candidates(text), base_findings(text))
                        if not looks_random(text[span[0] : span[1]])
                        for v in views(text, *span)
                        if zlib.crc32((w := window(text, *v)).encode("utf-8", "replace")) < thin
                    ]
                    windows += known + clean
                    labels += [1] * len(known) + [0] * len(clean)
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(labels, pa.int32())], ["w", "y"])

    order = Window.partitionBy("y").orderBy(F.xxhash64("w"), "w")
    found = rows.mapInArrow(find, "w string, y int").distinct().withColumn("n", F.row_number().over(order))
    sample = found.where(F.col("n") <= SAMPLE_FINDINGS // 2).orderBy("y", "n").collect()
    return [r["w"] for r in sample], [r["y"] for r in sample]


# ---- scan ----


class Scanner:
    def __init__(self, net: Network | None):
        self.net = net

    def scan(self, texts: list[str]) -> list[list[Finding]]:
        found = [base_findings(text) for text in texts]
        if self.net is None:
            return found
        owner, spans = [], []
        for row, text in enumerate(texts):
            for stretch in uncovered(candidates(text), found[row]):
                seen = [stretch] if stretch[1] - stretch[0] <= 2 * LEAST else views(text, *stretch)
                owner += [row] * len(seen)
                spans += seen
        added: list[list[Finding]] = [[] for _ in texts]
        for at in range(0, len(spans), SCORED_AT_ONCE):
            some = slice(at, at + SCORED_AT_ONCE)
            windows = [window(texts[row], *span) for row, span in zip(owner[some], spans[some])]
            scores = self.net.scores(encode(windows))
            for k in np.flatnonzero(scores >= self.net.threshold).tolist():
                (start, end), score, own = spans[at + k], float(scores[k]), added[owner[at + k]]
                if own and start < own[-1][2]:  # windows come in order of their starts
                    own[-1] = (own[-1][0], 3, max(end, own[-1][2]), max(score, own[-1][3]))
                else:
                    own.append((start, 3, end, score))
        return [sorted(f + more) for f, more in zip(found, added)]


_FINDINGS = "array<struct<kind:string,start:int,end:int,score:double>>"


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    return train(*training_findings(docs, id_col, text_col))


def findings(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, findings`` (kind, start, end, score; by start, then kind) of every whole text.

    Places count code points, ends are exclusive. Null text is empty and holds none. A null id stays null,
    repeated rows are repeated, an empty table gives an empty one; other columns are not carried.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.value)
        for batch in batches:
            for part, texts in shared.text_slices(batch):
                found = [
                    [{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans]
                    for spans in scanner.scan(texts)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(item))], ["doc_id", "findings"])

    return rows.mapInArrow(run, f"doc_id {id_type}, findings {_FINDINGS}")


def span_text(found: Column) -> Column:
    """Findings as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def counted(found: DataFrame) -> DataFrame:
    """Counts per pattern, a digest of what the patterns find, and all spans."""
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"] != KINDS[3])
    return found.select(
        "doc_id",
        *[n(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("findings")).alias("spans"),
    )


def redacted(text: str, found: list[Finding]) -> str:
    """The text with every stretch of findings replaced; overlapping ones count as one."""
    out, at = [], 0
    for start, _, end, _ in found:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """All rows and columns, with secrets in the text replaced. Null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.value)
        for batch in batches:
            for part, texts in shared.text_slices(batch, text_col):
                clean = [redacted(text, found) for text, found in zip(texts, scanner.scan(texts))]
                null = part.column(at).is_null().to_pylist()
                values = pa.array([None if gone else text for gone, text in zip(null, clean)], pa.string())
                columns = [values if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
