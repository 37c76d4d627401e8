"""Alignment of two tokenizations of the same bytes by merge-path partitioning.

The ends of the tokens of A and B, two ascending lists, are merged as on a grid: a step to the right takes an end of
A, a step down one of B. The path is cut where it crosses equally spaced diagonals, and a binary search on each
diagonal finds the crossing without walking there, so the pieces between crossings are independent and take the same
number of steps, however long a text or uneven its tokens. All pieces of a slice of texts walk in step. A step that
covers bytes says that the two tokens it stands on overlap; a step at which both end closes a group. Groups that
pieces cut are stitched by the positions of these closings, which all pieces share.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import boundaries, piece_ids, shared

PIECE_BPE = "piece_bpe_32k.model"
STEPS = 64
SHIFT = 32
SPACE = "▁"
COMMON = 1_000_000  # pairs that are broadcast, 17 bytes each


# ---- the merge path ----


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` lie on the path before each diagonal; of equal ends that of ``a`` comes first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        other = np.clip(diagonals - 1 - middle, 0, max(len(b) - 1, 0))
        before = a[np.minimum(middle, max(len(a) - 1, 0))] <= b[other]
        open_ = low < high
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions of overlapping tokens, given ascending ends; the first tokens start at 0 and the last
    ones end together. Pairs come in order."""
    total = len(a) + len(b)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    diagonals = np.arange(0, total, steps)
    i = crossings(a, b, diagonals)
    j = diagonals - i
    left = np.full((len(diagonals), steps), -1, np.int64)
    right = np.zeros((len(diagonals), steps), np.int64)
    ends_a, ends_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    done = np.maximum(np.where(i > 0, ends_a[i - 1], 0), np.where(j > 0, ends_b[j - 1], 0))
    for step in range(steps):
        next_a, next_b = ends_a[i], ends_b[j]
        upto = np.minimum(next_a, next_b)
        covers = (upto > done) & (i < len(a)) & (j < len(b))
        left[covers, step], right[covers, step] = i[covers], j[covers]
        takes_a = next_a <= next_b
        more = i + j < total
        i, j = i + (takes_a & more), j + (~takes_a & more)
        done = np.maximum(done, np.where(more, upto, done))
    met = left.ravel() >= 0
    return left.ravel()[met], right.ravel()[met]


# ---- the two tokenizers ----


class Aligner:
    def __init__(self, path_a: str, path_b: str, kinds: bytes):
        self.a = piece_ids.piece_ids(path_a, kinds, plain=True)
        byte_of = shared.byte_of_symbol()
        vocab = shared.read_byte_bpe(path_a)[1]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(symbol in byte_of for symbol in token):
                self.a_bytes[i] = bytes(byte_of[symbol] for symbol in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        # Ids of A, then of B, each within a group and as the last of its side.
        sides = ((self.a_bytes, b",|"), (self.b_bytes, b",;"))
        self.written = [b"%d%c" % (i, sign) for held, signs in sides for i in range(len(held)) for sign in signs]

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; none where the bytes of a side are not those of the text after a space."""
        spaced = [" " + t for t in texts]
        ours = self.a.ids(spaced)
        theirs = self.b.encode(texts, num_threads=1)
        out = []
        for text, whole, ids_a, ids_b in zip(texts, spaced, ours, theirs):
            want = whole.encode()
            alike = (
                text != ""
                and b"".join(map(self.a_bytes.__getitem__, ids_a.tolist())) == want
                and b"".join(map(self.b_bytes.__getitem__, ids_b)) == want
            )
            none = np.zeros(0, np.int64)
            out.append((ids_a.astype(np.int64), np.array(ids_b, np.int64)) if alike else (none, none))
        return out

    def align(self, texts: list[str], steps: int = STEPS) -> list[dict]:
        """Per text n_a, n_b, n_groups, n_links, the ids in groups as text, and its id pairs with their links.

        The ends of all texts of the call go into one path: texts are groups' borders like any other.
        """
        tokens = self.tokens(texts)
        n_a, n_b = (np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1))
        a, b = (np.concatenate([t[side] for t in tokens]) if tokens else np.zeros(0, np.int64) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        left, right = overlaps(ends_a, ends_b, steps)
        closes = ends_a[left] == ends_b[right]
        group_ends_a, group_ends_b = left[closes] + 1, right[closes] + 1
        lists = self._listed(a, b, group_ends_a, group_ends_b)

        cut_a, cut_b = np.cumsum(n_a), np.cumsum(n_b)
        link_cuts = np.searchsorted(left, cut_a)
        group_cuts = np.searchsorted(group_ends_a, cut_a, "right")
        # Pairs of a text: sorted as (text, pair) in one number, counted in runs.
        text_of = np.repeat(np.arange(len(tokens)), np.diff(link_cuts, prepend=0))
        keys = np.sort((text_of * len(self.a_bytes) + a[left]) * len(self.b_bytes) + b[right])
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begins = np.flatnonzero(new)
        times = np.diff(begins, append=len(keys))
        keys, pair_b = np.divmod(keys[begins], len(self.b_bytes))
        text_of, pair_a = np.divmod(keys, len(self.a_bytes))
        pairs = pair_a << SHIFT | pair_b
        pair_cuts = np.searchsorted(text_of, np.arange(len(tokens)), "right")
        out, last = [], (0, 0, 0, 0)
        for k in range(len(tokens)):
            here = (int(cut_a[k] + cut_b[k]), int(group_cuts[k]), int(link_cuts[k]), int(pair_cuts[k]))
            out.append(
                {
                    "n_a": int(n_a[k]),
                    "n_b": int(n_b[k]),
                    "n_groups": here[1] - last[1],
                    "n_links": here[2] - last[2],
                    "groups": b"".join(lists[last[0] : here[0]])[:-1],
                    "pairs": pairs[last[3] : here[3]],
                    "times": times[last[3] : here[3]],
                }
            )
            last = here
        return out

    def _listed(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[bytes]:
        """Decimal ids in the order group by group, A before B, each with the sign that follows it."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1], last_b[ends_b - 1] = 1, 1
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(ends_b - sizes_b, sizes_a)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(ends_a, sizes_b)] = 2 * (len(self.a_bytes) + b) + last_b
        return list(map(self.written.__getitem__, order.tolist()))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str, kinds: bytes) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b, kinds)
    return _ALIGNERS[path_a, path_b]


# ---- over a table ----


def aligned_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """One row per text: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times``.

    A group is written ``a1,a2|b1``, groups are joined by ``;``. ``pairs`` are the distinct linked pairs, the id of A
    times 2 ** 32 plus that of B, and ``times`` their links in the text. Texts that are null, empty, or whose tokens
    do not spell the space and the text on both sides have no tokens: zeros, '' and empty lists. A null id stays
    null, repeated rows give repeated rows, other columns are not carried; an empty table gives an empty one.
    """
    path_a = path_a or shared.tokenizer_file(shared.BYTE_BPE)
    path_b = path_b or shared.tokenizer_file(PIECE_BPE)
    kinds = docs.sparkSession.sparkContext.broadcast(boundaries.code_classes())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = ["n_a", "n_b", "n_groups", "n_links"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b, kinds.value)
        for batch in batches:
            for part, texts in shared.text_slices(batch):
                found = aligner.align(texts)
                digests = [hashlib.sha256(f["groups"]).hexdigest() if f["n_a"] else "" for f in found]
                lists = [
                    pa.ListArray.from_arrays(
                        np.cumsum([0, *[len(f[c]) for f in found]]).astype(np.int32),
                        pa.array(np.concatenate([f[c] for f in found]), kind),
                    )
                    for c, kind in (("pairs", pa.int64()), ("times", pa.int32()))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array([f[c] for f in found], pa.int64()) for c in counts],
                     pa.array(digests, pa.string()), *lists],
                    ["doc_id", *counts, "groups_sha256", "pairs", "times"],
                )

    kind = f"doc_id {id_type}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string"
    return rows.mapInArrow(align, f"{kind}, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count``: links of each pair of ids over all documents."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))


def with_best(counts: DataFrame) -> DataFrame:
    """Add ``best``: no other A id has more links with the pair's B id."""
    of_b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def common_from(known: DataFrame, limit: int) -> int:
    """Least power of two such that at most ``limit`` pairs have that count or more; 1 if that holds for all."""
    level = F.floor(F.log2("count")).cast("int")  # 63 levels at most
    at_least = 0
    for row in known.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        at_least += row["count"]
        if at_least > limit:
            return 2 << row["level"]
    return 1


def scored(docs: DataFrame, limit: int = COMMON, **options) -> DataFrame:
    """``aligned_documents`` with ``n_best`` (links whose pair has the highest count of its B id, ties included) and
    ``count_sum`` (over links) instead of the pairs.

    Texts are tokenised once: the aligned documents and the counts are tables in the shared folder. The most frequent
    pairs, ``limit`` at most, are broadcast, so most links find their count where they lie; rarer pairs, which are in
    few documents each, are joined by a shuffle.
    """
    folder = f"{shared.shared_folder(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    numbered = aligned_documents(docs, **options).withColumn("row", F.monotonically_increasing_id())
    aligned = stored(numbered, "documents")
    known = stored(with_best(stored(pair_counts(aligned), "counts")), "known")
    least = common_from(known, limit)
    common = F.broadcast(known.where(F.col("count") >= least))
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    values = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    ]
    sums = each.join(common, "pair").groupBy("row").agg(*values)
    if least > 1:
        rare = each.join(common, "pair", "left_anti").join(known.where(F.col("count") < least), "pair")
        both = sums.unionByName(rare.groupBy("row").agg(*values))
        sums = both.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
