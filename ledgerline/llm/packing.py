"""Best-fit packing of token sequences with dominance reduction.

Packing depends on sizes alone, so the plan is made on the histogram of sizes (at most ``capacity`` rows,
whatever the data) and covers all items: ranges of ranks within a size go to places in ranges of bins. The
Martello-Toth reduction goes through the sizes from the largest and fixes an item together with one or two others
when no other choice of companions can be better; what is left is packed best fit, largest first. Items then
find their place by their rank within their size, which is counted by partitions of the stored items, so that a
size that many items share is never ranked in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import boundaries, piece_ids, shared


# ---- plan on the histogram ----


@dataclass
class Bins:
    """``n`` bins filled alike: per segment (size, items per bin, first rank, offset in the bin)."""

    n: int
    room: int
    segments: list[tuple[int, int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> Bins:
        """Take the first ``n`` bins out."""
        taken = Bins(n, self.room, list(self.segments))
        self.n -= n
        self.segments = [(size, qty, rank + n * qty, at) for size, qty, rank, at in self.segments]
        return taken


class Planner:
    def __init__(self, histogram: dict[int, int], capacity: int):
        if any(not 0 < size <= capacity for size in histogram):
            raise ValueError("item sizes must lie between 1 and the capacity")
        self.capacity = capacity
        self.left = {size: n for size, n in histogram.items() if n > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.closed: list[Bins] = []

    def _take(self, size: int, n: int) -> int:
        first = self.rank[size]
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
        return first

    def _fix(self, sizes: list[int]) -> None:
        """Close bins that hold exactly these items, as many as the items allow."""
        need = {size: sizes.count(size) for size in sizes}
        n = min(self.left[size] // k for size, k in need.items())
        bins, at = Bins(n, self.capacity - sum(sizes)), 0
        for size, k in need.items():
            bins.segments.append((size, k, self._take(size, k * n), at))
            at += size * k
        self.closed.append(bins)

    def _largest(self, room: int, used: list[int]) -> int:
        """Largest size within the room of which an item is left besides those used; 0: none."""
        return max((s for s, n in self.left.items() if s <= room and n > used.count(s)), default=0)

    def _companions(self, size: int) -> list[int] | None:
        """Companions that dominate every other choice for an item of this size; None: not decided."""
        room = self.capacity - size
        best = self._largest(room, [size])
        if not best:
            return []
        if best == room:
            return [best]
        smallest, fits = 0, 0
        for s in sorted(self.left):
            for _ in range(min(3, self.left[s] - (s == size))):
                if smallest + s <= room and fits < 3:
                    smallest, fits = smallest + s, fits + 1
        if fits == 1:
            return [best]
        if fits > 2:
            return None
        second = self._largest(room - best, [size, best])
        sizes = sorted(s for s, n in self.left.items() if s <= room and n > (s == size))
        for y in sizes:  # two others, x >= y: worse item by item, or both within the best one, or undecided
            if y <= second:
                continue
            x = max((x for x in sizes if x >= y and x + y <= room and (x > y or self.left[x] - (x == size) > 1)), default=0)
            if x and x + y > best:
                return None
        return [best, second] if second else [best]

    def reduce(self) -> None:
        """Fix all sets that dominate, until none is found."""
        changed = True
        while changed:
            changed = False
            for size in sorted(self.left, reverse=True):
                while size in self.left:
                    companions = self._companions(size)
                    if companions is None:
                        break
                    self._fix([size, *companions])
                    changed = True

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin that takes it; alike bins and items are handled together."""
        open_bins: dict[int, list[Bins]] = {}

        def put(bins: Bins, size: int, qty: int) -> None:
            bins.segments.append((size, qty, self._take(size, qty * bins.n), self.capacity - bins.room))
            bins.room -= size * qty
            open_bins.setdefault(bins.room, []).append(bins)

        for size in sorted(self.left, reverse=True):
            while size in self.left:
                room = min((r for r, bins in open_bins.items() if r >= size and bins), default=None)
                if room is None:
                    bins, room = Bins(-(-self.left[size] // (self.capacity // size)), self.capacity), self.capacity
                else:
                    bins = open_bins[room].pop()
                qty = min(room // size, self.left[size])
                n = min(bins.n, self.left[size] // qty)
                if n < bins.n:
                    taken = bins.split(n)
                    if bins.room < self.capacity:  # a new bin that stays empty is none
                        open_bins.setdefault(bins.room, []).append(bins)
                    bins = taken
                put(bins, size, qty)
        self.closed.extend(b for bins in open_bins.values() for b in bins)

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(size, first rank, rank after the last, items per bin, first bin, offset in the bin)."""
        self.reduce()
        self.best_fit()
        out, first = [], 0
        for bins in self.closed:
            for size, qty, rank, at in bins.segments:
                out.append((size, rank, rank + qty * bins.n, qty, first, at))
            first += bins.n
        return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    return Planner(histogram, capacity).rows()


# ---- items to places ----


def pack(items: DataFrame, capacity: int, size_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items of 1 to ``capacity`` tokens.

    ``items`` must be a stored or checkpointed table: it is read twice, and rows are ranked by their place in it,
    within the partition they lie in, so that equal rows or a busy size are spread as the table is. The plan joined to it depends on the capacity and
    the histogram of sizes, not on the number of items. An empty table gives an empty one.
    """
    spark = items.sparkSession
    histogram = {r[0]: r[1] for r in items.groupBy(size_col).count().collect()}  # one row per size
    places = spark.createDataFrame(
        plan(histogram, capacity), "_size int, _lo long, _hi long, _qty long, _bin long, _at long"
    )
    own = items.withColumns({"_block": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    keyed = own.withColumn("_len", F.col(size_col).cast("int"))
    counted = keyed.groupBy("_len", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_len").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("_len", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_len", "_block").orderBy("_row")).cast("long") - 1
    ranked = keyed.withColumn("_r", rank).join(offsets, ["_len", "_block"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    nth = F.col("_rank") - F.col("_lo")
    within = (F.col("_size") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(F.broadcast(places), within).select(
        *items.columns,
        (F.col("_bin") + F.expr("(_rank - _lo) div _qty")).alias("sequence_id"),
        (F.col("_at") + (nth % F.col("_qty")) * F.col("_len")).alias("offset"),
    )


# ---- documents to pieces ----


def document_pieces(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document (its ids, then ``end_id``).

    Only longer documents are cut; their first piece holds the remainder, the others are full. Columns:
    ``doc_id, piece, start, length, ids_crc32``. Null text is an empty document (one piece: the end id); a null id
    stays null; repeated rows give repeated pieces; other columns are not carried.
    """
    path = path or shared.tokenizer_file(shared.BYTE_BPE)
    kinds = docs.sparkSession.sparkContext.broadcast(boundaries.code_classes())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.uint32(end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids.piece_ids(path, kinds.value)
        for batch in batches:
            for part, texts in shared.text_slices(batch):
                owner, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(encoder.ids(texts)):
                    ids = np.append(ids, end).astype("<u4")
                    n = len(ids)
                    at, k = 0, 0
                    while at < n:
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        owner.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[at : at + size]))
                        at, k = at + size, k + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(owner, pa.int64())),
                        pa.array(piece, pa.int32()),
                        *(pa.array(values, pa.int64()) for values in (start, length, crc)),
                    ],
                    names,
                )

    return rows.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Tokenising is done once:
    the pieces, a few numbers each, are checkpointed before they are counted and placed.
    """
    pieces = shared.durable(document_pieces(docs, capacity, **options))
    return pack(pieces, capacity, "length")
