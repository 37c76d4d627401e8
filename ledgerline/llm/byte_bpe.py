"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import shared

RANKS = "byte_bpe_multi_50k.tiktoken"
PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a long text before single spaces between ASCII letters.

    There the letter run before the space has ended and the space begins the next match of the pattern, whatever
    follows, so the parts' matches are the text's. A text without such a place is not cut.
    """
    begin = 0
    while len(text) - begin > size:
        found = _SAFE.search(text, begin + size)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


class Codec:
    def __init__(self, path: str):
        self.encoding = tiktoken.Encoding(
            "local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}
        )

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in safe_parts(text):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every whole text: matches of the pattern encoded separately, no special tokens.

    Null text is empty and has no ids; a null id stays null; repeated rows are repeated; an empty table gives an
    empty one; other columns are not carried.
    """
    path = path or shared.tokenizer_file(RANKS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part, texts in shared.text_slices(batch):
                ids = pa.array([own.encode(t) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id, bytes`` of lists of ids; the bytes need not be text. Null ids give null; no ids give no bytes."""
    path = path or shared.tokenizer_file(RANKS)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            found = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "bytes"]
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: both directions in one pass, keeping digests only.

    Same cases as ``encode``; the digest of no ids and of no bytes is that of the empty string.
    """
    path = path or shared.tokenizer_file(RANKS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def digest(text: str, own: Codec) -> tuple[int, str, str]:
        ids = own.encode(text)
        written = ",".join(map(str, ids)).encode("ascii")
        return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part, texts in shared.text_slices(batch):
                found = [digest(t, own) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([a for _, a, _ in found], pa.string()),
                        pa.array([b for _, _, b in found], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
