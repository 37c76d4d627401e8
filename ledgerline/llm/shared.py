"""Helpers shared by the text operators: tables, Arrow slices, the shared folder, tokenizer files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BYTE_BPE = "byte_bpe_50k.json"
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (as in tests) uses a folder below its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch in runs of about SLICE_BYTES of text (one row at least); null text is empty."""
    texts = batch.column(column)
    sizes = [size or 0 for size in pc.binary_length(texts).to_pylist()]
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > SLICE_BYTES:
            yield batch.slice(begin, i - begin), _strings(texts.slice(begin, i - begin))
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin), _strings(texts.slice(begin))


def _strings(texts: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in texts.to_pylist()]


def read_byte_bpe(path: str) -> tuple[list[tuple[str, str]], dict[str, int], dict[str, int]]:
    """Merges in rank order, vocabulary, and added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return merges, spec["model"]["vocab"], added


def byte_of_symbol() -> dict[str, int]:
    """Byte written by each symbol of a byte-level vocabulary: printable bytes stand for themselves, the
    others follow in order from code point 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
