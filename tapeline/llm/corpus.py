"""Encoding of all documents, and what packing needs of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from tapeline.llm import bpe

#: Where the vocabulary files of the public tokenizers are on every executor.
TOKENIZERS = "/opt/tokenizers"


def rank_file(name: str, folder: str = TOKENIZERS) -> str:
    return f"{folder.rstrip('/')}/{name}.tiktoken"


#: Characters encoded before a batch goes out: bounds a task's memory, whatever the texts' lengths.
SLAB = 4_000_000


def token_ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``documents``, in whole texts, without special tokens.

    An empty or null text has an empty list; strings that look like special tokens are ordinary text. Repeated rows
    come out as often as they are there.
    """
    path = rank_file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            for ids, texts in _slabs(batch):
                offsets, values = encoder.encode_batch(texts)
                yield pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """A batch's ids and texts in parts of about ``SLAB`` bytes of text."""
    texts = batch.column("text")
    start, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= SLAB:
            yield batch.column("doc_id").slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.column("doc_id").slice(start), texts.slice(start).to_pylist()


def token_counts(documents: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and ``sizes``: the number of tokens of every row by each of ``tokenizers``, in that order."""
    paths = [rank_file(t, folder) for t in tokenizers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [bpe.encoder(p) for p in paths]
        for batch in batches:
            for ids, texts in _slabs(batch):
                sizes = []
                for text in texts:
                    parts = bpe.pieces(text) if text else []
                    sizes.append([e.count(parts) for e in encoders])
                yield pa.record_batch([ids, pa.array(sizes, pa.list_(pa.int64()))], ["doc_id", "sizes"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, sizes array<long>")
