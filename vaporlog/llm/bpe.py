"""Byte-level BPE encoding and decoding of whole texts by the rank queue."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from vaporlog.llm.common import text_of, with_library
from vaporlog.llm.rank_queue import decode_ids, read_ranks
from vaporlog.llm.tokens import blocks_of, ids_of, rank_queue_encoder, texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"


def encode_texts(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array of long) of every text, without special tokens.

    Null and empty texts give no ids; every row gives one row; other columns are ignored.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_queue_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [ids_of(x).astype("int64") for x in encoder.encode_all(list(texts_of(part.column(1))))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"]
                )

    return _mapped(docs, id_column, text_column, run, "ids array<long>")


def decode_texts(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes (binary) that each row's ids stand for; null ids give no bytes."""
    path = path or public_tokenizers.path(RANKS)
    with_library(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_list(path)
        for batch in batches:
            data = [decode_ids(x.as_py() or [], tokens) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digest of the ids and of what they decode to, one row per document, in one pass over the texts.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256. Null counts as empty. Repeated rows
    give repeated rows; an empty table gives none.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = rank_queue_encoder(path), _token_list(path)
        for batch in batches:
            n, ids, data = [], [], []
            for block in blocks_of(texts_of(batch.column(1))):
                for packed in encoder.encode_all(block):
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded = hashlib.sha256()
                    numbers = ids_of(packed)
                    for at in range(0, len(numbers), 65536):
                        decoded.update(decode_ids(numbers[at:at + 65536].tolist(), tokens))
                    data.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _mapped(docs, id_column, text_column, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


_lists: dict[str, list[bytes]] = {}


def _token_list(path: str) -> list[bytes]:
    if path not in _lists:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _lists[path] = tokens
    return _lists[path]


def _mapped(docs: DataFrame, id_column: str, text_column: str, run, columns: str) -> DataFrame:
    with_library(docs.sparkSession)
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {columns}")
