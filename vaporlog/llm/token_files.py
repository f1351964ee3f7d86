"""Token ids in binary files, coded by a range asymmetric numeral system with one shared frequency table.

Documents are in ascending order of their ids over all files. A file is a row of segments of whole documents and a
footer with one checkpoint per segment, so segments are decoded in parallel by tasks that read only their own bytes.
A segment holds its documents' ids and lengths, then independent blocks of interleaved lanes (see `rans`), each
with a checksum of the token ids that must come out; the segment has a checksum of its own bytes.

    file     b"RANSTOK1", crc32 of the table, segments, checkpoints, number of checkpoints, their crc32, b"RANSTOK1"
    segment  header (numbers and crc32 of the rest), index (Arrow stream), block table, states, words

Files are written by tasks under names of their attempts. The manifest, which Spark commits, names the files that count;
what a lost or repeated attempt left behind is never read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaporlog.llm import rans
from vaporlog.llm.common import new_path, staged, text_of, with_library
from vaporlog.llm.tokens import library_encoder, pack_ids, texts_of

TOKENIZER = "byte_bpe_50k.json"
#: The id that ends every document.
END = 2
MAGIC = b"RANSTOK1"
HEADER = "<IQQQII"  # documents, tokens, index bytes, words, blocks, crc32 of the rest
CHECKPOINT = "<QQQQ"  # offset, bytes, tokens before in this file, documents before
#: Tokens after which a segment is closed; a document is never divided between segments.
SEGMENT = 1 << 20
#: Tokens of a file, about.
FILE_TOKENS = 1 << 26
#: Ids are below this; the frequency table has a place for each.
VOCABULARY = 1 << 20


def encode_documents(docs: DataFrame, path: str | None = None, end: int = END, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every text with the end id behind them.

    Null counts as empty: one id. Every row gives one row, repeated rows and null ids too; other columns are ignored.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    with_library(docs.sparkSession)
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    last = pack_ids([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(text) + last for text in texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def _numbers(ids: pa.Scalar) -> np.ndarray:
    return np.frombuffer(ids.as_buffer() or b"", "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id and n of every id in the table, counted in the tasks first: at most VOCABULARY rows, however long the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, "int64")
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(_numbers(ids))
                if len(found) > VOCABULARY:
                    raise ValueError(f"an id is not below {VOCABULARY}")
                if len(found) > len(counts):
                    counts, found = found, counts
                counts[:len(found)] += found
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def segment_bytes(index: pa.RecordBatch, ids: np.ndarray, table: rans.Table) -> bytes:
    """A segment of whole documents: `index` has doc_id and n_tokens of each, `ids` all their tokens."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(index)
    states, words, counts = rans.encode(ids, table)
    sums = [zlib.crc32(ids[at:at + rans.BLOCK].astype("<u4").tobytes()) for at in range(0, len(ids), rans.BLOCK)]
    body = b"".join([
        sink.getvalue(), counts.astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(),
        states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ])
    return struct.pack(HEADER, index.num_rows, len(ids), len(sink.getvalue()), len(words), len(counts), zlib.crc32(body)) + body


def read_segment(data: bytes, table: rans.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """The index and the token ids of a segment. Whatever does not fit its checksums is an error."""
    docs, n, index_bytes, n_words, blocks, crc = struct.unpack_from(HEADER, data)
    at = struct.calcsize(HEADER)
    stop = at + index_bytes + 8 * blocks + 8 * rans.LANES * blocks + 4 * n_words
    if stop != len(data) or zlib.crc32(memoryview(data)[at:]) != crc:
        raise ValueError("a segment is damaged")
    with pa.ipc.open_stream(pa.py_buffer(memoryview(data)[at:at + index_bytes])) as stream:
        index = stream.read_next_batch()
    at += index_bytes
    counts = np.frombuffer(data, "<u4", blocks, at).astype("int64")
    sums = np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    states = np.frombuffer(data, "<u8", blocks * rans.LANES, at + 8 * blocks).reshape(blocks, rans.LANES)
    words = np.frombuffer(data, "<u4", n_words, at + 8 * blocks + 8 * rans.LANES * blocks)
    ids = rans.decode(n, states, words, counts, table).astype("<u4")
    for k in range(blocks):
        if zlib.crc32(ids[k * rans.BLOCK:(k + 1) * rans.BLOCK].tobytes()) != sums[k]:
            raise ValueError(f"block {k} of a segment does not give the ids that were written")
    if index.num_rows != docs or int(np.sum(index.column(1).to_numpy())) != n:
        raise ValueError("documents of a segment do not fit its tokens")
    return index, ids


def _store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _writer(path: str, freq: bytes, segment: int, width: str):
    """Write the sorted rows of a partition as one file; gives the file's row of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = rans.Table(np.frombuffer(freq, "<u4"))
        task = TaskContext.get()
        name = f"part-{task.partitionId():08d}-{task.taskAttemptId()}.tok"
        store, folder = _store(path)
        out, points = None, []
        at = tokens = docs = 0
        keys, parts, size = [], [], 0

        def close() -> None:
            nonlocal at, tokens, docs, keys, parts, size
            lengths = pa.array([len(p) for p in parts], pa.int64())
            index = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), lengths], names=["doc_id", "n_tokens"])
            data = segment_bytes(index, np.concatenate(parts).astype("uint32"), table)
            out.write(data)
            points.append((at, len(data), tokens, docs))
            at, tokens, docs = at + len(data), tokens + size, docs + len(parts)
            keys, parts, size = [], [], 0

        for batch in batches:
            first = 0
            for i, ids in enumerate(batch.column(1)):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                    out.write(MAGIC + struct.pack("<I", zlib.crc32(freq)))
                    at = len(MAGIC) + 4
                parts.append(np.frombuffer(ids.as_buffer() or b"", width))
                size += len(parts[-1])
                if size >= segment:
                    keys.append(batch.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    close()
            if first < batch.num_rows:
                keys.append(batch.column(0).slice(first))
            parts = [np.array(p) for p in parts]  # the batch goes, its rows stay
        if parts:
            close()
        if out is None:
            return
        footer = b"".join(struct.pack(CHECKPOINT, *point) for point in points)
        out.write(footer + struct.pack("<II", len(points), zlib.crc32(footer)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([task.partitionId()], pa.int32()), "file": [name], "documents": pa.array([docs], pa.int64()),
            "tokens": pa.array([tokens], pa.int64()), "bytes": pa.array([at + len(footer) + 8 + len(MAGIC)], pa.int64()),
        })

    return run


def write_token_files(tokens: DataFrame, path: str, segment: int = SEGMENT, file_tokens: int = FILE_TOKENS) -> None:
    """Write doc_id and ids (as `encode_documents` gives them) to a new folder, in ascending order of doc_id.

    Null ids come first; rows of one id are ordered by a hash of their tokens, so that even an id that a third of all
    rows share is spread over files. Rows without tokens are kept, an empty table gives a folder without files.
    `tokens` is read three times and should be a written table.
    """
    spark = tokens.sparkSession
    with_library(spark)
    rows = id_counts(tokens).collect()  # bounded by the vocabulary
    total = sum(r.n for r in rows)
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, "uint64")
    for row in rows:
        counts[row.id] = row.n
    table = rans.Table.of_counts(counts)
    freq = table.freq[:-1].astype("<u4").tobytes()
    kind = tokens.schema["doc_id"].dataType.simpleString()
    spark.createDataFrame([(bytearray(freq), kind)], "freq binary, id_type string").coalesce(1).write.parquet(f"{path}/table")
    # small inputs have a file for each partition of a shuffle, as long as each gets a segment
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // segment))
    files = max(1, wanted, -(-total // file_tokens))
    width = "<u2" if len(counts) <= 1 << 16 else "<u4"
    order = [F.col("doc_id").asc_nulls_first(), "hash", "ids"]
    dealt = tokens.select("doc_id", F.xxhash64("ids").alias("hash"), "ids")
    if width == "<u2":
        dealt = dealt.mapInArrow(_narrow, f"doc_id {kind}, hash long, ids binary")
    dealt = dealt.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order).select("doc_id", "ids")
    manifest = "part int, file string, documents long, tokens long, bytes long"
    dealt.mapInArrow(_writer(path, freq, segment, width), manifest).write.parquet(f"{path}/manifest")


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids as 16-bit numbers, where all fit: half of what the sort has to move."""
    for batch in batches:
        ids = pa.array([_numbers(x).astype("<u2").tobytes() for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "hash", "ids"])


def _checkpoints(path: str):
    """Files of the manifest to their segments."""
    kinds = {"file": pa.string(), "at": pa.int64(), "bytes": pa.int64(), "first": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        tail = struct.calcsize("<II") + len(MAGIC)
        for batch in batches:
            rows = {name: [] for name in kinds}
            for file, size, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{folder}/{file}") as source:
                    if source.size() != size:
                        raise ValueError(f"{file} has {source.size()} bytes, not {size}")
                    end = source.read_at(tail, size - tail)
                    n, crc = struct.unpack_from("<II", end)
                    footer = source.read_at(n * struct.calcsize(CHECKPOINT), size - tail - n * struct.calcsize(CHECKPOINT))
                if end[-len(MAGIC):] != MAGIC or zlib.crc32(footer) != crc:
                    raise ValueError(f"the footer of {file} is damaged")
                for at, length, first, _ in struct.iter_unpack(CHECKPOINT, footer):
                    for name, value in zip(kinds, (file, at, length, base + first), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], kind) for k, kind in kinds.items()], names=list(kinds))

    return run


def _reader(path: str, freq: bytes):
    """Segments to documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(np.frombuffer(freq, "<u4"))
        store, folder = _store(path)
        for batch in batches:
            for file, at, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{folder}/{file}") as source:
                    head = source.read_at(len(MAGIC) + 4, 0)
                    if head != MAGIC + struct.pack("<I", zlib.crc32(freq)):
                        raise ValueError(f"{file} was written with another table")
                    data = source.read_at(size, at)
                index, ids = read_segment(data, table)
                lengths = index.column(1).to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                packed = ids.tobytes()
                for a in range(0, index.num_rows, 4096):
                    b = min(a + 4096, index.num_rows)
                    rows = [packed[4 * x:4 * y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [index.column(0).slice(a, b - a), pa.array(starts[a:b] + first), pa.array(rows, pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document in a folder of `write_token_files`.

    Every segment is read and decoded by itself; a damaged one fails the read.
    """
    with_library(spark)
    freq, kind = spark.read.parquet(f"{path}/table").first()
    manifest = spark.read.schema("part int, file string, documents long, tokens long, bytes long").parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("file", "bytes", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    segments = files.mapInArrow(_checkpoints(path), "file string, at long, bytes long, first long")
    spread = segments.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "at")
    return spread.mapInArrow(_reader(path, bytes(freq)), f"doc_id {kind}, start long, ids binary")


def token_file_round_trip(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the tokens of all documents to files in the shared folder and read them back: doc_id, start and ids.

    Nulls, repeated rows and empty tables: see `encode_documents` and `write_token_files`.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    write_token_files(staged(encode_documents(docs, path, id_column=id_column, text_column=text_column), "ids"), folder)
    return read_token_files(spark, folder)


def token_digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of documents as `read_token_files` gives them."""
    return documents.select(
        "doc_id", "start", F.expr("CAST(octet_length(ids) DIV 4 AS LONG)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
