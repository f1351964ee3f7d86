"""Best-fit packing with certified bin counts.

Documents become pieces of at most `size` tokens. Every partition packs its pieces by best-fit
decreasing and compares its number of bins with a lower bound from dual feasible functions. Bins
of partitions that meet their bound are final. From the others, full bins stay and bins with
gaps give their pieces to an exchange; the pieces are dealt anew, in fewer partitions, and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.llm.common import staged, text_of, with_library
from vaporlog.llm.tokens import library_encoder, texts_of

TOKENIZER = "byte_bpe_50k.json"
SIZE = 1024
#: The id that ends every document.
END = 2
#: Exchanges at the most; fewer when every partition is certified.
ROUNDS = 3
#: Pieces that one partition packs at once, about.
PARTITION_PIECES = 250_000
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32.

    A document's ids are its text's and one end id. Longer ones than `size` are cut; all pieces but
    the first are full. Null counts as empty (one piece of one id).
    """
    path = path or public_tokenizers.path(TOKENIZER)
    with_library(docs.sparkSession)
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                packed = encode(text) + end
                n = len(packed) // 4
                at, k = 0, n % size or size
                while at < n:
                    row.append(i)
                    piece.append(piece[-1] + 1 if at else 0)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(packed[4 * at:4 * (at + k)]))
                    at, k = at + k, size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, PIECES.format(kind=kind))


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that no packing of these lengths can do without.

    The largest of the dual feasible functions f_k: lengths over size - k count as whole bins, those under
    k as nothing, the others as their length; k = 0 gives the total length.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(np.minimum(lengths, size), minlength=size + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(size + 1))
    k = np.arange(size // 2 + 1)
    large = number[size] - number[size - k]
    middle = total[size - k] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int(np.max(large - (-middle // size)))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of every piece, and the free space of every bin."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins, offsets, free = [0] * len(sizes), [0] * len(sizes), []
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    gaps = 0  # bit g is set when a bin has g places
    for i in order:
        need = sizes[i]
        fitting = gaps >> need
        if fitting:
            gap = need + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b = size, len(free)
            free.append(size)
        bins[i], offsets[i] = b, size - gap
        left = free[b] = gap - need
        if left:
            by_gap[left].append(b)
            gaps |= 1 << left
    return np.array(bins, "int64"), np.array(offsets, "int64"), np.array(free, "int64")


def _packer(size: int, step: int, last: bool):
    """Pack the rows of a partition; `open` marks pieces that take part in the next exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        read = [b for b in batches if b.num_rows]
        if not read:
            return
        rows = pa.Table.from_batches(read).combine_chunks()
        lengths = rows.column("length").to_numpy()
        bins, offsets, free = best_fit(lengths, size)
        certified = len(free) <= lower_bound(lengths, size)
        again = np.zeros(len(lengths), bool) if certified or last else free[bins] > 0
        # partition, then bin: numbers never meet within a round, and the round comes first
        base = (step << 56) + (TaskContext.get().partitionId() << 32)
        rows = rows.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        rows = rows.append_column("open", pa.array(again))
        yield from rows.to_batches(max_chunksize=65536)

    return run


def pack(pieces: DataFrame, size: int = SIZE, rounds: int = ROUNDS, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset; sequences are gapless from 0.

    Any numbering is possible; it is unique over all rounds and partitions. Ties in length keep the
    order in which a partition reads its pieces. No pieces give no rows.
    """
    spark = pieces.sparkSession
    with_library(spark)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"{PIECES.format(kind=kind)}, sequence_id long, offset long, open boolean"
    done = []
    waiting = staged(pieces, "pieces")
    left = waiting.count()
    for step in range(rounds):
        parts = -(-left // partition_pieces) if step == 0 else max(1, -(-left // (2 * partition_pieces)))
        last = step == rounds - 1 or (step > 0 and parts == 1)
        dealt = waiting.repartition(max(1, parts), F.hash("doc_id", "piece", F.lit(step)))
        packed = staged(dealt.mapInArrow(_packer(size, step, last), schema), f"packed{step}")
        done.append(packed.filter("NOT open").drop("open"))
        waiting = packed.filter("open").drop("open", "sequence_id", "offset")
        left = 0 if last else waiting.count()
        if not left:
            break
    result = done[0]
    for frame in done[1:]:
        result = result.unionByName(frame)
    return result


def pack_documents(docs: DataFrame, size: int = SIZE, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All documents as pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_pieces(docs, size, path, id_column, text_column), size)
