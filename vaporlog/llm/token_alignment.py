"""Alignment of the tokens of two tokenizers over the same bytes, by merge paths.

The token ends of A and B over a block of documents are two sorted lists. Their merge is cut by diagonals into
pieces of equal work: a binary search along each diagonal tells how many ends of A and of B lie before it, so every
piece is merged by itself. A piece emits the overlaps of A and B tokens in its part of the bytes. Pieces are stitched
in order: an overlap begins a new group where both of its tokens are new, also against the last overlap of the
piece before. Groups are the stretches between bytes where tokens of both end.

Tasks align blocks of whole documents. What is counted over the corpus is counted in the tasks first: a block has one
row for each id pair it links, with its number of documents, and only these rows meet over the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.llm.common import staged, text_of, with_library
from vaporlog.llm.tokens import library_encoder

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Steps of the merge in a piece.
WORK = 1 << 16
#: Characters (about) and documents of a block.
BLOCK_CHARS = 2_000_000
BLOCK_DOCUMENTS = 1 << 14
#: Links of a group above which its tokens are counted before they are paired, and links that are paired at once.
LARGE_GROUP = 4096
SLICE = 1 << 22
#: Bits of an id in a pair.
ID_BITS = 24


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of `a` are among the first d of the merge of two sorted lists, for each diagonal d; of equal values a's comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while len(at := np.flatnonzero(low < high)):
        middle = (low[at] + high[at]) // 2
        taken = a[middle] <= b[diagonals[at] - 1 - middle]
        low[at[taken]] = middle[taken] + 1
        high[at[~taken]] = middle[~taken]
    return low


def piece_overlaps(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps of a piece with ends `a` and `b`: places of A and B tokens within the piece, in the order of bytes.

    An overlap ends where one of its tokens ends. An end of B that is also one of A gives none of its own;
    `before` is the last end of A ahead of the piece, for an end of B that meets it across the diagonal.
    """
    of_a = np.searchsorted(b, a, "left")
    of_b = np.searchsorted(a, b, "right")
    first, second = np.empty(len(a) + len(b), "int64"), np.empty(len(a) + len(b), "int64")
    kept = np.ones(len(a) + len(b), bool)
    place = np.arange(len(a)) + of_a
    first[place], second[place] = np.arange(len(a)), of_a
    place = np.arange(len(b)) + of_b
    first[place], second[place] = of_b, np.arange(len(b))
    kept[place] = np.append(before, a)[of_b] != b
    return first[kept], second[kept]


def group_starts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """The first token of A and of B of every group; both lists of ends stop at the same byte."""
    diagonals = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    i = merge_path(a, b, diagonals)
    j = diagonals - i
    firsts, seconds, last_a, last_b = [], [], -1, -1
    for k in range(len(diagonals) - 1):
        before = int(a[i[k] - 1]) if i[k] else -1
        first, second = piece_overlaps(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]], before)
        if not len(first):
            continue
        first, second = first + i[k], second + j[k]
        new = (np.diff(first, prepend=last_a) > 0) & (np.diff(second, prepend=last_b) > 0)
        firsts.append(first[new])
        seconds.append(second[new])
        last_a, last_b = int(first[-1]), int(second[-1])
    if not firsts:
        return np.empty(0, "int64"), np.empty(0, "int64")
    return np.concatenate(firsts), np.concatenate(seconds)


@dataclass
class Aligned:
    """A block: tokens of all documents in a row, where each document's and each group's tokens begin (one more at the end)."""

    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def group_doc(self) -> np.ndarray:
        """The document of each group."""
        return np.searchsorted(self.doc_a, self.group_a[:-1], "right") - 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked id pairs of each document, as document << 48 | a << 24 | b ascending, and how often each is linked."""
        na, nb, doc = np.diff(self.group_a), np.diff(self.group_b), self.group_doc()
        size = na * nb
        found, times = [], []
        small = np.flatnonzero(size <= LARGE_GROUP)
        for part in np.split(small, np.searchsorted(np.cumsum(size[small]), np.arange(SLICE, int(size[small].sum()) + 1, SLICE))):
            owner = np.repeat(part, size[part])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            a = self.a[self.group_a[owner] + nth // nb[owner]].astype("int64")
            b = self.b[self.group_b[owner] + nth % nb[owner]].astype("int64")
            pairs, n = np.unique(doc[owner] << 2 * ID_BITS | a << ID_BITS | b, return_counts=True)
            found.append(pairs)
            times.append(n)
        for g in np.flatnonzero(size > LARGE_GROUP).tolist():
            a, of_a = np.unique(self.a[self.group_a[g]:self.group_a[g + 1]].astype("int64"), return_counts=True)
            b, of_b = np.unique(self.b[self.group_b[g]:self.group_b[g + 1]].astype("int64"), return_counts=True)
            found.append((doc[g] << 2 * ID_BITS | (a << ID_BITS)[:, None] | b[None, :]).reshape(-1))
            times.append((of_a[:, None] * of_b[None, :]).reshape(-1))
        if not found:
            return np.empty(0, "int64"), np.empty(0, "int64")
        codes, n = np.concatenate(found), np.concatenate(times)
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, "int64")
        return codes[first], np.add.reduceat(n, first) if len(first) else n

    def group_texts(self, table: list[bytes], ids_a: int) -> Iterator[bytes]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`; empty without tokens. For `table` see `_texts`."""
        kinds = np.empty(len(self.a) + len(self.b), "int64")
        na, nb = np.diff(self.group_a), np.diff(self.group_b)
        kinds[np.arange(len(self.a)) + np.repeat(self.group_b[:-1], na)] = 2 * self.a.astype("int64")
        kinds[np.arange(len(self.b)) + np.repeat(self.group_a[1:], nb)] = 2 * (self.b.astype("int64") + ids_a)
        kinds[self.group_a[1:] + self.group_b[:-1] - 1] += 1
        kinds[self.group_a[1:] + self.group_b[1:] - 1] += 1
        bounds = (self.doc_a + self.doc_b).tolist()
        for start, stop in zip(bounds, bounds[1:], strict=False):
            yield b"".join(map(table.__getitem__, kinds[start:stop].tolist()))[:-1]


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.encode_a = library_encoder(path_a, special=False)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = Tokenizer.from_file(path_a).get_vocab()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [byte for byte in range(256) if byte not in plain]
        alphabet = {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(rest)}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError(f"a vocabulary has more than 2^{ID_BITS} ids")
        self.lengths_a = np.fromiter(map(len, self.bytes_a), "int64")
        self.lengths_b = np.fromiter(map(len, self.bytes_b), "int64")
        self.texts = [b"%d%c" % (i, end) for i in range(len(self.bytes_a)) for end in b",|"]
        self.texts += [b"%d%c" % (i, end) for i in range(len(self.bytes_b)) for end in b",;"]

    def align(self, texts: list[str], work: int = WORK) -> Aligned:
        """All texts of a block, each behind a space. Empty ones, and those whose tokens are not their bytes, have no tokens."""
        none = np.empty(0, "<u4")
        all_a, all_b = [], []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1) if texts else [], strict=True):
            a = np.frombuffer(self.encode_a(" " + text), "<u4") if text else none
            whole = (" " + text).encode() if text else b""
            same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole == b"".join(map(self.bytes_b.__getitem__, ids))
            all_a.append(a if same else none)
            all_b.append(np.array(ids, "<u4") if same else none)
        a, b = np.concatenate([none, *all_a]), np.concatenate([none, *all_b])
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        starts_a, starts_b = group_starts(ends_a, ends_b, work)
        return Aligned(
            a, b, np.cumsum([0, *map(len, all_a)]), np.cumsum([0, *map(len, all_b)]),
            np.append(starts_a, len(a)), np.append(starts_b, len(b)),
        )


_known: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _known:
        _known[path_a, path_b] = Tokenizers(path_a, path_b)
    return _known[path_a, path_b]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of some megabytes of whole documents at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        first = 0
        for i, value in enumerate(batch.column(1)):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS or len(texts) >= BLOCK_DOCUMENTS:
                yield pa.concat_arrays([*ids, batch.column(0).slice(first, i + 1 - first)]), texts
                ids, texts, size, first = [], [], 0, i + 1
        if first < batch.num_rows:
            ids.append(batch.column(0).slice(first))
    if texts:
        yield pa.concat_arrays(ids), texts


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_tokenizers.path(TOKENIZER), path_b or public_tokenizers.path(PIECES)


def aligned_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The alignment itself: doc_id, groups (array of struct of a and b, the ids of each side in order).

    One row per input row; null and empty texts, and those whose tokens of A or B do not join to a space and the
    text, have no groups. Other columns are ignored; an empty table gives no rows.
    """
    path_a, path_b = _paths(path_a, path_b)
    with_library(docs.sparkSession)
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            found = _tokenizers(path_a, path_b).align(texts)
            sides = [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens.astype("int64")))
                for bounds, tokens in ((found.group_a, found.a), (found.group_b, found.b))
            ]
            bounds = np.searchsorted(found.group_doc(), np.arange(len(texts) + 1))
            groups = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(sides, names=["a", "b"]))
            yield pa.RecordBatch.from_arrays([ids, groups], names=["doc_id", "groups"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, groups array<struct<a: array<long>, b: array<long>>>")


MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def alignment_blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Blocks of aligned documents, one row each, to be written once.

    block; doc_ids, MEASURES and groups_sha256 (arrays over its documents); pairs and docs (arrays over the id pairs that it
    links, a << 24 | b ascending, and the number of its documents that hold each); and for its documents in a row
    the places of their pairs and how often they are linked (`places`, `times`, packed; `ends` is where a document's stop).
    """
    path_a, path_b = _paths(path_a, path_b)
    with_library(docs.sparkSession)
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(_blocks(batches)):
            both = _tokenizers(path_a, path_b)
            found = both.align(texts)
            n, doc = len(texts), found.group_doc()
            size = np.diff(found.group_a) * np.diff(found.group_b)
            done = np.append(0, np.cumsum(size))
            bounds = np.searchsorted(doc, np.arange(n + 1))
            codes, times = found.links()
            pairs, places, docs_of = np.unique(codes & ((1 << 2 * ID_BITS) - 1), return_inverse=True, return_counts=True)
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in found.group_texts(both.texts, len(both.bytes_a))]
            measures = [np.diff(found.doc_a), np.diff(found.doc_b), np.diff(bounds), done[bounds[1:]] - done[bounds[:-1]]]
            ends = np.searchsorted(codes, (np.arange(n) + 1) << 2 * ID_BITS)
            row = [
                pa.array([base + k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                *(pa.array([m], pa.list_(pa.int64())) for m in measures), pa.array([digests], pa.list_(pa.string())),
                pa.array([pairs], pa.list_(pa.int64())), pa.array([docs_of], pa.list_(pa.int64())),
                pa.array([places.astype("<u4").tobytes()], pa.binary()), pa.array([times.astype("<u8").tobytes()], pa.binary()),
                pa.array([ends], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(
                row, names=["block", "doc_ids", *MEASURES, "groups_sha256", "pairs", "docs", "places", "times", "ends"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    measures = ", ".join(f"{name} array<long>" for name in MEASURES)
    return rows.mapInArrow(
        run, f"block long, doc_ids array<{kind}>, {measures}, groups_sha256 array<string>, pairs array<long>, docs array<long>, "
        "places binary, times binary, ends array<long>"
    )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (documents of the corpus that hold it linked) and best (n is the highest of its A id), from `alignment_blocks`.

    The highest counts are one row for each id of A: bounded by its vocabulary, whatever the corpus.
    """
    each = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs")
    counts = staged(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")), "pairs")
    counts = counts.withColumn("a", F.shiftright("pair", ID_BITS))
    highest = counts.groupBy(F.col("a").alias("of")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), F.col("a") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_summary(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Links are counted with repetition; a pair's count is the number of rows of `docs` that hold it linked, so a row
    repeated counts again. Texts without tokens (see `aligned_groups`) have zeros and an empty digest. Null ids are
    rows like others; other columns are ignored; an empty table gives no rows.
    """
    blocks = staged(alignment_blocks(docs, path_a, path_b, id_column, text_column), "aligned")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    each = blocks.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "of_pair"))
    found = each.join(pair_counts(blocks), F.col("of_pair") == F.col("pair")).select("of_block", "place", "n", "best")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = {name: left.column(name)[0] for name in left.column_names}
        order = np.argsort(right.column("place").to_numpy())
        counts, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        places, times = np.frombuffer(row["places"].as_py(), "<u4"), np.frombuffer(row["times"].as_py(), "<u8").astype("int64")
        if len(places) and int(places.max()) >= len(counts):
            raise ValueError("pairs of a block have no count")
        ends = np.append(0, row["ends"].values.to_numpy())
        sums = []
        for weight in (best, counts):
            run_up = np.append(0, np.cumsum(times * weight[places]))
            sums.append(pa.array(run_up[ends[1:]] - run_up[ends[:-1]], pa.int64()))
        return pa.Table.from_arrays(
            [row["doc_ids"].values, *(row[name].values for name in MEASURES), *sums, row["groups_sha256"].values],
            names=["doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256"],
        )

    measures = ", ".join(f"{name} long" for name in MEASURES)
    return blocks.drop("pairs", "docs").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(
        run, f"doc_id {kind}, {measures}, n_best long, count_sum long, groups_sha256 string"
    )
