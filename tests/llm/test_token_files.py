"""Token files: exact round trips of codec and files, and ids of the library's plain call."""

import random
import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from tokenizers import Tokenizer

from vaporlog.llm import rans, token_files
from vaporlog.llm.common import new_path, staged
from vaporlog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, hash long, start long, part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def library_ids(texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=300), st.integers(1, 40))
def test_codec_round_trip(symbols, times):
    symbols = np.array(symbols * times, "uint32")
    table = rans.Table.of_counts(np.bincount(symbols, minlength=1))
    states, words, counts = rans.encode(symbols, table)
    assert (rans.decode(len(symbols), states, words, counts, table) == symbols).all()


@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 7])
def test_codec_is_near_the_entropy(n):
    symbols = (np.random.default_rng(n).zipf(1.4, n) % 5000).astype("uint32")
    counts = np.bincount(symbols)
    table = rans.Table.of_counts(counts)
    assert int(table.freq[:-1].sum()) == 1 << table.bits and ((table.freq[:-1] > 0) == (counts > 0)).all()
    states, words, sizes = rans.encode(symbols, table)
    assert (rans.decode(n, states, words, sizes, table) == symbols).all()
    share = counts[counts > 0] / n
    entropy = -n * (share * np.log2(share)).sum() / 8
    assert 4 * len(words) <= 1.02 * entropy + 1024


def test_one_symbol_and_no_symbols():
    table = rans.Table.of_counts(np.array([0, 7]))
    states, words, counts = rans.encode(np.ones(100, "uint32"), table)
    assert len(words) == 0 and (rans.decode(100, states, words, counts, table) == 1).all()
    none = rans.Table.of_counts(np.zeros(3))
    assert len(rans.decode(0, *rans.encode(np.empty(0, "uint32"), none), none)) == 0
    with pytest.raises(ValueError, match="no frequency"):
        rans.encode(np.zeros(1, "uint32"), table)


def test_skewed_counts_keep_every_symbol():
    counts = np.array([10**15] + [1] * 3000)
    table = rans.Table.of_counts(counts)
    assert int(table.freq[:-1].min()) == 1 and int(table.freq[:-1].sum()) == 1 << table.bits


def test_damage_is_found():
    import pyarrow as pa

    ids = np.arange(1000, dtype="uint32") % 17
    table = rans.Table.of_counts(np.bincount(ids))
    index = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "n_tokens": [400, 600]})
    data = token_files.segment_bytes(index, ids, table)
    again, got = token_files.read_segment(data, table)
    assert again == index and (got == ids).all()
    for at in (3, 40, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.read_segment(bytes(broken), table)
    with pytest.raises(ValueError):
        token_files.read_segment(data[:-4], table)
    other = rans.Table.of_counts(np.bincount(ids)[::-1] + np.arange(17) * 50)
    with pytest.raises(ValueError):
        token_files.read_segment(data, other)


def test_files_keep_order_and_ids(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-50, 400), " ".join(rng.choice("ab ïé\n 日本 <|endoftext|> word".split(" ")) for _ in range(rng.randrange(40))))
            for _ in range(300)]
    rows += [(7, "same")] * 40 + [(None, None), (None, "no id"), (3, ""), (5, "long " * 30_000)]
    docs = documents(spark, rows).repartition(5)
    folder = new_path(spark, "test")
    token_files.write_token_files(staged(token_files.encode_documents(docs), "ids"), folder, segment=500, file_tokens=9_000)
    got = token_files.read_token_files(spark, folder).orderBy("start", "doc_id").collect()
    want = {}
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        want.setdefault(i, []).append(packed(ids))
    assert len(got) == len(rows)
    at = 0
    for row in got:  # gapless in ascending order of ids, nulls first
        assert row.start == at
        want[row.doc_id].remove(bytes(row.ids))
        at += len(row.ids) // 4
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    files = list(Path(folder.removeprefix("file://")).glob("part-*.tok"))
    assert len(files) > 3


def test_special_strings_are_special(spark):
    text = "a <|endoftext|>b  <|endoftext|>"
    row = token_files.encode_documents(documents(spark, [(1, text)])).first()
    assert bytes(row.ids) == packed(library_ids([text])[0]) and 50256 in library_ids([text])[0]


def test_damaged_file_fails_the_read(spark):
    folder = new_path(spark, "test")
    token_files.write_token_files(staged(token_files.encode_documents(documents(spark, [(1, "a b c"), (2, "d")])), "ids"), folder)
    file = next(Path(folder.removeprefix("file://")).glob("part-*.tok"))
    data = bytearray(file.read_bytes())
    data[len(data) // 3] ^= 255
    file.write_bytes(data)
    for crc in file.parent.glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(PySparkException, match="damaged|block|fit|table"):
        token_files.read_token_files(spark, folder).collect()


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", None), ("é", "y")], "doc_id string, text string")
    got = token_files.token_digests(token_files.token_file_round_trip(docs)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [("a", 0, 1), ("b", 1, 2), ("é", 3, 2)]
    assert token_files.token_file_round_trip(documents(spark, [])).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op11_token_files"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    at = 0
    for row, ids in zip(rows, library_ids([r.text for r in rows])):
        mine = got[row.doc_id]
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)
    assert len(got) == len(rows)
