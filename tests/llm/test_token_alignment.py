"""Alignment of two tokenizers against a plain walk over the bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vaporlog.llm import token_alignment
from vaporlog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block long, pairs string, place int, n int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


class Brute:
    """The rule of the contract, document by document."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.word = {i: w for w, i in self.a.get_vocab().items()}
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        hidden = [x for x in range(256) if x not in shown]
        self.byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.word[i]) for i in a]
        bytes_b = [self.bytes_b(i) for i in b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        groups, at_a, at_b, i, j = [], 0, 0, 0, 0
        first_i = first_j = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a, i = at_a + len(bytes_a[i]), i + 1
            else:
                at_b, j = at_b + len(bytes_b[j]), j + 1
            if at_a == at_b:
                groups.append((a[first_i:i], b[first_j:j]))
                first_i, first_j = i, j
        return groups

    def summary(self, rows):
        aligned = [(i, self.groups(t)) for i, t in rows]
        counts, best = Counter(), Counter()
        for _, groups in aligned:
            counts.update({(x, y) for a, b in groups for x in a for y in b})
        for (x, _), n in counts.items():
            best[x] = max(best[x], n)
        out = []
        for i, groups in aligned:
            links = [(x, y) for a, b in groups for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append((
                i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            ))
        return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(row):
    return tuple((x is not None, x) for x in row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=60), st.lists(st.integers(1, 6), max_size=60), st.integers(1, 9))
def test_pieces_of_any_size_give_the_same_groups(a, b, work):
    a, b = np.cumsum([0, *a])[1:], np.cumsum([0, *b])[1:]
    stop = int(max(a[-1] if len(a) else 0, b[-1] if len(b) else 0))
    a = np.append(a, stop) if stop and (not len(a) or a[-1] < stop) else a  # both stop at the same byte
    b = np.append(b, stop) if stop and (not len(b) or b[-1] < stop) else b
    common = np.intersect1d(a, b)[:-1]
    want = [0] * bool(stop)
    got_a, got_b = token_alignment.group_starts(a, b, work)
    assert got_a.tolist() == want + np.searchsorted(a, common, "right").tolist()
    assert got_b.tolist() == want + np.searchsorted(b, common, "right").tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40), st.lists(st.integers(0, 20), max_size=40))
def test_diagonals(a, b):
    a, b = np.array(sorted(a), "int64"), np.array(sorted(b), "int64")
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    diagonals = np.arange(len(merged) + 1)
    assert token_alignment.merge_path(a, b, diagonals).tolist() == [sum(s == 0 for _, s in merged[:d]) for d in diagonals]


def odd_rows():
    rng = random.Random(3)
    words = "the The naïve 日本語 🙂 x\ty <s> </s> <|endoftext|> <0x0A> antidisestablishmentarianism  double ▁ 12345 𝔘 é \x00 zß\n\n".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, " leading"), (104, "trailing "), (105, "a▁b"), (106, "\n"), (None, "no id"), (107, "x" * 5000)]
    rows += [(108, "the same text")] * 3 + [(109, "ab" * 3000 + " é" * 2000)]
    return rows


def test_summary_against_brute_force(spark, monkeypatch):
    rows = odd_rows()
    want = sorted(Brute().summary(rows), key=order)
    got = token_alignment.alignment_summary(documents(spark, rows).repartition(3))
    assert got.columns == COLUMNS and sorted((tuple(r) for r in got.collect()), key=order) == want
    assert sum(1 for row in want if row[1] == 0) >= 3  # some texts are not their tokens' bytes


def test_small_blocks_slices_and_counted_groups_change_nothing(monkeypatch):
    both = token_alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for _, t in odd_rows()]
    plain = both.align(texts).links()
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 1)
    monkeypatch.setattr(token_alignment, "SLICE", 50)
    for work in (1, 7, 1000):
        found = both.align(texts, work)
        again = found.links()
        assert (again[0] == plain[0]).all() and (again[1] == plain[1]).all()
    brute = Brute()
    for k, text in enumerate(texts):
        want = Counter((x, y) for a, b in brute.groups(text) for x in a for y in b)
        mine = plain[0] >> 48 == k
        assert dict(zip(plain[0][mine].tolist(), plain[1][mine].tolist())) == {k << 48 | x << 24 | y: n for (x, y), n in want.items()}


def test_groups_themselves(spark):
    rows = odd_rows()
    got = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in token_alignment.aligned_groups(documents(spark, rows)).collect()}
    brute = Brute()
    assert all(got[i] == [(list(a), list(b)) for a, b in brute.groups(t)] for i, t in rows)


def test_empty_table_and_text_ids(spark):
    assert token_alignment.alignment_summary(documents(spark, [])).count() == 0
    docs = spark.createDataFrame([("b", "one two"), ("a", None)], "doc_id string, text string")
    got = {r.doc_id: r.n_groups for r in token_alignment.alignment_summary(docs).collect()}
    assert got["a"] == 0 and got["b"] >= 1


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_alignment"](spark, FOLDER)
    assert got.columns == COLUMNS and sorted((tuple(r) for r in got.collect()), key=order) == sorted(Brute().summary(rows), key=order)
