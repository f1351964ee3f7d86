"""Stage functions on tables with any columns, and the pipeline against brute force, stage by stage."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm import brute_measures
from vaporlog.llm import exact_dedup, line_dedup, ngram_join, packing, quality_rules, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
CLASHES = "_id _hash _sha _gone _toxic_id _toxic_hash _d _t _lines _doc_id __doc_id _TEXT_HASH _sha256 _lines_ doc_id_ node host recipe h1 label".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} string" for name in CLASHES)


def word_text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, *CLASHES) for i, t, s in rows], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


STAGES = {
    "keep_good": lambda docs, labels: quality_rules.keep_good(docs),
    "drop_toxic": toxicity.drop_toxic,
    "drop_copies": lambda docs, labels: exact_dedup.drop_copies(docs),
    "drop_near_copies": lambda docs, labels: ngram_join.drop_near_copies(docs),
    "drop_repeated_lines": lambda docs, labels: line_dedup.drop_repeated_lines(docs),
}


@pytest.mark.parametrize("name", STAGES)
def test_any_columns_and_awkward_rows(spark, name):
    rng = random.Random(1)
    good = word_text(rng, 80)
    rows = [(1, good, "a"), (2, good, "a"), (2, good, "a"), (3, None, None), (4, "", "a"), (None, word_text(rng, 70), "a"), (5, "x" * 50_000, "a"),
            (6, word_text(rng, 90), None)]
    docs, labels = documents(spark, rows), labels_of(spark, [(1, 1, 0), (9, 1, 1), (None, 1, 1), (2, None, None)])
    kept = STAGES[name](docs, labels)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert all([r[c] for c in CLASHES] == CLASHES for r in found)
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in found)
    if name != "drop_repeated_lines":
        assert {(r.doc_id, r.text) for r in found} <= {(i, t) for i, t, _ in rows}
    want = {
        "keep_good": {1, 2, None, 6}, "drop_toxic": {1, 2, 3, 4, None, 5, 6}, "drop_copies": {2, 4, None, 5, 6},
        "drop_near_copies": {1, 3, 4, None, 5, 6}, "drop_repeated_lines": {1, 2, 3, 4, None, 5, 6},
    }[name]
    assert {i if has else None for has, i in ids} == want
    empty = STAGES[name](documents(spark, []), labels_of(spark, []))
    assert empty.columns == docs.columns and empty.count() == 0


def test_text_ids(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"d{i}", word_text(rng, 60)) for i in range(20)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(20)], "doc_id string, toxic int")
    assert toxicity.score(docs, labels).count() == 20


def test_pipeline_on_an_empty_table(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_quality(rows):
    """Base rules and hosts, as the stage's module states them."""
    measured = []
    for i, text, host in rows:
        n, chars, symbols, dup, repeat = brute_measures(text)
        lines = len([x for x in (text or "").split("\n") if x.strip(" \t\x0b\f\r")])
        fails = (n < 50 or 100 * repeat > 50 * n, 2 * symbols > n, chars < 2 * n or chars > 15 * n, 2 * dup > lines)
        measured.append((i, host, fails))
    hosts = defaultdict(list)
    for _, host, fails in measured:
        hosts[host].append(fails)
    rejected = set()
    for rule in range(4):
        rates = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        var = sum((r - mean) ** 2 for r in rates.values()) / len(rates)
        weight = 1000.0 if var <= 0 else min(1000.0, max(1.0, mean * (1 - mean) / var - 1))
        rejected |= {h for h, fs in hosts.items() if (rates[h] * len(fs) + mean * weight) / (len(fs) + weight) > 0.5}
    return {i for i, host, fails in measured if not fails[0] and host not in rejected}


def brute_near(rows, length=5, num=4, den=5):
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        k = min(length, len(words))
        sets[i] = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        words = word_text(rng, 70).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(70)] = rng.choice(["grobian", "vexling", "you moron"])
        rows.append((i, " ".join(words), rng.choice(["a", "b", None])))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, clean[k][1], "a") for k in range(20)]  # exact copies
    rows += [(1100 + k, clean[50 + k][1] + " tail", "b") for k in range(20)]  # near copies
    rows += [(1200 + k, rng.choice([None, "", "too short", "one two " * 60, "# $ % " * 40]), "c") for k in range(40)] + [(1300, word_text(rng, 80), "c")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: (r.text, r.source) for r in frame.collect()}
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        out = spark.read.parquet(f"{tmp_path}/{at}")
        if name == "best_fit_packing":
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == set(before)
            ends = defaultdict(int)
            for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == ends[r.sequence_id]
                ends[r.sequence_id] += r.length
            assert max(ends.values()) <= 1024
            assert len(ends) <= len(packing.best_fit(np.array([r.length for r in pieces]), 1024)[2])
            break
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.columns == frame.columns and out.count() == len(kept)
        if name == "quality_rules":
            assert kept == brute_quality([(i, *x) for i, x in before.items()]) and 1300 not in kept
        elif name == "toxicity":
            scored = toxicity.score(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter(F.col("score") < 0.5)
            assert kept == {r.doc_id for r in scored.select("doc_id").collect()}
            assert not {i for i in kept if i < 700 and i % 4 == 0} and {i for i in before if i >= 1000 or i % 4} == kept
        elif name == "exact_dedup":
            last = {text: i for i, (text, _) in sorted(before.items())}
            assert kept == set(last.values()) and len(before) - len(kept) == 20
        else:
            assert kept == brute_near([(i, text) for i, (text, _) in before.items()]) and len(before) - len(kept) == 20
        frame = out
