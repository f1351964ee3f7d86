"""Divergence of sources against exact brute force, and transducers against sorted lists."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaporlog.llm import source_divergence
from vaporlog.llm.transducer import Transducer

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, shard string, ordinal string, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, *row, "x", 1, "y", "z", 5) for i, row in enumerate(rows)], SCHEMA)


def brute(rows, least=10, top=10):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(TERM.findall((t or "").translate(small)), lang or "", source or "") for t, lang, source in rows]
    spread, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in rows:
        spread[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((w for w, n in spread[lang].items() if n >= least), key=lambda w: w.encode())
        v = len(kept)

        def shares(found):
            total = sum(found[w] for w in kept)
            return {w: 1 + 10**9 * (found[w] + 2) // (total + 2 * v) for w in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(gap(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-gap(p[s][w], q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1)}
    return out


@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=80), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer(terms, others):
    terms = sorted(terms)
    found = Transducer.from_bytes(Transducer.of_sorted(terms).to_bytes())
    asked = terms + others
    lengths = np.array([len(t) for t in asked], "int64")
    data = np.frombuffer(b"".join(asked), "uint8")
    want = [terms.index(t) if t in terms else -1 for t in asked]
    assert found.ordinals(data, np.cumsum(lengths) - lengths, lengths).tolist() == want
    assert [found.term(i) for i in range(len(terms))] == terms


def test_transducer_is_minimal_and_checks_its_order():
    terms = sorted(a + b + c for a in (b"un", b"re", b"") for b in (b"do", b"make", b"tie") for c in (b"ing", b"s", b""))
    found = Transducer.of_sorted(terms)
    suffixes = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for t in terms for p in (t[:k] for k in range(len(t) + 1))}
    assert len(found.final) == len(suffixes)  # one state for each set of ends
    for wrong in ([b"b", b"a"], [b"a", b"a"], [b""]):
        with pytest.raises(ValueError, match="does not come after"):
            Transducer.of_sorted(wrong)
    with pytest.raises(IndexError):
        Transducer.of_sorted([]).term(0)


def random_rows(rng, n):
    words = [f"{rng.choice('abcdéßЖ語')}{rng.choice(['an', 'Na', 'ø', 'the'])}{chr(97 + i % 20)}" for i in range(60)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice(["s1", "s1", "s1", "S2", "ß", None, "z", "zz"])
        part = words if source == "s1" else words[: rng.randrange(10, 60)]
        rows.append((rng.choice([" ", "-", "1", "\n", "_"]).join(rng.choice(part) for _ in range(rng.randrange(30))), lang, source))
    return rows


@pytest.mark.parametrize("shard_terms", [3, 1 << 16])
def test_against_brute_force(spark, shard_terms, monkeypatch):
    rows = random_rows(random.Random(7), 300)
    rows += [(None, "en", "none at all"), ("", "xx", "a"), ("rare words", "xx", "b"), ("x" * 60_000, "en", "s1"), ("alone " * 20, "one", "only")]
    rows += [("twin copy", "tt", "a")] * 12 + [("twin copy", "tt", "b")] * 12
    if shard_terms == 3:  # nothing depends on what a task holds, what is broadcast, or on tiles
        monkeypatch.setattr(source_divergence, "HELD", 40)
        monkeypatch.setattr(source_divergence, "BROADCAST_BYTES", 0)
    got = source_divergence.source_divergence(documents(spark, rows).repartition(3), shard_terms=shard_terms).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_tiles_of_few_sources_and_ordinals(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    terms, sources = 25, 7
    p = rng.integers(1, 10**9, (sources, terms))
    absent = rng.integers(1, 1000, sources)
    there = rng.random((sources, terms)) < 0.4
    p = np.where(there, p, absent[:, None])
    want = {(i, j): int(((p[i] - p[j]) ** 2 // (p[i] + p[j])).sum()) for i in range(sources) for j in range(sources) if i != j}
    monkeypatch.setattr(source_divergence, "CHUNK", 10)
    monkeypatch.setattr(source_divergence, "SOURCES", 3)
    got = Counter()
    for chunk in range(3):
        for low in range(3):
            for high in range(low, 3):
                rows = [(i, -1, absent[i], terms) for i in range(sources) if i // 3 in (low, high)]
                rows += [(i, o, p[i, o], None) for i in range(sources) if i // 3 in (low, high)
                         for o in range(10 * chunk, min(10 * chunk + 10, terms)) if there[i, o]]
                rng.shuffle(rows)
                table = pa.table({name: pa.array(list(x), pa.int64()) for name, x in zip(("number", "ordinal", "p", "terms"), zip(*rows))})
                tile = source_divergence._tile((pa.scalar("en"), *map(pa.scalar, (chunk, low, high))), table)
                for row in tile.to_pylist():
                    got[row["number"], row["other"]] += row["value"]
    assert got == want


def test_empty_table(spark):
    assert source_divergence.source_divergence(documents(spark, [])).count() == 0
