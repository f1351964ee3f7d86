"""How the sources of a language differ in their words, by exact counts over a transducer vocabulary.

Kept terms (in enough documents of their language) are sorted and built into minimal acyclic transducers, each over
a stretch of the sorted list, so an ordinal is the stretch's base and the transducer's sum. Texts are read a second time
and their terms streamed through the transducers; only what comes out, language, source, ordinal and count, is
added up over the corpus. Divergences are summed over tiles of ordinals and sources. All numbers are integers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaporlog.functions.ranking import top_per_group
from vaporlog.llm.common import sized, staged, text_of, with_library
from vaporlog.llm.transducer import Transducer

LEAST_DOCUMENTS = 10
TOP = 10
#: Terms of a transducer at the most.
SHARD_TERMS = 1 << 16
#: Transducers of together at most this many bytes are broadcast; beyond it, terms are shuffled to them.
BROADCAST_BYTES = 32 << 20
#: Different terms that a task holds before it hands them on. Results do not depend on it.
HELD = 400_000
#: Ordinals and sources of a tile of the pairwise sums.
CHUNK = 1 << 12
SOURCES = 128
#: Letters A-Z become small, bytes of other characters than ASCII stay, all else separates terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _rows(docs: DataFrame, text_column: str, lang_column: str, source_column: str) -> DataFrame:
    return docs.select(
        text_of(docs, lang_column).alias("lang"), text_of(docs, source_column).alias("source"),
        text_of(docs, text_column).cast("binary").alias("text"),
    )


def _words(value: pa.Scalar) -> list[bytes]:
    return value.as_buffer().to_pybytes().translate(LETTERS).split() if value.as_buffer() else []


def kept_terms(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang and term of terms in at least `least` rows of their language; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                terms = list(found)
                for at in range(0, len(terms), 65536):
                    part = terms[at:at + 65536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([found[t] for t in part], pa.int64())],
                        names=["lang", "term", "n"],
                    )
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[lang].update(set(_words(text)))
                if sum(map(len, counts.values())) >= HELD:
                    yield from out()
        yield from out()

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def vocabulary(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Transducers over the sorted terms of each language, written once.

    lang, shard (from 0), first (its first term), base (ordinal of that in its language), n (terms) and data.
    """
    with_library(terms.sparkSession)
    count = terms.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                data = Transducer.of_sorted(held).to_bytes()
                columns = [[lang], [held[0].decode()], [len(held)], [data]]
                yield pa.RecordBatch.from_pydict(dict(zip(("lang", "first", "n", "data"), columns, strict=True)))

        for batch in batches:
            for name, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != lang or len(held) >= shard_terms:
                    yield from close()
                    lang, held = name, []
                held.append(term.encode())
        yield from close()

    dealt = terms.select("lang", "term").repartitionByRange(max(1, -(-count // shard_terms)), "lang", "term").sortWithinPartitions("lang", "term")
    built = staged(dealt.mapInArrow(run, "lang string, first string, n long, data binary"), "transducers")
    order = Window.partitionBy("lang").orderBy("first")  # a row per transducer
    narrow = built.select(
        F.col("lang").alias("l"), F.col("first").alias("f"), (F.row_number().over(order) - 1).alias("shard"),
        (F.sum("n").over(order) - F.col("n")).alias("base"),
    )
    joined = built.join(narrow, (F.col("lang") == F.col("l")) & (F.col("first") == F.col("f")))
    return staged(joined.select("lang", "shard", "first", "base", "n", "data"), "vocabulary")


def recount(rows: DataFrame, words: DataFrame) -> DataFrame:
    """lang, source, shard, ordinal and n of kept terms in all texts, from the transducers of `vocabulary`.

    A task holds the terms of some megabytes of text, different ones once; each then goes through the transducer
    of its stretch. Where these begin is a row per transducer, that is one for SHARD_TERMS kept terms.
    """
    firsts: dict[str, list[bytes]] = defaultdict(list)
    for row in words.select("lang", "first").orderBy("lang", "shard").collect():
        firsts[row["lang"]].append(row["first"].encode())
    firsts = dict(firsts)
    packed = "lang string, shard int, letters binary, lengths binary, sources array<string>, places array<binary>, times array<binary>"

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

        def out() -> Iterator[pa.RecordBatch]:
            for lang, by_source in counts.items():
                terms = sorted(set().union(*by_source.values()))
                cuts = [0, *(bisect_left(terms, first) for first in firsts[lang][1:]), len(terms)]
                for shard, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if start == stop:
                        continue
                    part = terms[start:stop]
                    place = {term: i for i, term in enumerate(part)}
                    sources, places, times = [], [], []
                    for source, found in by_source.items():
                        here = found if len(cuts) == 2 else {t: n for t, n in found.items() if t in place}
                        if here:
                            sources.append(source)
                            places.append(np.fromiter(map(place.__getitem__, here), "<u4", len(here)).tobytes())
                            times.append(np.fromiter(here.values(), "<i8", len(here)).tobytes())
                    lengths = np.fromiter(map(len, part), "<u4", len(part)).tobytes()
                    columns = [
                        pa.array([lang]), pa.array([shard], pa.int32()), pa.array([b"".join(part)]), pa.array([lengths]),
                        pa.array([sources], pa.list_(pa.string())), pa.array([places], pa.list_(pa.binary())), pa.array([times], pa.list_(pa.binary())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "shard", "letters", "lengths", "sources", "places", "times"])
            counts.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if lang not in firsts:  # none of its terms is kept
                    continue
                found = counts[lang][source]
                held -= len(found)
                found.update(_words(text))
                held += len(found)
                if held >= HELD:
                    yield from out()
                    held = 0
        yield from out()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, transducer = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if last != (row["lang"], row["shard"]):
                    last, transducer = (row["lang"], row["shard"]), Transducer.from_bytes(row["data"])
                lengths = np.frombuffer(row["lengths"], "<u4").astype("int64")
                ordinals = transducer.ordinals(np.frombuffer(row["letters"], "uint8"), np.cumsum(lengths) - lengths, lengths)
                for source, places, times in zip(row["sources"], row["places"], row["times"], strict=True):
                    at = ordinals[np.frombuffer(places, "<u4")]
                    kept = at >= 0
                    n = int(kept.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["lang"]] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([row["shard"]] * n, pa.int32()),
                         pa.array(at[kept] + row["base"]), pa.array(np.frombuffer(times, "<i8")[kept])],
                        names=["lang", "source", "shard", "ordinal", "n"],
                    )

    blocks = rows.mapInArrow(hold, packed)
    total = words.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    side = words.select(F.col("lang").alias("l"), F.col("shard").alias("s"), "base", "data")
    side = F.broadcast(side) if total <= BROADCAST_BYTES else side
    joined = blocks.join(side, (F.col("lang") == F.col("l")) & (F.col("shard") == F.col("s"))).drop("l", "s")
    counted = joined.mapInArrow(stream, "lang string, source string, shard int, ordinal long, n long")
    return counted.groupBy("lang", "source", "shard", "ordinal").agg(F.sum("n").alias("n"))


def _share(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), by exact decimals; null without terms."""
    return F.expr(f"1 + (1000000000BD * CAST({n} + 2 AS DECIMAL(25, 0))) DIV nullif(CAST({total} + 2 * {terms} AS DECIMAL(25, 0)), 0)")


def _difference(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def _tile(key, rows):
    """Differences of the sources of a tile, summed over its ordinals. Rows without an ordinal tell what a source has where it has no row."""
    number, ordinal, p = (rows.column(name).to_numpy() for name in ("number", "ordinal", "p"))
    block = number // SOURCES
    base = key[1].as_py() * CHUNK
    rest = ordinal < 0
    terms = int(rows.column("terms").to_numpy()[rest][0]) - base
    sides = []
    for of in (key[2].as_py(), key[3].as_py()):
        mine = rest & (block == of)
        order = np.argsort(number[mine])
        names, absent = number[mine][order], p[mine][order]
        table = np.repeat(absent[:, None], max(0, min(CHUNK, terms)), axis=1)
        there = ~rest & (block == of)
        table[np.searchsorted(names, number[there]), ordinal[there] - base] = p[there]
        sides.append((names, table))
    (left, a), (right, b) = sides
    first, second, values = [], [], []
    for i in range(len(left)):
        if a.shape[1]:
            gap = b - a[i]
            sums = (gap * gap // (b + a[i])).sum(axis=1)
        else:
            sums = np.zeros(len(right), "int64")
        other = right != left[i]
        first.append(np.full(int(other.sum()), left[i]))
        second.append(right[other])
        values.append(sums[other])
    first, second, values = (np.concatenate(x).astype("int64") for x in (first, second, values))
    if key[2].as_py() != key[3].as_py():
        first, second, values = np.append(first, second), np.append(second, first), np.append(values, values)
    return pa.Table.from_pydict({"lang": pa.array([key[0].as_py()] * len(first), pa.string()), "number": first, "other": second, "value": values})


def _terms_of(key, rows: pa.Table, words: pa.Table) -> pa.Table:
    """The terms that ordinals of a transducer stand for."""
    if not rows.num_rows:
        return rows.select(["lang", "source", "value", "rank"]).append_column("item", pa.array([], pa.string()))
    transducer, base = Transducer.from_bytes(words.column("data")[0].as_py()), words.column("base")[0].as_py()
    items = [transducer.term(ordinal - base).decode() for ordinal in rows.column("ordinal").to_pylist()]
    return rows.select(["lang", "source", "value", "rank"]).append_column("item", pa.array(items, pa.string()))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Each source against each other source of its language, and its most outstanding terms against the language.

    Columns: lang, source, part, item, value, rank. Part 'pair' has all other sources of the language, part 'term' the
    first `top` terms that the source has more often than the language. Ranks count from 1 by value descending, then
    item by its bytes. Null texts, languages and sources count as empty ones; rows repeated count again; other columns
    are ignored. A source without kept terms is compared like any other; where no term is kept all values are 0. An
    empty table gives no rows.
    """
    with_library(docs.sparkSession)
    rows = _rows(docs, text_column, lang_column, source_column)
    words = vocabulary(staged(kept_terms(rows, least), "terms"), shard_terms)
    counts = staged(recount(rows, words), "counts")

    kept = words.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.fillna(0, ["total", "terms"]).withColumns({
        "number": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"),
        "absent": F.coalesce(_share("0", "total", "terms"), F.lit(0)),
        "blocks": F.expr(f"CAST(ceil(count(*) OVER (PARTITION BY lang) / {SOURCES}) AS INT)"),
    })
    groups = staged(groups, "sources")
    names = sized(groups)
    has = staged(
        counts.join(names, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
        .select("lang", "source", "number", "blocks", "shard", "ordinal", "p", "n"),
        "shares",
    )

    # pairs, by tiles of ordinals and sources
    rest = groups.select(
        "lang", "number", "blocks", F.lit(-1).cast("long").alias("ordinal"), F.col("absent").alias("p"), "terms",
        F.explode(F.expr(f"sequence(0L, greatest(terms - 1, 0L) DIV {CHUNK})")).alias("chunk"),
    )
    cells = has.select("lang", "number", "blocks", "ordinal", "p", F.lit(None).cast("long").alias("terms"), F.expr(f"ordinal DIV {CHUNK}").alias("chunk"))
    cells = cells.unionByName(rest).withColumn("block", F.expr(f"CAST(number DIV {SOURCES} AS INT)"))
    cells = cells.withColumn("across", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "lang", "chunk", F.least("block", "across").alias("low"), F.greatest("block", "across").alias("high"), "number", "ordinal", "p", "terms"
    )
    sums = cells.groupBy("lang", "chunk", "low", "high").applyInArrow(_tile, "lang string, number long, other long, value long")
    sums = sums.groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
    mine = groups.select("lang", "number", "source")
    others = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    pairs = sums.join(mine, ["lang", "number"]).join(others, ["lang", "other"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    # terms, in the order of their ordinals where values are equal
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = whole.join(of_lang, "lang").select(F.col("lang").alias("l"), F.col("ordinal").alias("o"), _share("n", "total", "terms").alias("q"))
    above = has.join(whole, (F.col("lang") == F.col("l")) & (F.col("ordinal") == F.col("o"))).filter("p > q")
    above = above.select("lang", "source", "shard", "ordinal", _difference("p", "q").alias("value"))
    best = top_per_group(above, ["lang", "source"], [F.desc("value"), F.col("ordinal")], top, F.col("ordinal"))
    terms = best.groupBy("lang", "shard").cogroup(words.groupBy("lang", "shard")).applyInArrow(
        _terms_of, "lang string, source string, value long, rank int, item string"
    )
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


_T = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), occ AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '{_T}')) AS term FROM d
), kept AS (
  SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), s AS (
  SELECT lang, source, coalesce(total, 0) AS total, v
  FROM g JOIN v USING (lang) LEFT JOIN t USING (lang, source)
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // CAST(total + 2 * v AS HUGEINT) AS p
  FROM s JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), q AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 2) // CAST(l.total + 2 * v.v AS HUGEINT) AS q
  FROM c JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) l USING (lang) JOIN v USING (lang) GROUP BY lang, term, l.total, v.v
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (FROM pairs UNION ALL FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
