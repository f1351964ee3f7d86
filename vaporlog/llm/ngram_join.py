"""N-gram Jaccard self-join with a token-group matrix, and the components of its links.

Every document is a set of word shingles. Similar documents are put into groups of bounded size (by the first token
of a global order, a min-hash). The matrix holds, by token, the groups whose prefixes contain it; two groups meet
only where a prefix token of one is an index token of the other, and enough prefix tokens are common. Where groups meet, the union of a group's tokens bounds
what any member can share with a query document, and only groups that qualify are opened and compared exactly.

Groups first meet the first group of each token they share. What is linked then needs no other comparison: in the
second step only groups of different components meet, each pair once. So a large group of copies costs a star,
not all its pairs, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.llm.common import apart, sized, staged, text_of, with_library
from vaporlog.llm.components import components
from vaporlog.llm.sets import distinct, overlap, shingle_set

#: Groups meet in the first step if their common tokens are this share of a set. Results do not depend on it.
PASSAGE = 0.04
#: Sizes within a group differ by a tenth at the most (a logarithm).
SIZES = 0.0953
#: Members of a group, about.
GROUP = 32
#: Buckets of each row of the sketch that orders tokens, and buckets that are added up together. Results do not depend on the order.
BUCKETS = 1 << 21
STRETCH = 1 << 14


def token_levels(texts: DataFrame, length: int) -> np.ndarray:
    """How common tokens are in all documents, by a sketch of fixed size: two rows of BUCKETS levels.

    Tasks count their documents' tokens in the buckets of both rows, up to a byte, and the counts are added up by stretches
    of buckets. A level is twice the logarithm of a bucket's count over the mean, from 0 to 15.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(2 * BUCKETS, "uint32"), [], 0

        def add() -> None:
            tokens = np.concatenate(held)
            for at in _places(tokens):
                np.add(counts, np.bincount(at, minlength=2 * BUCKETS), out=counts, casting="unsafe")

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), length))
                size += len(held[-1])
                if size >= 1 << 22:
                    add()
                    held, size = [], 0
        if held:
            add()
        small = np.minimum(counts, 255).astype("uint8")
        for k, part in enumerate(small.reshape(-1, STRETCH)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["k", "counts"])

    def total(key, parts):
        added = np.zeros(STRETCH, "int64")
        for part in parts.column("counts"):
            added += np.frombuffer(part.as_buffer(), "uint8")
        return pa.table({"k": parts.column("k").slice(0, 1), "counts": [added.astype("<u4").tobytes()]})

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "k int, counts binary")
    found = np.zeros(2 * BUCKETS, "float64")
    for row in counted.groupBy("k").applyInArrow(total, "k int, counts binary").collect():  # a fixed number of rows
        found[row["k"] * STRETCH:(row["k"] + 1) * STRETCH] = np.frombuffer(row["counts"], "<u4")
    mean = max(1.0, found.mean())
    return np.clip(np.floor(2 * np.log2(np.maximum(found, 1) / mean)), 0, 15).astype("uint8")


def _places(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of tokens in both rows of the sketch."""
    low = np.uint64(BUCKETS - 1)
    return (tokens & low).astype("int64"), (tokens >> np.uint64(40) & low).astype("int64") + BUCKETS


def ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens of a set as numbers whose size is the global order: common ones last, by level, else by hash."""
    first, second = _places(tokens)
    late = np.minimum(levels[first], levels[second]).astype("uint64")
    return np.sort(tokens >> np.uint64(4) | late << np.uint64(60))


def prefix_sizes(n: int, num: int, den: int) -> tuple[int, int]:
    """Tokens of a set of n that a partner of similarity num/den must meet, as the larger and as the smaller of the two."""
    return n + (-num * n // den) + 1, n + (-2 * num * n // (num + den)) + 1


def shingled(texts: DataFrame, length: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, fp (digest of the set), prefix (tokens in order) and indexed (how many of them are index tokens)."""
    held = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value
        for batch in batches:
            n, fp, prefix, indexed = [], [], [], []
            for text in batch.column(1):
                tokens = shingle_set(text.as_py(), length)
                n.append(len(tokens))
                if not len(tokens):
                    fp.append(None)
                    prefix.append(np.empty(0, "int64"))
                    indexed.append(0)
                    continue
                fp.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                tokens = ordered(tokens, hot)
                larger, smaller = prefix_sizes(len(tokens), num, den)
                prefix.append(tokens[:larger].view("int64"))
                indexed.append(smaller)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(indexed, pa.int32())],
                names=["doc_id", "n_shingles", "fp", "prefix", "indexed"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, fp binary, prefix array<long>, indexed int")


class _Sets:
    """Nodes already joined, among the few of a task."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[y] = x
        return x != y


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    shared = overlap(a, b)
    return den * shared >= num * (len(a) + len(b) - shared)


def _links_of(queries: list, members: list, num: int, den: int) -> list[tuple]:
    """Links that join what is not joined yet, between queries and members and among queries; an entry is (node, root, tokens)."""
    sets, links = _Sets(), []
    for node, root, _ in [*queries, *members]:
        sets.join(("root", root), node)
    for others in (members, queries):
        if not others:
            continue
        union = distinct(np.concatenate([tokens for _, _, tokens in others])) if others is members else None
        for i, (node, _, tokens) in enumerate(queries):
            if union is not None and den * overlap(tokens, union) < num * len(tokens):
                continue  # no member can reach the similarity
            for other, _, more in others[i + 1:] if others is queries else others:
                if sets.root(node) != sets.root(other) and _similar(tokens, more, num, den):
                    sets.join(node, other)
                    links.append((node, other))
    return links


def _qualifies(queries: list, members: list, num: int, den: int) -> bool:
    """Whether two groups, or queries among themselves, may hold a link between nodes not joined yet.

    An entry is (node, root, n, prefix). Up to the smaller of two prefixes' last tokens both sets are known; beyond, they
    can share no more than what is left of either. First the union of a group's prefixes bounds what any member shares with a query.
    """
    end = np.uint64(2**64 - 1)

    def last(entry) -> np.uint64:
        return entry[3][-1] if len(entry[3]) < entry[2] else end

    for others in (members, queries):
        if not others:
            continue
        union = distinct(np.concatenate([entry[3] for entry in others]))
        cut = min(map(last, others))
        for i, query in enumerate(queries):
            _, root, n, prefix = query
            known = int(np.searchsorted(prefix, min(cut, last(query)), "right"))
            if den * (overlap(prefix[:known], union) + n - known) < num * n:
                continue
            for other in others[i + 1:] if others is queries else others:
                m = other[2]
                if other[1] == root or num * max(n, m) > den * min(n, m):
                    continue
                both = min(last(query), last(other))
                k, j = int(np.searchsorted(prefix, both, "right")), int(np.searchsorted(other[3], both, "right"))
                most = overlap(prefix[:k], other[3][:j]) + min(n - k, m - j)
                if (num + den) * most >= num * (n + m):
                    return True
    return False


def _pairwise(pairs: DataFrame, members: DataFrame, values: list[str]) -> DataFrame:
    """Rows of the members of each pair of groups (g, h; h null: g alone), pair by pair: pair, g, h, side and the values."""
    named = pairs.select(F.xxhash64("g", "h").alias("pair"), F.col("g").alias("p"), F.col("h").alias("q"))
    asked = named.select("*", F.col("p").alias("g"), F.lit(0).alias("side")).unionByName(
        named.filter("q IS NOT NULL").select("*", F.col("q").alias("g"), F.lit(1).alias("side"))
    )
    rows = asked.join(members, "g").select("pair", "p", "q", "side", *values)
    return rows.repartition("p", "q").sortWithinPartitions("pair", "p", "q")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(p, q, queries, members, batch's schema) of each pair; an entry has all values, the last as an array. Two groups are held at a time."""
    now, sides, schema = None, ([], []), None
    for batch in batches:
        schema = batch.schema
        columns = [column.to_pylist() for column in batch.columns[1:-1]]
        arrays = batch.column(batch.num_columns - 1)
        for i, (p, q, side, *values) in enumerate(zip(*columns, strict=True)):
            if (p, q) != now:
                if sides[0]:
                    yield *now, *sides, schema
                now, sides = (p, q), ([], [])
            sides[side].append((*values, arrays[i].values.to_numpy().view("uint64")))
    if sides[0]:
        yield *now, *sides, schema


def qualified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs of groups (g, h) that must be opened, by their prefixes. `nodes` has node, g, root, n and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = [], []
        for p, q, queries, members, _ in _grouped(batches):
            if _qualifies(queries, members, num, den):
                g.append(p)
                h.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(h, pa.int64())], names=["g", "h"])

    return _pairwise(pairs, nodes, ["node", "root", "n", "prefix"]).mapInArrow(run, "g long, h long")


def open_groups(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of pairs of groups (g, h; h null: within g), compared by whole sets. `members` has node, g, root and tokens."""
    kind = members.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, queries, members, schema in _grouped(batches):
            links = _links_of(queries, members, num, den)
            if links:
                a, b = zip(*links, strict=True)
                type_ = schema.field("node").type
                yield pa.RecordBatch.from_arrays([pa.array(a, type_), pa.array(b, type_)], names=["a", "b"])

    return _pairwise(pairs, members, ["node", "root", "tokens"]).mapInArrow(run, f"a {kind}, b {kind}")


def similar_components(
    docs: DataFrame, length: int = 4, num: int = 85, den: int = 100, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    Documents link when their sets have a Jaccard similarity of at least num/den. A text of fewer words than
    `length` is one shingle; null texts and those without words have none and link with nothing. Rows with one id are
    one document: their links are shared. Rows without an id have no component and link with nothing. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with_library(spark)
    texts = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    sets = staged(shingled(texts, length, num, den, token_levels(texts, length)), "sets")
    whole = sets.filter("fp IS NOT NULL AND doc_id IS NOT NULL")
    alike = whole.groupBy("fp").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("indexed").alias("indexed")
    )
    # groups: equal first tokens, dealt out where there are many
    alike = alike.withColumn("first", F.col("prefix")[0])
    crowded = alike.groupBy("first").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > GROUP)
    alike = alike.join(crowded, "first", "left").withColumn(
        "g", F.xxhash64("first", F.floor(F.log("n") / SIZES), F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / GROUP))))
    )
    nodes = staged(alike.select("fp", "node", "n", "g", "prefix", "indexed"), "nodes")
    matrix = nodes.select("g", "indexed", F.posexplode("prefix").alias("at", "token")).select(
        "token", "g", (F.col("at") < F.col("indexed")).alias("index")
    )
    leads = matrix.groupBy("token").agg(
        F.min("g").alias("low"), F.max("g").alias("high"), F.min(F.when(F.col("index"), F.col("g"))).alias("lead")
    ).filter("low <> high").select("token", "lead")
    met = staged(matrix.join(leads, "token").groupBy("token", "g", "lead").agg(F.max("index").alias("index")), "matrix")

    # the lead that a group has most in common with, if that is no mere passage; what this leaves out meets in the second step
    sizes = nodes.groupBy("g").agg(F.min("n").alias("n"))
    stars = met.filter("g <> lead").groupBy("g", "lead").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "lead")).alias("best"))
    stars = stars.join(sizes, "g").filter(F.col("best.c") >= PASSAGE * F.col("n")).select("g", F.col("best.lead").alias("h"))
    several = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g")
    inner = several.join(stars, "g", "left_anti").withColumn("h", F.lit(None).cast("long"))
    first = staged(stars.unionByName(inner), "pairs")
    versions = whole.join(whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "doc_id", "left_semi")
    versions = versions.join(nodes.select("fp", "node"), "fp").select("doc_id", "node")
    same_id = versions.join(versions.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")

    links = _open_round(first, nodes.withColumn("root", F.col("node")), texts, length, num, den)
    links = staged(links.unionByName(same_id.filter("a <> b")), "found")
    roots = staged(components(links), "roots")

    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spans = rooted.groupBy("g").agg(
        F.min("root").alias("r"), F.max("root").alias("q"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    # a group of one component takes part under it, another one under itself
    kinds = spans.withColumn("part", F.when(F.col("r") == F.col("q"), F.xxhash64("r")).otherwise(F.xxhash64("g", F.lit("mixed"))))
    placed = met.select("token", "g", "index").join(kinds.select("g", "part", "least", "most"), "g")
    parts = placed.select("token", "part").distinct()
    split = parts.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("token")
    parts = staged(parts.join(split, "token", "left_semi"), "parts")
    placed = placed.join(split, "token", "left_semi")
    across = parts.alias("a").join(parts.alias("b"), F.expr("a.token = b.token AND a.part < b.part")).select(
        F.col("a.token").alias("token"), F.col("a.part").alias("p"), F.col("b.part").alias("q")
    )
    one = placed.select("token", F.col("part").alias("p"), *[F.col(c).alias(f"{c}1") for c in ("g", "index", "least", "most")])
    two = placed.select("token", F.col("part").alias("q"), *[F.col(c).alias(f"{c}2") for c in ("g", "index", "least", "most")])
    # sizes must be near enough; a pair shares at most its common prefix tokens and what the larger set has beyond its prefix
    fits = F.expr(f"o.token = t.token AND o.q = t.q AND {num} * least1 <= {den} * most2 AND {num} * least2 <= {den} * most1")
    shared = across.join(one, ["token", "p"]).alias("o").join(two.alias("t"), fits).groupBy(
        F.greatest("g1", "g2").alias("g"), F.least("g1", "g2").alias("h"), (F.col("least1") + F.col("least2")).alias("least"),
        F.greatest("most1", "most2").alias("most"),
    ).agg(F.count(F.lit(1)).alias("c"), F.max(F.expr("index1 OR index2")).alias("index"))
    second = shared.filter(f"index AND ({num} + {den}) * (c + ceil({num} * most / {den}) - 1) >= {num} * least").select("g", "h")
    tried = first.filter("h IS NOT NULL").select(F.greatest("g", "h").alias("g"), F.least("g", "h").alias("h"))
    second = staged(second.join(tried, ["g", "h"], "left_anti"), "pairs")
    more = _open_round(second, rooted, texts, length, num, den)
    roots = components(links.unionByName(more))

    by_set = nodes.select("fp", "node").join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return _with_component(sets, by_set)


def _open_round(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, length: int, num: int, den: int) -> DataFrame:
    """Links of pairs of groups: only groups that qualify are opened, and only their documents are read again."""
    chosen = staged(qualified(pairs, nodes.select("node", "g", "root", "n", "prefix"), num, den), "qualified")
    groups = chosen.select("g").unionByName(chosen.filter("h IS NOT NULL").select(F.col("h").alias("g"))).distinct()
    asked = staged(nodes.join(groups, "g", "left_semi").select("node", "root", "fp", "g"), "asked")
    return open_groups(chosen, staged(_token_sets(texts, asked, length), "members"), num, den)


def _token_sets(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Whole sets of the nodes asked for, from their texts: node, root, g, tokens."""
    kind = asked.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, tokens = [], []
            for i, (text, fp) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                found = shingle_set(text.as_py(), length)
                if xxhash.xxh3_128_digest(found.tobytes()) == fp.as_py():  # an id may stand for several texts
                    keep.append(i)
                    tokens.append(found.view("int64"))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in range(3)], pa.array(tokens, pa.list_(pa.int64()))], names=["node", "root", "g", "tokens"]
            )

    rows = texts.join(sized(asked), texts["doc_id"] == asked["node"]).select("node", "root", "g", F.col("text").cast("binary").alias("text"), "fp")
    return rows.mapInArrow(run, f"node {kind}, root {kind}, g long, tokens array<long>")


def _with_component(sets: DataFrame, by_set: DataFrame) -> DataFrame:
    """Components of sets back on the documents that have them."""
    placed = sets.drop("prefix", "indexed").join(by_set, "fp", "left")
    return placed.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, length: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns, whatever these are called.

    Documents without words or without an id stay; rows repeated with one id stay or go together. An empty table
    stays empty.
    """
    found = similar_components(docs, length, num, den, id_column, text_column)
    gone, (name,) = apart(staged(found.filter("component_id <> doc_id").select("doc_id").distinct(), "near"), docs)
    return docs.join(sized(gone), docs[id_column] == F.col(name), "left_anti")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other
)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id
"""
