"""Exact deduplication by content-defined chunk recipes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.llm.common import apart, sized, staged, text_of

#: A chunk ends at the first line break or sentence end after 256 characters, at the latest after 4096.
CHUNK = r"(?s).{256,4096}?(?:\n|[.!?]\s|\z)|.{1,4096}"


def chunk_recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's digest and its recipe: the digests of its chunks in order."""
    text = text_of(docs, text_column)
    return (
        docs.select(docs[id_column].alias("doc_id"), text.alias("text"))
        .select(
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(_chunks("text"), lambda c: F.unhex(F.sha2(c, 256))).alias("recipe"),
        )
    )


def _chunks(column: str):
    return F.regexp_extract_all(F.col(column), F.lit(CHUNK), F.lit(0))


def digests_verified(docs: DataFrame, text_column: str = "text") -> bool:
    """Whether every chunk digest stands for one content.

    Chunks are deduplicated by their whole content, so a document's text moves at most once,
    in pieces, and repeated chunks are combined before they move. Only digests meet after that.
    """
    chunks = docs.select(text_of(docs, text_column).alias("text")).select(F.explode(_chunks("text")).alias("chunk"))
    contents = chunks.distinct().select(F.unhex(F.sha2("chunk", 256)).alias("digest"))
    return contents.groupBy("digest").count().filter("count > 1").limit(1).count() == 0


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with the document that stands for all of equal text.

    Columns: doc_id, keep_id (largest id of the group), group_size, kept, text_sha256. Two
    documents are equal when their ordered lists of verified chunk identifiers are equal; should
    a digest ever stand for two contents, whole texts are compared instead.

    Null text counts as empty; empty texts form one group with an empty recipe. Rows repeated
    with one id count each, and all rows with the largest id are kept. A null id is kept only
    where its whole group has none. Other columns are ignored; an empty table gives no rows.
    """
    base = staged(chunk_recipes(docs, id_column, text_column), "recipes")
    key = "recipe"
    if not digests_verified(docs, text_column):
        key = "whole"
        base = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias(key))
        base = base.withColumn("text_sha256", F.sha2(key, 256))
    groups = base.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    return base.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called; of rows repeated with one id and text, one.

    Null texts are equal to empty ones; of rows without an id one stays where no equal text has an id. An empty
    table stays empty.
    """
    groups = exact_groups(docs, id_column, text_column).groupBy("doc_id", "text_sha256", "kept")
    groups = staged(groups.agg(F.count(F.lit(1)).alias("rows")), "groups")
    dropped, (gone, mark) = apart(groups.filter("NOT kept").select("doc_id", F.unhex("text_sha256").alias("sha")), docs)
    match = docs[id_column].eqNullSafe(F.col(gone)) & (F.unhex(F.sha2(text_of(docs, text_column), 256)) == F.col(mark))
    stay = docs.join(sized(dropped), match, "left_anti")
    repeated = groups.filter("kept AND rows > 1").limit(1).count() > 0
    return stay.dropDuplicates([id_column, text_column]) if repeated else stay


SQL = """
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), grouped AS (
  SELECT body, count(*) AS group_size, max(doc_id) AS keep_id FROM base GROUP BY body
)
SELECT b.doc_id, g.keep_id, g.group_size, b.doc_id = g.keep_id AS kept, sha256(b.body) AS text_sha256
FROM base b JOIN grouped g USING (body)
"""
