"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows are split by crc32(doc_id as text) mod 5. Remainder 0 is never learned from; 1 and 2 teach
the lexicon, 3 the trees, 4 the calibration. Each of the three reads a sample of at most
SAMPLE rows, drawn by a hash of the id; all other work covers every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.llm.common import apart, sized, staged, text_of, with_library
from vaporlog.llm.tokens import texts_of

#: Labelled rows that each of the three steps learns from, at the most.
SAMPLE = 8000
#: Terms of the learned lexicon, at the most.
TERMS = 1000
#: A term is learned when its share among toxic rows is this many standard errors, and times, above that of others.
Z, RATIO = 5.0, 4.0
#: Lengths of word beginnings that are terms besides whole words; a letter in front marks a term's kind.
PREFIXES = (4, 5)
#: A second-person word this many characters from a hit counts as near.
NEAR = 40

INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "pathetic", "worthless", "scum",
    "trash", "garbage", "clown", "disgusting", "disgrace", "fool", "jerk", "imbecile", "freak", "filth", "vermin",
    "liar", "coward", "ugly", "retard", "retarded", "bastard", "bitch", "asshole", "shit", "fuck", "fucking", "crap",
    "shut up", "kill yourself", "idiota", "estúpido", "estúpida", "imbécil", "basura", "asqueroso", "mierda",
    "idiote", "imbécile", "connard", "merde", "ordure", "dégoûtant", "dummkopf", "blöd", "arschloch", "scheiße",
    "abschaum", "widerlich", "trottel",
)
SECOND = (
    "you", "your", "yours", "you're", "yourself", "u", "ur", "tu", "toi", "ton", "tes", "vous", "votre", "du", "dich",
    "dir", "dein", "deine", "ihr", "euch", "tú", "eres", "usted", "ustedes", "te", "ti",
)
FEATURES = (
    "log_words", "insults", "insult_density", "learned", "learned_weight", "learned_density", "near_second",
    "second_density", "capitals", "shouting", "punctuation", "exclaiming", "symbols", "obfuscation", "obfuscated_hits",
)

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(rb"\b[A-Z]{3,}\b")
_MASKED = re.compile(r"[^\W\d_][0-9@$*!_-]+(?=[^\W\d_])")
_SECOND = re.compile(rf"\b(?:{'|'.join(SECOND)})\b")
_PLAIN = str.maketrans("013457@$!", "oieastasi", "*_-")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def terms_of(text: str) -> set[str]:
    """Terms of a text: whole words, and beginnings of words."""
    words = set(_WORD.findall(text.lower()))
    terms = {f"w{w}" for w in words if len(w) > 2}
    for k in PREFIXES:
        terms.update([f"{k}{w[:k]}" for w in words if len(w) > k])
    return terms


class FeatureMaker:
    """Dense features of a text, given the learned terms and their weights."""

    def __init__(self, learned: dict[str, float]) -> None:
        found: dict[str, list] = {}
        for word in INSULTS:
            found.setdefault(word, [0.0, 0.0, False])[2] = True
        for term, weight in learned.items():
            entry = found.setdefault(term[1:], [0.0, 0.0, False])
            entry[0 if term[0] == "w" else 1] = weight
        self.search = ahocorasick.Automaton()
        for word, (whole, prefix, insult) in found.items():
            self.search.add_word(word, (word, whole, prefix, insult))
        self.search.make_automaton()
        self.insults = frozenset(INSULTS) | {t[1:] for t in learned if t[0] == "w"}

    def features(self, text: str) -> list[float]:
        """One value per name in FEATURES."""
        low = text.lower()
        words = max(1, len(text.split()))
        insults, marks, learned, weight = 0, [], set(), 0.0
        for end, (word, whole, prefix, insult) in self.search.iter(low):
            start = end - len(word) + 1
            if start and low[start - 1].isalnum():
                continue
            closed = end + 1 == len(low) or not low[end + 1].isalnum()
            insults += closed and insult
            value = whole if closed and whole else 0.0 if closed else prefix
            if value:
                learned.add(word)
                weight += value
            if value or closed and insult:
                marks.append(start)
        around = [len(_SECOND.findall(low, max(0, mark - NEAR), mark + NEAR)) for mark in marks]
        data = text.encode("utf-8")
        size = max(1, len(data))
        letters = max(1, len(data) - len(data.translate(None, _LETTERS)))
        masked = set()
        for found in _MASKED.finditer(low):
            start, stop = low.rfind(" ", 0, found.start()) + 1, low.find(" ", found.end())
            masked.add(low[start:stop if stop > 0 else None].strip(".,;:!?\n"))
        return [
            math.log1p(words),
            insults, 100 * insults / words,
            len(learned), weight, 100 * len(marks) / words,
            sum(n > 0 for n in around), sum(around) / max(1, len(marks)),
            (len(data) - len(data.translate(None, _UPPER))) / letters,
            100 * len(_SHOUT.findall(data)) / words,
            (len(data) - len(data.translate(None, b"!?.,;:"))) / size,
            100 * data.count(b"!") / words,
            (len(data) - len(data.translate(None, b"#*$%&|<>@"))) / size,
            100 * len(masked) / words,
            sum(m.translate(_PLAIN) in self.insults for m in masked),
        ]


_makers: dict[tuple, FeatureMaker] = {}


def featurize(docs: DataFrame, learned: dict[str, float], text_column: str = "text") -> DataFrame:
    """The frame with its text replaced by the features, one row per row."""
    with_library(docs.sparkSession)
    others = [c for c in docs.columns if c != text_column]
    fixed = tuple(sorted(learned.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fixed not in _makers:
            _makers.clear()
            _makers[fixed] = FeatureMaker(dict(fixed))
        make = _makers[fixed].features
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            columns = list(zip(*map(make, texts_of(batch.column(at))), strict=True)) or [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(values, pa.float64()) for values in columns],
                names=[*others, *FEATURES],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_column)
    return docs.mapInArrow(run, f"{kept}, " + ", ".join(f"{name} double" for name in FEATURES))


def part(column) -> F.Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(column.cast("string")) % 5


def samples(labels: DataFrame, bound: int, id_column: str, label_column: str) -> DataFrame:
    """Labelled rows to learn from: at most about `bound` of each step, one row per id; `step` is lexicon, trees or calibration."""
    once = (
        labels.filter(labels[id_column].isNotNull() & labels[label_column].isNotNull())
        .groupBy(labels[id_column].alias("label_id")).agg(F.max(labels[label_column].cast("int")).alias("label"))
        .withColumn("part", part(F.col("label_id"))).filter("part <> 0")
        .withColumn("step", F.expr("CASE WHEN part < 3 THEN 'lexicon' WHEN part = 3 THEN 'trees' ELSE 'calibration' END"))
    )
    sizes = {row["step"]: row["count"] for row in once.groupBy("step").count().collect()}
    share = F.lit(0.0)
    for step, size in sizes.items():
        share = F.when(F.col("step") == step, F.lit(min(1.0, bound / size))).otherwise(share)
    return once.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_003)) < share * 1_000_003).select("label_id", "label", "step")


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Terms that mark toxic rows, with weights: logarithms of how much likelier they are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[label > 0].update(terms_of(text))
        for label, counter in enumerate(counts):
            names = list(counter)
            for i in range(0, len(names), 50_000):
                some = names[i:i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array([label] * len(some), pa.int32()), pa.array([counter[t] for t in some], pa.int64())],
                    names=["term", "label", "n"],
                )

    sizes = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    counts = (
        rows.select("text", "label").mapInArrow(run, "term string, label int, n long").groupBy("term")
        .agg(F.sum(F.expr("CASE WHEN label = 1 THEN n ELSE 0 END")).alias("a"), F.sum(F.expr("CASE WHEN label = 0 THEN n ELSE 0 END")).alias("b"))
    )
    p, q, all_ = F.col("a") / toxic, F.col("b") / clean, (F.col("a") + F.col("b")) / (toxic + clean)
    scored = counts.filter("a >= 3").withColumns({
        "z": (p - q) / F.sqrt(F.greatest(all_ * (1 - all_), F.lit(1e-9)) * (1 / toxic + 1 / clean)),
        "weight": F.log(((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (clean + 1))),
    })
    best = scored.filter((F.col("z") >= Z) & (F.col("weight") >= math.log(RATIO)))
    return {row["term"]: row["weight"] for row in best.orderBy(F.desc("z"), "term").limit(TERMS).collect()}


def score(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    bound: int = SAMPLE,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), text_hash and predicted of every document.

    Null counts as empty text and is scored too. Repeated rows give repeated rows. Labels without a
    document, null labels and null ids teach nothing; of several labels of one id the highest counts. Where the
    labels to learn from have one class or none, every score is the share of toxic ones (0 without any).
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with_library(spark)
    texts = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    kind = labels.schema[id_column].dataType.simpleString()
    drawn = samples(labels, bound, id_column, label_column).collect()  # at most about 3 * bound rows
    sample = F.broadcast(spark.createDataFrame([tuple(r) for r in drawn], f"label_id {kind}, label int, step string"))
    labelled = texts.join(sample, texts["doc_id"] == F.col("label_id")).select("text", "label", "step")
    learned = learn_terms(labelled.filter("step = 'lexicon'"))
    taught = staged(featurize(labelled.filter("step <> 'lexicon'"), learned), "features").withColumn(
        "label", F.col("label").cast("double")
    )
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    found = {(r["step"], r["label"]): r["count"] for r in taught.groupBy("step", "label").count().collect()}
    made = featurize(texts, learned)
    if ("trees", 0.0) in found and ("trees", 1.0) in found:
        trees = GBTClassifier(labelCol="label", maxIter=20, maxDepth=4, minInstancesPerNode=5, stepSize=0.3, seed=7)
        model = trees.fit(vector.transform(taught.filter("step = 'trees'").coalesce(4)))
        raw = vector_to_array("probability")[1]
        made = model.transform(vector.transform(made)).withColumn("raw", raw)
        if ("calibration", 0.0) in found and ("calibration", 1.0) in found:
            held = model.transform(vector.transform(taught.filter("step = 'calibration'"))).select(raw.alias("raw"), "label")
            isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held.coalesce(4))
            made = isotonic.transform(made)
        else:
            made = made.withColumn("score", F.col("raw"))
    else:
        total = sum(found.values())
        share = sum(n for (_, label), n in found.items() if label == 1) / total if total else 0.0
        made = made.withColumn("score", F.lit(share))
    return made.select(
        "doc_id", F.coalesce(part(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"), "text_hash",
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """The documents not predicted toxic, with all their columns, whatever these are called.

    See `score`: null and empty texts are scored too, repeated rows stay or go together, null ids are rows like
    others. An empty table stays empty; labels that teach nothing reject nothing or, all toxic, everything.
    """
    scored = score(docs, labels, id_column, text_column, label_column).filter("predicted = 1")
    toxic, (gone, mark) = apart(staged(scored.select("doc_id", "text_hash"), "toxic"), docs)
    match = docs[id_column].eqNullSafe(F.col(gone)) & (F.xxhash64(text_of(docs, text_column)) == F.col(mark))
    return docs.join(sized(toxic), match, "left_anti")
