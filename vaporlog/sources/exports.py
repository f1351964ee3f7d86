"""Scan paired CaseList / ProcedureList exports and directories of case tables.

What a scan needs to know before it reads comes from two cheap tables: the listing (a row per file, no content is
read) and the headers (the first record of each file). Rows that are no records of their file's header are
kept apart with their text, see `quarantine`.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporlog.functions.staging import written_once
from vaporlog.functions.workers import with_library
from vaporlog.rules import schema as S
from vaporlog.sources.columns import csv_nulls

#: An export is a file, or a folder of part files, that ends in its list's name.
CASE_SUFFIX = "CaseList"
PROCEDURE_SUFFIX = "ProcedureList"
#: May stand before the list's name and is no part of the pair's.
SUPERVISED = ".Supervised"
CORRUPT = "_corrupt_record"
MALFORMED = "Failed to process row: malformed record"


@dataclass
class PairedExports:
    """The two lists, cut to the pairs present in both, and the pairs that are not.

    The lists of a scan have ``_corrupt_record``; ``quarantine`` divides them.
    """

    cases: DataFrame
    procedures: DataFrame
    unpaired: DataFrame


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of every file that a path, folder or glob pattern names. Only the listing is read, no content."""
    return spark.read.format("binaryFile").load(path).select("path")


def _first_record(path: str, chunk: int = 1 << 16) -> list[str] | None:
    """Cells of the first record of a file, from as many bytes as it takes; None for an empty file."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        store, name = arrow_fs.LocalFileSystem(), re.sub("^/+", "/", rest if colon else path)
    else:
        store, name = arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    text = b""
    with store.open_input_stream(name) as source:
        while more := source.read(chunk):
            text += more
            quoted = text.split(b'"')[::2]  # even pieces lie outside of quotes
            if any(b"\n" in piece or b"\r" in piece for piece in quoted):
                break
    return next(csv.reader(io.StringIO(text.decode("utf-8-sig", "replace"), newline="")), None)


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = [_first_record(path) for path in batch.column(0).to_pylist()]
        headers = pa.array([None if r is None else json.dumps(r) for r in records], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), headers], names=["path", "header"])


def scan_headers(files: DataFrame) -> DataFrame:
    """``path`` and ``header`` (a JSON list) of every listed file; Spark lists no files without a byte.

    Tasks read the first record of each file and no more: the cost grows with the number of files, not with their bytes.
    """
    with_library(files.sparkSession)
    return files.select("path").mapInArrow(_read_headers, "path string, header string")


def _names(header: list[str]) -> list[str]:
    """Column names of a header: blank ones are numbered, repeated ones told apart."""
    names: list[str] = []
    for i, name in enumerate(header):
        unique = name = name.strip() or f"_c{i}"
        k = 0
        while unique.lower() in (n.lower() for n in names):
            k += 1
            unique = f"{name}.{k}"
        names.append(unique)
    return names


def file_path() -> Column:
    """The path of a scanned row's file, as the listing has it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _scan_layout(spark: SparkSession, paths, names: list[str], multi_line: bool, declared: bool) -> DataFrame:
    """Files of one layout. The corrupt text is null for records that have at most the header's cells."""
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in [*names, CORRUPT])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", not declared)
    reader = reader.option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    # a pruned parser would not see how many cells a row has
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    bare = F.regexp_replace(CORRUPT, '"[^"]*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    # always true: Spark refuses to read nothing but the corrupt text
    readable = F.coalesce(F.length(_quoted(names[0])), F.lit(0)) >= 0
    broken = (F.contains(bare, F.lit('"')) | (cells > len(names))) & readable
    return reader.csv(paths).select(
        *map(_quoted, names),
        F.when(broken, F.col(CORRUPT)).alias(CORRUPT),
        file_path().alias("_file"),
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("_seq"),
    )


def read_csv(spark: SparkSession, path, mixed_layouts: bool = False, multi_line: bool = True,
             header: list[str] | None = None) -> DataFrame:
    """Read CSV files as text columns, with ``_file`` (path), ``_seq`` (row order) and ``_corrupt_record``.

    ``path`` is a path, folder, glob pattern or list of these. The files' headers are read first, one record each; files
    of different headers fail the scan unless ``mixed_layouts`` allows them, which reads each layout by itself and
    unites them by name. A given ``header`` skips that: Spark then compares it with every file it reads.

    Rows with more cells than the header, or with a quote that never closes, keep their whole text in
    ``_corrupt_record``; rows with fewer cells are filled up with nulls. Quoted cells may hold line breaks and
    doubled quotes; where none holds a line break, ``multi_line=False`` lets Spark split large files, and a quote
    left open spoils one line only.
    """
    if header is not None:
        return csv_nulls(_scan_layout(spark, path, _names(header), multi_line, declared=True))
    frames = read_layouts(spark, path, multi_line, most=None if mixed_layouts else 1)
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united


def read_layouts(spark: SparkSession, path, multi_line: bool = True, most: int | None = None) -> list[DataFrame]:
    """The files of each layout as a table of its own, as `read_csv` reads them; at most ``most`` layouts."""
    layouts = scan_headers(list_files(spark, path)).filter("header IS NOT NULL").groupBy("header")
    # Spark's reader takes the names of its files from the driver, as any listing does
    layouts = layouts.agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    if not layouts:
        raise ValueError(f"No CSV files found in {path}")
    if most is not None and len(layouts) > most:
        shown = "; ".join(f"{row['paths'][0]}: {row['header']}" for row in layouts[:3])
        raise ValueError(f"Files in {path} have {len(layouts)} different headers: {shown}")
    return [
        csv_nulls(_scan_layout(
            spark, path if len(layouts) == 1 else row["paths"], _names(json.loads(row["header"])), multi_line, declared=False
        ))
        for row in layouts
    ]


def quarantine(raw: DataFrame, default_year: int = S.DEFAULT_YEAR, corrupt_column: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """Good rows, and an error record for each row that is none.

    An error record has the file and text of the row, one warning, confidence 0 and the default date; the run goes
    on without it. `raw` is read twice: write it once where its scan is costly.
    """
    bad = F.col(corrupt_column).isNotNull()
    keep = [name for name in ("pair_key", "_file") if name in raw.columns]
    rejects = raw.filter(bad).select(
        *keep,
        F.col(corrupt_column).alias("source_text"),
        F.make_date(F.lit(default_year), F.lit(1), F.lit(1)).alias("case_date"),
        F.array(F.lit(MALFORMED)).alias("parsing_warnings"),
        F.lit(0.0).alias("confidence_score"),
    )
    return raw.filter(~bad).drop(corrupt_column), rejects.withColumnsRenamed({"_file": "file"})


def pair_key(path: Column, suffix: str) -> Column:
    """The part of an export's name shared by the two lists of a pair; empty for other files.

    The export is the last folder or the file itself. Every row of a scan asks for it, so the path is cut by plain
    functions: a pattern search would start at each of its characters.
    """
    ending = f".{suffix}.csv"
    folder, file = F.substring_index(F.substring_index(path, "/", -2), "/", 1), F.substring_index(path, "/", -1)
    named = F.when(F.endswith(folder, F.lit(ending)), folder).when(F.endswith(file, F.lit(ending)), file)
    bare = _without(F.substring_index(named, "=", -1), ending)
    return F.when(path.isNotNull(), F.coalesce(F.when(F.endswith(bare, F.lit(SUPERVISED)), _without(bare, SUPERVISED)).otherwise(bare), F.lit("")))


def _without(text: Column, ending: str) -> Column:
    return F.left(text, F.length(text) - len(ending))


def pair_up(cases: DataFrame, procedures: DataFrame, key: str = "pair_key") -> PairedExports:
    """Keep pairs present in both lists; report the others.

    Only distinct keys are compared. They are aggregated before any shuffle and written once, so that the semi joins
    choose by their real size: an estimate from the whole lists would shuffle and sort all rows by their few pairs.
    """
    return _paired(cases, procedures, written_once(cases.select(key).distinct()), written_once(procedures.select(key).distinct()), key)


def _paired(cases: DataFrame, procedures: DataFrame, case_keys: DataFrame, procedure_keys: DataFrame, key: str = "pair_key") -> PairedExports:
    unpaired = (
        case_keys.join(procedure_keys, key, "left_anti").withColumn("found_in", F.lit("CaseList"))
        .unionByName(
            procedure_keys.join(case_keys, key, "left_anti").withColumn("found_in", F.lit("ProcedureList"))
        )
    )
    return PairedExports(
        cases.join(procedure_keys, key, "left_semi"),
        procedures.join(case_keys, key, "left_semi"),
        unpaired,
    )


def scan_pairs(
    spark: SparkSession, case_dir: str, procedure_dir: str | None = None, mixed_layouts: bool = False,
    where: str | None = None, multi_line: bool = True,
) -> PairedExports:
    """Scan ``*.CaseList.csv`` and ``*.ProcedureList.csv`` exports and pair them by name.

    Pairs come from the listing alone, and only files of complete pairs are read. ``where`` is a condition on
    ``pair_key`` that cuts the listing, so the files of other pairs are never opened.
    """
    listed = {}
    for suffix, folder in ((CASE_SUFFIX, case_dir), (PROCEDURE_SUFFIX, procedure_dir or case_dir)):
        files = list_files(spark, f"{folder}/*.{suffix}.csv")
        files = files.withColumn("pair_key", pair_key(F.col("path"), suffix))
        listed[suffix] = files if where is None else files.filter(where)
    keys = [listed[suffix].select("pair_key").distinct() for suffix in (CASE_SUFFIX, PROCEDURE_SUFFIX)]
    paired = _paired(listed[CASE_SUFFIX], listed[PROCEDURE_SUFFIX], *keys)
    lists = {}
    for suffix, files in ((CASE_SUFFIX, paired.cases), (PROCEDURE_SUFFIX, paired.procedures)):
        paths = [row["path"] for row in files.select("path").orderBy("path").collect()]
        if not paths:
            raise ValueError(f"No matching CSV pairs found in {case_dir}")
        rows = read_csv(spark, paths, mixed_layouts, multi_line)
        lists[suffix] = rows.withColumn("pair_key", pair_key(F.col("_file"), suffix))
    return PairedExports(lists[CASE_SUFFIX], lists[PROCEDURE_SUFFIX], paired.unpaired)


def scan_case_tables(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """One case-table file, or all files of a directory put together by column name."""
    if file_format == "csv":
        return read_csv(spark, path, mixed_layouts=True)
    return spark.read.option("mergeSchema", True).format(file_format).load(path)
